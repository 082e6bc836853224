"""Data flows: kinds of sources and sinks, paths between them, the agents that run them and where they run.

A flow starts at a source in one function, passes callees' results to their callers and ends at a sink. Local facts of a
function come from its syntax; what reaches a function comes from consolidate.flow_summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantscope.functions import expr as X

# Names of calls that read or send, caps of a scan, contexts and parameters that say nothing of an agent.
WEB_READS = ("google_search", "web_search", "search_web", "load_web_page", "url_context", "retrieve_web", "fetch_web_page")
SECRET_READS = ("get_secret", "read_secret", "fetch_secret", "access_secret_version")
CODE_CALLS = ("exec", "eval", "compile", "os.system", "os.popen")
SHELL_CALLS = ("run_command", "execute_bash", "shell_command")
SENDS = ("send_email", "send_message", "upload_file", "publish_message")
MEMORY_VERBS = ("save", "store", "add", "put", "update", "write", "append", "set")
MEMORY_CALLS = ("save_memory", "store_memory", "add_memory", "update_memory", "put_memory")
MAX_STEPS, MAX_PATHS = 24, 2_000
CONTEXTS = ("agent_tool", "cli", "application_support", "test", "example", "tutorial", "notebook", "template_generated", "runtime", "unknown")
REACHABILITIES = ("proven_agent_reachable", "proven_non_agent", "unknown")
NON_AGENT_CONTEXTS = ("cli", "application_support", "test", "example", "tutorial", "notebook", "template_generated")


def _leaf(called: Column) -> Column:
    return F.element_at(F.split(F.lower(called), r"\."), -1)


def source_kind(called: Column) -> Column:
    """The kind of source a dotted call is, or null."""
    name, leaf = F.lower(called), _leaf(called)
    fetches = name.rlike(r"^(requests|httpx)\.get") | name.endswith(".session.get") | name.contains("urllib.request.urlopen") | (name.contains("aiohttp") & (leaf == "get"))
    return (
        F.when(leaf == "input", "user_input")
        .when(fetches, "external_http_response")
        .when(leaf.isin(*WEB_READS), "web_retrieval")
        .when(name.contains("mcp") & leaf.isin("call_tool", "invoke_tool"), "mcp_response")
        .when(name.contains("secretmanager") | name.contains("vault") | leaf.isin(*SECRET_READS), "secret_value")
    )


def sink_kind(called: Column) -> Column:
    """The kind of sink a dotted call is, or null."""
    name, leaf = F.lower(called), _leaf(called)
    runs = name.isin(*CODE_CALLS) | name.startswith("subprocess.") | name.contains("create_subprocess_") | leaf.isin(*SHELL_CALLS)
    keeps = ((name.contains("memory") | name.contains("checkpoint")) & leaf.isin(*MEMORY_VERBS)) | leaf.isin(*MEMORY_CALLS)
    return (
        F.when(runs, "process_execute")
        .when(name.rlike(r"^(requests|httpx)\.(post|put|patch|delete)") | leaf.isin(*SENDS), "external_send")
        .when(keeps, "memory_write")
    )


def tool_inputs(parameters: DataFrame, tools: DataFrame, ignored=("self", "cls", "ctx", "context", "tool_context", "run_context")) -> DataFrame:
    """(function, source, source_kind): parameters of bound tool functions are what an agent passes in.

    `parameters`: (function, parameter); `tools`: (function, ...).
    """
    bound = parameters.filter(~F.lower("parameter").isin(*ignored)).join(tools.select("function").distinct(), "function", "left_semi")
    return bound.select("function", F.concat_ws(":", "function", "parameter").alias("source"), F.lit("agent_tool_input").alias("source_kind"))


def materialize(sources: DataFrame, sinks: DataFrame, most: int = MAX_PATHS) -> DataFrame:
    """(flow_id, function, source, source_kind, sink, sink_kind, steps, confidence): every source that reaches a sink.

    `sources`: (function, source, source_kind, settled); `sinks`: (function, sink, sink_kind, chain). One id is one flow,
    a chain keeps its last MAX_STEPS steps; past `most` flows the scan's own cap holds, in the order of functions.
    """
    flow_id = X.stable_id("flow-v1:", F.col("source"), F.col("source_kind"), F.col("sink"), F.col("sink_kind"), F.array_join("chain", ">"))
    rows = sources.join(sinks, "function").withColumn("flow_id", flow_id)
    steps = F.when(F.size("chain") > MAX_STEPS, F.slice("chain", -MAX_STEPS, MAX_STEPS)).otherwise(F.col("chain"))
    confidence = F.when(F.col("settled"), "supported").otherwise("potential")
    rows = rows.groupBy("flow_id").agg(F.min(F.struct("function", "source", "source_kind", "sink", "sink_kind", steps.alias("steps"), confidence.alias("confidence"))).alias("x")).select("flow_id", "x.*")
    # the cap is the scan's limit, not a cut for speed; the rows under it are the same on every run
    return rows.orderBy("function", "flow_id").limit(most)


def bind_agents(flows: DataFrame, tools: DataFrame) -> DataFrame:
    """`flows` with agent and basis: the first function of the chain whose tools are of one agent, else the file's only agent.

    `flows` (flow_id, steps, path, ...), `tools` (function, path, agent). A function of several agents' tools makes the
    flow ambiguous, and no later one mends that.
    """
    each = flows.select("flow_id", F.posexplode("steps").alias("at", "function")).join(tools.select("function", "agent").distinct(), "function")
    by_step = each.groupBy("flow_id", "at").agg(F.count_distinct("agent").alias("agents"), F.min("agent").alias("agent"))
    first = by_step.groupBy("flow_id").agg(F.min_by(F.struct("agents", "agent"), "at").alias("hit"))
    by_file = tools.groupBy("path").agg(F.count_distinct("agent").alias("n"), F.min("agent").alias("file_agent"))
    rows = flows.join(first, "flow_id", "left").join(by_file, "path", "left")
    agent = F.when(F.col("hit.agents") == 1, F.col("hit.agent")).when(F.col("hit").isNull() & (F.col("n") == 1), F.col("file_agent"))
    basis = (
        F.when(F.col("hit.agents") == 1, "tool_function").when(F.col("hit.agents") > 1, "ambiguous_tool_function")
        .when(F.col("n") == 1, "same_file").when(F.col("n") > 1, "ambiguous_same_file")
    )
    return rows.withColumns({"agent": agent, "basis": basis}).drop("hit", "n", "file_agent")


def execution_context(flows: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """`flows` (flow_id, agent, paths, steps, ...) with execution_context; `entrypoints`: (function) of main guards and scripts."""
    contexts = F.transform("paths", X.source_context)
    has = lambda c: F.array_contains(contexts, c)
    started = flows.select("flow_id", F.explode("steps").alias("function")).join(entrypoints.select("function").distinct(), "function", "left_semi")
    rows = flows.join(started.select("flow_id").distinct().withColumn("started", F.lit(True)), "flow_id", "left")
    context = (
        F.when(F.col("agent").isNotNull(), "agent_tool").when(F.size("paths") == 0, "unknown").when(has("test"), "test").when(has("example"), "example")
        .when(has("tutorial"), "tutorial").when(has("notebook"), "notebook").when(has("template-generated"), "template_generated")
        .when(F.col("started") | has("cli"), "cli").when(has("application-support"), "application_support").otherwise("runtime")
    )
    return rows.withColumn("execution_context", context).drop("started")


def reachability(flows: DataFrame) -> DataFrame:
    """`flows` (agent, basis, execution_context, ...) with reachability and what it rests on; unknown stays unknown."""
    ambiguous = F.coalesce(F.startswith("basis", F.lit("ambiguous")), F.lit(False))
    apart = F.col("execution_context").isin(*NON_AGENT_CONTEXTS) & F.col("basis").isNull()
    state = F.when(F.col("agent").isNotNull(), REACHABILITIES[0]).when(~ambiguous & apart, REACHABILITIES[1]).otherwise(REACHABILITIES[2])
    why = (
        F.when(F.col("agent").isNotNull(), F.coalesce("basis", F.lit("explicit_agent_binding"))).when(ambiguous, "ambiguous_agent_binding")
        .when(apart, "non_agent_execution_context_without_tool_binding").otherwise("no_agent_tool_binding_evidence")
    )
    return flows.withColumns({"reachability": state, "reachability_basis": why})


def histogram(flows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(value, n) of a column, all `values`, those that don't occur with 0."""
    each = flows.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return each.join(flows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def tool_functions(tools: DataFrame, functions: DataFrame) -> DataFrame:
    """(tool_id, function, basis): the function a tool runs, by its key, its file, or the module it was imported from.

    `tools` (tool_id, key, name, path, module), `functions` (function, name, path, module). The first basis that has any
    candidate decides, and only if it has exactly one.
    """
    named = functions.withColumnsRenamed({"name": "f_name", "path": "f_path", "module": "f_module"})
    ways = [
        ("key", F.col("key") == F.col("function")),
        ("same_file", (F.col("name") == F.col("f_name")) & (F.col("path") == F.col("f_path"))),
        ("import_module", (F.col("name") == F.col("f_name")) & ((F.col("f_module") == F.col("t_module")) | F.endswith("f_module", F.concat(F.lit("."), "t_module")))),
    ]
    t = tools.withColumnRenamed("module", "t_module")
    found = None
    for rank, (basis, test) in enumerate(ways):
        each = t.join(named, test).select("tool_id", "function", F.lit(rank).alias("rank"), F.lit(basis).alias("basis"))
        found = each if found is None else found.unionByName(each)
    counted = found.distinct().withColumn("n", F.count("*").over(Window.partitionBy("tool_id", "rank"))).withColumn("first", F.min("rank").over(Window.partitionBy("tool_id")))
    return counted.filter((F.col("rank") == F.col("first")) & (F.col("n") == 1)).select("tool_id", "function", "basis")
