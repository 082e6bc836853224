"""A repository's facts from its files: Python sources, notebooks, MCP configs and manifests become one FactSet.

Files are read by Spark; agents are keyed by file and name. What nothing states stays null and so unresolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X
from grantscope.operators import consolidate, flows
from grantscope.plans.lens import FactSet
from grantscope.sources import configs, documents, python_agents
from grantscope.sources.walk import MCP_NAMES

MANIFEST_NAMES = ("agents.yaml", "agents.yml", "agent-manifest.yaml", "agent-manifest.yml")


def _key(path="path", name="agent"):
    return F.xxhash64(path, name)


def repository(files: DataFrame) -> tuple[FactSet, DataFrame]:
    """(facts, diagnostics) of `files` (path, text)."""
    name = F.element_at(F.split("path", "/"), -1)
    notebooks = python_agents.notebook_text(files.filter(name.endswith(".ipynb")))
    rows = python_agents.python_facts(files.filter(name.endswith(".py")).select("path", "text").unionByName(notebooks))
    # parsed once: what follows reads these rows many times
    rows = rows.checkpoint()
    j = lambda k: F.get_json_object("detail", f"$.{k}")
    none = F.array().cast("array<string>")
    spark = files.sparkSession
    empty = lambda schema: spark.createDataFrame([], schema)

    found = rows.filter("kind = 'agent'")
    plugins = F.coalesce(j("plugins"), F.lit("")).rlike("(?i)approval|guard|safety|policy")
    own = found.select(
        _key("path", "name").alias("agent_key"), "name", F.col("line").cast("long").alias("ordinal"), "framework", "path", plugins.alias("approval_plugin"), j("before_tool_callback").isNotNull().alias("before_tool_callback"),
        plugins.alias("safety_plugin"), F.lit(False).alias("a2a_exposed"),
    )

    # tools: what their functions do, what frameworks know of them, or their names
    called = rows.filter("kind = 'call'").select("path", F.col("owner").alias("function"), F.explode(python_agents.call_capabilities(F.col("name"), j("first"), j("mode"))).alias("cap"))
    body = called.groupBy("path", "function").agg(F.collect_set("cap").alias("body"))
    functions = rows.filter("kind = 'function'").select("path", F.col("name").alias("function"), j("decorator").alias("decorator"), j("needs_approval").alias("needs"), (j("asks") == "true").alias("asks")).dropDuplicates(["path", "function"])
    functions = functions.join(body, ["path", "function"], "left").withColumn("body", F.coalesce("body", none))
    known = spark.createDataFrame([(k, v.split(",")) for k, v in python_agents.BUILTIN_TOOLS.items()], "name string, builtin_caps array<string>")
    used = rows.filter("kind = 'tool'").select("path", "framework", F.col("owner").alias("agent"), "name", "line", "detail").join(functions.withColumnRenamed("function", "name"), ["path", "name"], "left")
    used = used.join(F.broadcast(known), "name", "left")  # a fixed table
    decorated = python_agents.without_control_names(F.col("name"), X.infer_capabilities(F.col("name")), F.col("body"))
    caps = F.when(F.col("builtin_caps").isNotNull(), X.sorted_set("builtin_caps")).when(F.col("body").isNotNull(), decorated).otherwise(X.infer_capabilities(F.col("name")))
    stated = F.coalesce(j("needs_approval"), j("require_confirmation"), j("requires_approval"), F.col("needs"))
    tools = used.select(
        _key().alias("agent_key"), "name", F.when(F.col("body").isNotNull(), "function").when(F.col("builtin_caps").isNotNull(), "hosted").otherwise("generic").alias("kind"), caps.alias("caps"),
        F.when(F.coalesce("asks", F.lit(False)), True).otherwise(python_agents.approval(stated)).alias("approval"), F.coalesce("asks", F.lit(False)).alias("guardrails"), F.lit(None).cast("string").alias("identity"), F.lit(None).cast("string").alias("network_scope"), F.col("line").alias("ordinal"),
    )
    executors = found.filter(j("code_executor.call").isNotNull()).select(_key("path", "name").alias("agent_key"), j("code_executor.call").alias("name"), j("code_executor.timeout_seconds").alias("t"), j("code_executor.network").alias("n"), j("code_executor.working_dir").alias("w"), "line")
    tools = tools.unionByName(executors.select("agent_key", "name", F.lit("adk_code_executor").alias("kind"), F.array(F.lit("process.execute")).alias("caps"), F.lit(None).cast("boolean").alias("approval"), F.lit(False).alias("guardrails"), F.lit(None).cast("string").alias("identity"), F.lit(None).cast("string").alias("network_scope"), F.col("line").alias("ordinal")))
    merged = consolidate.merge_tools(tools).withColumns({"identity": F.lit(None).cast("string"), "network_scope": F.lit(None).cast("string")}).select("agent_key", "name", "kind", "caps", "approval", "guardrails", "identity", "network_scope")
    sandboxed = F.when(F.col("name") == "UnsafeLocalCodeExecutor", False).when(F.col("name").isin(*[k for k, v in python_agents.CODE_EXECUTORS.items() if v]), True)
    blank = {"environment": "string", "include_plugins": "boolean", "agent_card": "string", "card_authenticated": "boolean"}
    details = used.select(
        _key().alias("agent_key"), "name", F.when(F.col("name") == "AgentTool", "adk_agent_tool").alias("part_of"), F.when(F.col("builtin_caps").isNotNull(), F.col("name")).alias("builtin"), F.lit(None).cast("string").alias("executor"), F.lit(None).cast("boolean").alias("sandboxed"),
        j("environment.call").alias("environment"), (F.coalesce(j("policy.allowed_command_prefixes"), F.lit("[]")) != "[]").alias("bash_restrictive"), F.lit(True).alias("limits_applicable"), F.lit(False).alias("limits_complete"), j("include_plugins").cast("boolean").alias("include_plugins"),
        F.lit(None).cast("string").alias("agent_card"), F.lit(None).cast("boolean").alias("card_authenticated"), j("tool_filter").isNotNull().alias("filtered"), F.lit(False).alias("control_custom"), F.lit(False).alias("control_mutating"),
    )
    runs = executors.select(
        "agent_key", "name", F.lit("adk_code_executor").alias("part_of"), F.lit(None).cast("string").alias("builtin"), F.col("name").alias("executor"), sandboxed.alias("sandboxed"), *[F.lit(None).cast(t).alias(c) for c, t in blank.items()],
        F.lit(False).alias("bash_restrictive"), F.lit(True).alias("limits_applicable"), (F.col("t").isNotNull() & (F.col("n") == "none") & F.col("w").isNotNull()).alias("limits_complete"), F.lit(False).alias("filtered"), F.lit(False).alias("control_custom"), F.lit(False).alias("control_mutating"),
    )
    remote = found.filter(j("class") == "RemoteA2aAgent").select("path", "name", "detail", "line")
    cards = remote.select(
        _key("path", "name").alias("agent_key"), F.lit("remote").alias("name"), F.lit("adk_a2a_remote").alias("part_of"), F.lit(None).cast("string").alias("builtin"), F.lit(None).cast("string").alias("executor"), F.lit(None).cast("boolean").alias("sandboxed"),
        F.lit(None).cast("string").alias("environment"), F.lit(None).cast("boolean").alias("include_plugins"), j("agent_card").alias("agent_card"), F.coalesce(j("auth_scheme"), j("auth_credential")).isNotNull().alias("card_authenticated"),
        F.lit(False).alias("bash_restrictive"), F.lit(True).alias("limits_applicable"), F.lit(False).alias("limits_complete"), F.lit(False).alias("filtered"), F.lit(False).alias("control_custom"), F.lit(False).alias("control_mutating"),
    )
    a2a = remote.select(_key("path", "name").alias("agent_key"), F.lit("remote").alias("name"), F.lit("adk_a2a_remote").alias("kind"), F.array(F.lit("agent.delegate"), F.lit("network.external")).alias("caps"), F.lit(None).cast("boolean").alias("approval"), F.lit(False).alias("guardrails"), F.lit(None).cast("string").alias("identity"), F.lit(None).cast("string").alias("network_scope"))
    details = details.unionByName(runs).unionByName(cards).dropDuplicates(["agent_key", "name"])

    # servers of agents, of configs that no agent names, and of manifests
    url = F.coalesce(j("url"), j("params.url"), j("connection_params.url"))
    command = F.coalesce(j("command"), j("params.command"), j("connection_params.command"), j("connection_params.server_params.command"))
    args = F.coalesce(F.from_json(F.coalesce(j("args"), j("params.args"), j("connection_params.server_params.args")), "array<string>"), none)
    headers = F.transform(F.map_keys(F.from_json(F.coalesce(j("headers"), j("params.headers"), j("connection_params.headers")), "map<string,string>")), F.lower)
    allowed = F.coalesce(F.from_json(F.coalesce(j("allowed_tools"), j("tool_filter"), j("tool_filter.allowed_tool_names")), "array<string>"), none)
    servers = rows.filter("kind = 'server'").select(
        _key("path", "owner").alias("agent_key"), "name", F.when(command.isNotNull(), "stdio").when(url.isNotNull(), "http").otherwise("unknown").alias("transport"), url.alias("url"), command.alias("command"), args.alias("args"),
        F.when(X.any_of(headers, configs.AUTH_HEADERS), True).when(url.isNotNull(), False).alias("authenticated"), python_agents.approval(j("require_approval")).alias("approval"), F.lit(False).alias("guardrails"), allowed.alias("allowed_tools"), none.alias("denied_tools"),
        (j("tool_filter.name").isNotNull()).alias("dynamic_tool_filter"), F.lit(None).cast("string").alias("identity"), F.col("line").alias("ordinal"),
    )
    servers = consolidate.first_servers(servers).drop("ordinal")
    hand = rows.filter("kind = 'delegation'").select(_key("path", "owner").alias("agent_key"), F.col("name").alias("target"))

    m = documents.manifest(documents.read_documents(files.filter(name.isin(*MANIFEST_NAMES))))
    keyed = lambda t: m[t].withColumn("agent_key", _key())
    own = own.unionByName(keyed("agents").select("agent_key", F.col("agent").alias("name"), F.col("ordinal").cast("long"), F.lit("manifest").alias("framework"), "path", *[F.lit(False).alias(c) for c in ("approval_plugin", "before_tool_callback", "safety_plugin", "a2a_exposed")]))
    merged = merged.unionByName(a2a).unionByName(keyed("tools").select("agent_key", "name", "kind", "caps", "approval", "guardrails", "identity", F.lit(None).cast("string").alias("network_scope")))
    servers = servers.unionByName(keyed("servers").select("agent_key", "name", "transport", "url", "command", "args", "authenticated", "approval", F.lit(False).alias("guardrails"), "allowed_tools", "denied_tools", F.lit(False).alias("dynamic_tool_filter"), "identity"))
    people = keyed("identities").select("agent_key", "agent", "name", "provider", "roles", "permissions", "oauth_scopes", "credential_source")
    reach = keyed("tools").select("agent_key", F.col("name").alias("owner_name"), F.explode("destinations").alias("target"))
    plain = F.coalesce(F.get_json_object("r", "$.selector"), F.get_json_object("r", "$.path"), F.col("r"))
    held = keyed("tools").select("agent_key", F.col("name").alias("owner_name"), F.explode("resources").alias("r")).select("agent_key", "owner_name", plain.alias("selector"), F.lower(F.coalesce(F.get_json_object("r", "$.classification"), F.lit("internal"))).alias("classification"))

    # flows inside one function, from a source call or the parameters of a tool to a sink call
    calls = rows.filter("kind = 'call'").select("path", F.concat_ws(":", "path", "owner").alias("function"), "name", "line")
    params = rows.filter("kind = 'function'").select(F.concat_ws(":", "path", "name").alias("function"), F.explode(F.from_json(j("params"), "array<string>")).alias("parameter"))
    bound = used.filter("body is not null").select(F.concat_ws(":", "path", "name").alias("function"), "path", "agent").distinct()
    sources = calls.withColumn("source_kind", flows.source_kind(F.col("name"))).filter("source_kind is not null").select("function", F.col("name").alias("source"), "source_kind").unionByName(flows.tool_inputs(params, bound))
    sinks = calls.withColumn("sink_kind", flows.sink_kind(F.col("name"))).filter("sink_kind is not null").select("function", F.col("name").alias("sink"), "sink_kind", F.array("function").alias("chain"))
    # one function's source and sink show that both stand in it, not that data passes: potential, not supported
    paths = flows.materialize(sources.withColumn("settled", F.lit(False)), sinks)
    paths = paths.withColumns({"path": F.substring_index("function", ":", 1), "paths": F.array(F.substring_index("function", ":", 1))})
    entry = rows.filter("kind = 'function' and name = 'main'").select(F.concat_ws(":", "path", "name").alias("function"))
    paths = flows.reachability(flows.execution_context(flows.bind_agents(paths, bound), entry))
    paths = paths.join(own.select("agent_key", F.col("name").alias("agent"), "path"), ["agent", "path"], "left").select("flow_id", "agent_key", "source_kind", "sink_kind", "confidence", "reachability", "execution_context")

    configured = configs.mcp_servers(files.filter(name.isin(*MCP_NAMES)))
    diagnostics = rows.filter("kind = 'diagnostic'").select("path", F.col("name").alias("kind"), "line", F.lit(True).alias("incomplete"))
    diagnostics = diagnostics.unionByName(configured.select("path", F.lit("mcp_declaration_not_agent_bound").alias("kind"), F.lit(1).alias("line"), F.lit(False).alias("incomplete")))
    policies = keyed("policies").select("agent_key", "required", "denied", "allowed_resources", "allowed_destinations", "require_approval_for", "max_privileged")
    fs = FactSet(
        agents=own, delegations=hand, tools=merged, tool_details=details, unbound_tools=functions.filter("decorator is not null").join(used.select("path", F.col("name").alias("function")), ["path", "function"], "left_anti").select(F.col("function").alias("name"), decorated_caps(), python_agents.approval(F.col("needs")).alias("approval")),
        global_identities=people.filter("agent is null").drop("agent_key", "agent"), flows=paths, identities=people.filter("agent is not null").drop("agent"), resources=held,
        destinations=reach.withColumn("restricted", ~X.destination_is_broad(F.col("target"))), mcp_servers=servers, inputs=keyed("inputs").select("agent_key", "name", "trust", "kind"), policies=policies,
        clauses=keyed("clauses").select("agent_key", "mode", "dimension", "pattern"), grants=empty("agent_key long, role string, permission string, conditional boolean, required boolean, base boolean"),
    )
    return fs, diagnostics


def decorated_caps():
    return python_agents.without_control_names(F.col("function"), X.infer_capabilities(F.col("function")), F.col("body")).alias("caps")
