"""A small repository, read by Spark, from files to findings."""

import pytest
from pyspark.sql import functions as F

from grantscope.operators import authority, deployment, flows, mcp, rules
from grantscope.plans.repository import FILES
from grantscope.sources import assemble, python_agents


@pytest.fixture(scope="module")
def scanned(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "/tmp/checkpoints"))
    return assemble.repository(spark.createDataFrame(FILES, "path string, text string").repartition(3))


def test_facts(scanned):
    fs, diagnostics = scanned
    assert {(r.name, r.framework) for r in fs.agents.collect()} == {("runner", "openai-agents"), ("helper", "openai-agents"), ("builder", "google-adk"), ("far", "google-adk"), ("graph", "langgraph"), ("clerk", "manifest")}
    tools = {r.name: r for r in fs.tools.collect()}
    assert tools["run_shell"].caps == ["process.execute"] and tools["run_shell"].approval is None
    assert tools["drop_rows"].approval is True and tools["drop_rows"].guardrails
    assert tools["verify_delete"].caps == [] and tools["send_note"].approval is True
    assert "process.execute" in tools["ExecuteBashTool"].caps and tools["UnsafeLocalCodeExecutor"].kind == "adk_code_executor"
    assert {(r.name, r.url, r.authenticated, tuple(r.allowed_tools)) for r in fs.mcp_servers.collect()} == {("docs", "http://tools.example.com/mcp", False, ()), ("files", None, None, ("read",))}
    assert [(r.target) for r in fs.delegations.collect()] == ["helper"]
    assert {r.name for r in fs.unbound_tools.collect()} == {"loose_exec"}
    assert {r.kind for r in diagnostics.collect()} == {"parse_error", "unresolved_tool", "mcp_declaration_not_agent_bound"}


def test_findings(scanned):
    fs, _ = scanned
    found = {(r.rule_id, r.agent, r.subject) for r in rules.evaluate(fs).collect()}
    want = {
        ("AGT020", "runner", "run_shell"), ("AGT020", None, "loose_exec"), ("AGT030", "runner", "docs"), ("AGT031", "runner", "docs"), ("AGT032", "runner", "docs"), ("ADK002", "builder", "UnsafeLocalCodeExecutor"), ("ADK004", "builder", "ExecuteBashTool"),
        ("ADK009", "far", "remote"), ("ADK010", "far", "remote"), ("CAP002", "clerk", ""), ("IDN001", "clerk", "sa"), ("AGT050", "helper", "files"),
    }
    assert want <= found, want - found
    assert not any(s == "drop_rows" for _, _, s in found) and not any(s == "verify_delete" for _, _, s in found)


def test_relationships_and_flows(scanned):
    fs, _ = scanned
    rows = {r.target_name: r for r in authority.tool_relationships(fs).collect()}
    assert "identity" in rows["run_shell"].unresolved and rows["run_shell"].resolution == "partially_resolved"
    found = {(r.source_kind, r.sink_kind, r.confidence, r.reachability) for r in fs.flows.collect()}
    assert ("agent_tool_input", "process_execute", "potential", "proven_agent_reachable") in found
    assert ("user_input", "process_execute", "potential", "unknown") in found


def test_approvals_and_calls(spark):
    values = ["true", "always", '{"a": "always", "b": true}', "never", "false", '{"a": "always", "b": "never"}', "{}", None, "maybe"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", python_agents.approval(F.col("v")).alias("a")).orderBy("i").collect()
    assert [r.a for r in rows] == [True, True, True, False, False, None, None, None, None]
    calls = [("open", "w"), ("open", None), ("shutil.rmtree", None), ("requests.post", None), ("json.dumps", None), ("p.write_text", None)]
    out = spark.createDataFrame([(i, c, m) for i, (c, m) in enumerate(calls)], "i int, c string, m string").select("i", python_agents.call_capabilities(F.col("c"), F.lit(None).cast("string"), F.col("m")).alias("x")).orderBy("i").collect()
    assert [r.x for r in out] == [["data.write"], ["data.read"], ["destructive.write"], ["external.write", "network.external"], [], ["data.write"]]


def test_flow_binding(spark):
    rows = [("f1", ["a", "b"], "p"), ("f2", ["x"], "p"), ("f3", ["c"], "q"), ("f4", ["d", "a"], "p"), ("f5", ["z"], "r")]
    tools = [("a", "p", "one"), ("c", "q", "two"), ("c", "q", "three"), ("d", "p", "one"), ("d", "p", "four")]
    bound = flows.bind_agents(spark.createDataFrame(rows, "flow_id string, steps array<string>, path string"), spark.createDataFrame(tools, "function string, path string, agent string"))
    got = {r.flow_id: (r.agent, r.basis) for r in bound.collect()}
    assert got == {"f1": ("one", "tool_function"), "f2": (None, "ambiguous_same_file"), "f3": (None, "ambiguous_tool_function"), "f4": (None, "ambiguous_tool_function"), "f5": (None, None)}
    paths = bound.withColumn("paths", F.when(F.col("flow_id") == "f5", F.array(F.lit("tests/t.py"))).otherwise(F.array("path")))
    states = {r.flow_id: (r.execution_context, r.reachability, r.reachability_basis) for r in flows.reachability(flows.execution_context(paths, spark.createDataFrame([("x",)], "function string"))).collect()}
    assert states["f1"] == ("agent_tool", "proven_agent_reachable", "tool_function") and states["f5"] == ("test", "proven_non_agent", "non_agent_execution_context_without_tool_binding")
    assert states["f2"] == ("cli", "unknown", "ambiguous_agent_binding")


def test_long_chains_keep_their_end(spark):
    chain = [f"s{i}" for i in range(40)]
    sources = spark.createDataFrame([("g", "src", "user_input", True)], "function string, source string, source_kind string, settled boolean")
    sinks = spark.createDataFrame([("g", "os.system", "process_execute", chain)], "function string, sink string, sink_kind string, chain array<string>")
    row = flows.materialize(sources, sinks).first()
    assert row.steps == chain[-flows.MAX_STEPS :] and row.confidence == "supported"


def test_tools_find_their_functions(spark):
    tools = [(1, "m:f", "f", "p.py", None), (2, None, "g", "p.py", None), (3, None, "h", "x.py", "pkg.mod"), (4, None, "h", "x.py", "mod"), (5, None, "none", "x.py", "mod")]
    functions = [("m:f", "f", "m.py", "m"), ("p:g", "g", "p.py", "p"), ("q:g", "g", "q.py", "q"), ("a:h", "h", "a.py", "app.pkg.mod"), ("b:h", "h", "b.py", "other.mod")]
    got = flows.tool_functions(spark.createDataFrame(tools, "tool_id int, key string, name string, path string, module string"), spark.createDataFrame(functions, "function string, name string, path string, module string")).collect()
    assert {(r.tool_id, r.function, r.basis) for r in got} == {(1, "m:f", "key"), (2, "p:g", "same_file"), (3, "a:h", "import_module")}


def test_clients_bind_agents_of_their_file(spark):
    clients = spark.createDataFrame([("p", "c", "s1"), ("q", "c", "s2")], "path string, client string, server string")
    tools = spark.createDataFrame([("p", "t", "c"), ("q", "t", "c")], "path string, alias string, client string")
    agents = spark.createDataFrame([("p", "t", "one"), ("q", "t", "two"), ("q", "u", "two")], "path string, alias string, agent string")
    assert [tuple(r) for r in mcp.bind_clients(clients, tools, agents).collect()] == [("p", "one", "s1")]


def test_requirements_and_declared_roles(spark):
    required = spark.createDataFrame([("a", ["r1"], [], ["required_roles", "x"]), ("b", [], [], ["required_roles"])], "agent string, roles array<string>, permissions array<string>, incomplete array<string>")
    wired = spark.createDataFrame([("a", "r2")], "agent string, role string")
    got = {r.agent: (r.roles, r.incomplete) for r in deployment.with_requirements(required, wired).collect()}
    assert got == {"a": (["r1", "r2"], ["x"]), "b": ([], ["required_roles"])}
    known = spark.createDataFrame([("x@p.iam.gserviceaccount.com", ["r0"])], "account string, roles array<string>")
    grants = spark.createDataFrame([("serviceAccount:X@p.iam.gserviceaccount.com", "r9"), ("serviceAccount:y@p.iam.gserviceaccount.com", "r8")], "principal string, role string")
    assert [r.roles for r in deployment.declared_roles(known, grants).collect()] == [["r0", "r9"]]
