"""The engine's queries against SQL over the same tables, and its semantics against brute force."""

import fnmatch
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from grantscope import plans
from grantscope.functions import expr as X
from grantscope.operators import consolidate, delta, policy, rules, sinks
from grantscope.sources import configs, python_agents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.all_oracles()))
def test_query_matches_sql(spark, duck, name):
    got = plans.all_queries()[name](spark, SF)
    found = duck.execute(plans.all_oracles()[name])
    order = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(order)
    assert sorted(tuple(str(r[c]) for c in order) for r in got.collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_globs_are_those_of_the_shell(spark):
    rng = random.Random(1)
    patterns = ["*", "a/*", "a?c", "[ab]*", "[!a]*", "a.b", "x+y", "[", "a[", "*]", "a\\b"] + ["".join(rng.choices("ab*?.[]!", k=4)) for _ in range(60)]
    values = ["a", "abc", "a/b/c", "a\n", "axc", "b", "a.b", "xxy", "[", "a[", "]", "a\\b", ".", "ab!"]
    rows = [(p, v, X.glob_regex(p), fnmatch.fnmatchcase(v, p)) for p in patterns for v in values]
    out = spark.createDataFrame(rows, "p string, v string, r string, want boolean").select("p", "v", "want", F.regexp_like("v", "r").alias("got")).filter("want <> got").collect()
    assert not out


def test_column_globs(spark):
    rows = [(p, v, fnmatch.fnmatchcase(v, p)) for p in ("*", "a/*", "a?c", "[ab]*", "[!a]*", "a.b", "x+y", "roles/[op]*", "$a", "[") for v in ("a", "abc", "a/b", "a.b", "axb", "x+y", "roles/owner", "roles/q", "$a", "[", "b\n")]
    out = spark.createDataFrame(rows, "p string, v string, want boolean").withColumn("got", F.regexp_like("v", X.glob_column(F.col("p")))).filter("want <> got").collect()
    assert not out


def test_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    contexts = {"a/tests/x.py": "test", "my-demo/x.py": "example", "nb/tests/a.ipynb": "notebook", "src/cli.py": "cli", "x/infra_eu/m.py": "application-support", "t.template.yaml": "template-generated", "src/app.py": "runtime", "labs/x.py": "tutorial"}
    for path, want in contexts.items():
        assert value(X.source_context(F.lit(path))) == want
    assert value(X.source_context(F.lit(None).cast("string"))) == "unknown"
    assert [value(X.package_is_unpinned(F.lit("npx"), X.strings(a))) for a in (("-y", "@a/b"), ("@a/b@1",), ("b@latest",), ("b@1",), ("b",), ("-y",))] == [True, False, True, False, True, False]
    assert value(X.service_account(F.lit("serviceAccount:Me@proj.iam.gserviceaccount.com"))) == "me@proj.iam.gserviceaccount.com"
    assert value(X.service_account(F.lit("user:x@y.z"))) is None
    assert value(X.permission_classes(F.lit("secretmanager.versions.delete"))) == ["destructive_mutation", "secret_access"]
    assert [value(X.role_looks_admin(F.lit(r))) for r in ("roles/Power_User", "roles/viewer", "a*")] == [True, False, True]


def test_merges_do_not_depend_on_order(spark):
    rows = [(1, "t", ["a"], None, False, "generic", 0), (1, "t", ["b"], True, False, "function", 1), (1, "t", ["a", "c"], False, True, "hosted", 2), (1, "u", [], None, False, "generic", 3)]
    schema = "agent_key int, name string, caps array<string>, approval boolean, guardrails boolean, kind string, ordinal int"
    outs = [sorted(map(tuple, consolidate.merge_tools(spark.createDataFrame(r, schema)).collect())) for r in (rows, rows[::-1])]
    assert outs[0] == outs[1] == [(1, "t", ["a", "b", "c"], False, True, "function"), (1, "u", [], None, False, "generic")]


def test_unique_references_and_nearest_scope(spark):
    refs = spark.createDataFrame([("r1", "x"), ("r2", "y"), ("r3", "z")], "ref string, name string")
    some = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "name string, target int")
    resolved, open_ = consolidate.resolve_unique(refs, some, "name")
    assert [r.ref for r in resolved.collect()] == ["r1"] and {(r.ref, r.candidates) for r in open_.collect()} == {("r2", 2), ("r3", 0)}
    places = spark.createDataFrame([(1, "s", "a/b/c"), (2, "s", "d")], "ref_id int, name string, dir string")
    scopes = spark.createDataFrame([("s", "a", "far"), ("s", "a/b", "near")], "name string, scope_dir string, target string")
    assert [tuple(r) for r in consolidate.nearest_scope(places, scopes).collect()] == [(1, "near")]


def test_suppressions_and_multiset_score(spark):
    from datetime import date

    found = spark.createDataFrame([("R1", "a", "f1", "", 3), ("R2", "a", "f2", "", 2)], "rule_id string, agent string, fingerprint string, evidence string, severity int")
    rows = [(1, "s1", "R1", None, None, date(2030, 1, 1)), (2, "s2", "R1", "a", None, date(2030, 1, 1)), (3, "s3", "R2", None, None, date(2020, 1, 1)), (4, "s4", "R9", None, None, date(2030, 1, 1))]
    active, notes = rules.suppress(found, spark.createDataFrame(rows, "ordinal int, id string, rule_id string, agent string, fingerprint string, expires date"), date(2026, 1, 1))
    assert [r.rule_id for r in active.collect()] == ["R2"]
    assert {r.id: r.status for r in notes.collect()} == {"s1": "matched", "s2": "stale", "s3": "expired", "s4": "stale"}
    pairs = lambda x: spark.createDataFrame(x, "rule_id string, agent string")
    out = rules.score(pairs([("R", "a"), ("R", "a"), ("R", "b")]), pairs([("R", "a"), ("R", "c"), ("S", "a")]))
    assert {r.rule_id: (r.tp, r.fp, r.fn) for r in out.collect()} == {"R": (1, 1, 2), "S": (0, 1, 0)}


def test_contract_delta(spark):
    rows = lambda x: spark.createDataFrame(x, "agent_key int, mode string, dimension string, pattern string")
    base = rows([(1, "allow", "resources", "bucket/*"), (1, "deny", "capabilities", "process.*"), (1, "allow", "permissions", "a"), (2, "allow", "resources", "x")])
    head = rows([(1, "allow", "resources", "bucket/a"), (1, "allow", "permissions", "a"), (1, "allow", "permissions", "b"), (3, "allow", "resources", "x")])
    out = {(r.mode, r.dimension): (r.weakened, r.strengthened) for r in delta.contract_delta(base, head).collect()}
    assert out == {("allow", "resources"): (False, True), ("deny", "capabilities"): (True, False), ("allow", "permissions"): (True, False)}


def test_server_tool_contracts(spark):
    class Facts:
        mcp_servers = spark.createDataFrame(
            [(1, "a", ["read", "write"], [], False), (1, "b", [], [], False), (1, "c", [], ["drop"], False), (1, "d", [], [], True)], "agent_key int, name string, allowed_tools array<string>, denied_tools array<string>, dynamic_tool_filter boolean"
        )

    contracts = spark.createDataFrame([(1, s, ["read"], ["drop"]) for s in "abcd"], "agent_key int, server string, allow array<string>, deny array<string>")
    got = sorted((r.server, r.clause, r.status) for r in policy.server_tools(Facts, contracts).collect())
    assert got == [("a", "mcp_tools.allow", "violation"), ("b", "mcp_tools.allow", "violation"), ("b", "mcp_tools.deny", "unresolved"), ("c", "mcp_tools.allow", "violation"), ("d", "mcp_tools.allow", "unresolved"), ("d", "mcp_tools.deny", "unresolved")]


def test_config_sources(spark, tmp_path):
    (tmp_path / "mcp.json").write_text('{"mcpServers": {"a": {"url": "http://x/mcp", "headers": {"Authorization": "k"}}, "b": {"command": "npx", "args": ["-y", "p"], "allowedTools": ["read"]}}}')
    (tmp_path / "bad.json").write_bytes(b"\xff\xfe{")
    files = configs.read_files(spark, str(tmp_path), "*.json")
    assert {r.path.rsplit("/", 1)[1]: r.diagnostic for r in files.collect()} == {"mcp.json": None, "bad.json": "decode_error"}
    got = {r.name: (r.transport, r.authenticated, r.allowed_tools) for r in configs.mcp_servers(files).collect()}
    assert got == {"a": ("http", True, []), "b": ("stdio", False, ["read"])}
    (tmp_path / "main.tf").write_text('resource "google_project_iam_binding" "b" {\n  role = "roles/viewer"\n  members = ["serviceAccount:A@p.iam.gserviceaccount.com", "user:u@x.y"]\n}\nresource "aws_iam_policy" "p" {\n  policy = jsonencode({"Action": ["s3:Get*", "s3:Put"]})\n}\nresource "null_resource" "n" {\n}\n')
    rows = sorted((r.provider, r.principal or "", r.role or "", tuple(r.permissions)) for r in configs.terraform_grants(configs.read_files(spark, str(tmp_path), "*.tf")).collect())
    assert rows == [("aws", "", "", ("s3:Get*", "s3:Put")), ("gcp", "a@p.iam.gserviceaccount.com", "roles/viewer", ()), ("gcp", "user:u@x.y", "roles/viewer", ())]


def test_python_sources_are_read_and_never_run(spark, tmp_path):
    (tmp_path / "agent.py").write_text(f"from google.adk import Agent\nopen({str(tmp_path / 'ran')!r}, 'w')\nworker = Agent(name='worker', tools=[run_shell])\nroot = Agent(name='root', sub_agents=[worker], tools=make())\n")
    (tmp_path / "broken.py").write_text("def (")
    rows = python_agents.python_facts(configs.read_files(spark, str(tmp_path), "*.py")).collect()
    assert {(r.kind, r.owner, r.name) for r in rows} == {("agent", None, "worker"), ("agent", None, "root"), ("tool", "worker", "run_shell"), ("delegation", "root", "worker"), ("diagnostic", "root", "unresolved_tool"), ("diagnostic", None, "parse_error")}
    assert not (tmp_path / "ran").exists()


def test_digest_ignores_order_and_sarif_is_json(spark):
    import json

    rows = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id int, v string")
    assert sinks.digest(rows).first() == sinks.digest(rows.repartition(7).orderBy(F.desc("id"))).first() != sinks.digest(rows.filter("id > 0")).first()
    found = spark.createDataFrame([("R1", "a", "s", "e", 4, "fp")], "rule_id string, agent string, subject string, evidence string, severity int, fingerprint string")
    assert json.loads(sinks.sarif_results(found).first().value)["level"] == "error"
    assert sinks.exit_code(found) == 2 and sinks.exit_code(found.filter("severity < 3")) == 0


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    from grantscope.streaming import drift

    rows = spark.sql("select id as event_id, timestamp '2026-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as ts, concat('a', id % 3) as agent, concat('r', id % 4) as role, id % 5 = 0 as conditional from range(120)")
    rows.unionByName(rows.limit(5)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    job = drift.windowed_drift(stream).writeStream.format("memory").queryName("drift_out").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    got = {(r.window.start, r.agent, r.grants) for r in spark.table("drift_out").collect()}
    want = {(r.w.start, r.agent, r.n) for r in rows.groupBy(F.window("ts", "1 day").alias("w"), "agent").agg(F.count("*").alias("n")).collect()}
    assert got and got <= want and len(want - got) <= 3
