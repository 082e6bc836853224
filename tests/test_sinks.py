"""Documents that leave the engine: reports, graphs, policies, baselines, the rule catalogue."""

import datetime
import json

import pytest
import yaml
from pyspark.sql import functions as F

from grantscope.functions import expr as X
from grantscope.operators import authority, gates, rules, sinks
from grantscope.plans.lens import facts

SF = "/root/testdata/sf0.001"


def test_scan_report(spark):
    fs = facts(spark, SF)
    found = rules.server_rules(fs).filter("rule_id in ('AGT030', 'AGT050')")
    found = found.join(rules.registry(spark), "rule_id").withColumns({"source_context": F.lit("runtime"), "fingerprint": X.stable_id("finding-v1:", "rule_id", "agent", "subject")})
    diagnostics = spark.createDataFrame([("unresolved_tool", True)], "kind string, incomplete boolean")
    row = json.loads(sinks.scan_report(found, authority.tool_relationships(fs), gates.coverage(fs, diagnostics)).first().document)
    assert row["summary"]["findings"] == len(row["findings"]) == found.count() and row["coverage"]["unresolved_tools"] == 1
    order = [(-f["severity"], f["fingerprint"]) for f in row["findings"]]
    assert order == sorted(order) and "order" not in row["findings"][0]


def test_graph_document_is_whole_or_an_error(spark):
    nodes = spark.createDataFrame([("a", "agent", "x"), ("b", "tool", "y")], "id string, kind string, name string")
    edges = spark.createDataFrame([("e", "INVOKES", "a", "b")], "id string, kind string, source string, target string")
    assert {(r.part, json.loads(r.document)["id"]) for r in sinks.graph_document(nodes, edges).collect()} == {("node", "a"), ("node", "b"), ("edge", "e")}
    with pytest.raises(ValueError):
        sinks.graph_document(nodes, edges, most_nodes=1)


def test_policy_and_baseline(spark):
    proposal = spark.createDataFrame([("a", "capabilities", "data.read,*"), ("a", "resources", "db")], "agent string, dimension string, patterns string")
    approvals = spark.createDataFrame([("a", ["x"])], "agent string, capabilities array<string>")
    doc = yaml.safe_load(sinks.policy_document(proposal, approvals))
    assert doc["agents"][0]["policy"]["authority"] == {"allow": {"capabilities": ["data.read"], "resources": ["db"]}, "require_approval_for": ["x"]}
    found = spark.createDataFrame([("AGT020", "f2"), ("AGT001", "f1"), ("AGT020", "f2")], "rule_id string, fingerprint string")
    today, later = datetime.date(2026, 1, 1), datetime.date(2027, 1, 1)
    items = yaml.safe_load(sinks.suppression_baseline(found, "known", later, today, False))["suppressions"]
    assert [(i["id"], i["fingerprint"]) for i in items] == [("baseline-0001-agt001", "f1"), ("baseline-0002-agt020", "f2")]
    for args in (("known", later, today, True), ("known", datetime.date(2025, 1, 1), today, False), (" ", later, today, False)):
        with pytest.raises(ValueError):
            sinks.suppression_baseline(found, *args)


def test_catalogue_paths_and_spelling(spark):
    rows = rules.catalogue(spark).collect()
    assert len(rows) == 46 and all(r.evaluated for r in rows) and [(r.layer, r.rule_id) for r in rows] == sorted((r.layer, r.rule_id) for r in rows)
    paths = spark.createDataFrame([("/r/a/b.py",), ("/other/c.py",), ("d/e.py",), (None,)], "p string")
    assert [r.x for r in paths.select(X.relative_path(F.col("p"), "/r").alias("x")).collect()] == ["a/b.py", "c.py", "d/e.py", None]
    assert [r.x for r in spark.createDataFrame([("é",), (None,)], "p string").select(X.nfc("p").alias("x")).collect()] == ["é", None]


def test_exit_codes(spark):
    gate = lambda *failed: spark.createDataFrame([(g, g in failed, 0.0) for g in ("severity", "resolution_budget", "unresolved_budget", "completeness")], "gate string, failed boolean, observed double")
    assert [gates.exit_code(gate(*f), strict=s) for f, s in (((), True), (("severity",), False), (("severity", "unresolved_budget"), False), (("completeness",), True), (("completeness",), False))] == [0, 2, 1, 1, 0]
