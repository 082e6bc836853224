"""Queries do the whole job: no row of the tables and no rule is left out."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from grantscope.operators import authority, closure, delta, policy, query, rules
from grantscope.plans import core
from grantscope.plans.lens import facts

SF = "/root/testdata/sf0.001"


def test_lens_leaves_no_row_out(spark):
    fs = facts(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    pairs = lines.select("l_suppkey", "l_partkey").distinct().count()
    assert fs.tools.count() == pairs and fs.grants.count() == lines.count()
    assert fs.policies.count() == fs.agents.count() == spark.read.parquet(f"{SF}/supplier.parquet").count()
    # what isn't a resource or destination is a null attribute of its pair, by line order alone
    first = lines.groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("k"))
    assert fs.resources.count() == first.filter("k % 3 <> 0").count() and fs.destinations.count() == first.filter("k % 4 <> 0").count()


def test_outbound_tools_without_destination_and_assessed_risks(spark):
    fs = facts(spark, SF)
    agents = fs.agents.filter("agent_key <= 5")
    tool = lambda k, n, caps, scope: (k, n, "generic", caps, True, False, None, scope)
    rows = [tool(1, "a", ["network.external"], None), tool(2, "b", ["network.external"], "fixed_managed_service"), tool(3, "c", ["external.write"], None), tool(4, "d", ["network.external"], None), tool(4, "e", ["external.write"], None), tool(5, "f", ["data.read"], None)]
    tools = spark.createDataFrame(rows, fs.tools.schema)
    targets = spark.createDataFrame([(3, "c", "*", True), (4, "d", "api.example.com", True)], fs.destinations.schema)
    few = replace(fs, agents=agents, tools=tools, destinations=targets, mcp_servers=fs.mcp_servers.limit(0))
    names = {r.agent_key: r.name for r in agents.collect()}
    ids = {r.target_name: r.relationship_id for r in authority.tool_relationships(few).collect()}
    found = {r.agent: r.evidence for r in rules.agent_rules(few).filter("rule_id = 'NET002'").collect()}
    assert found == {names[1]: f"capabilities=network.external;authority_relationship={ids['a']}", names[4]: f"capabilities=external.write,network.external;authority_relationship={ids['e']}"}
    assert {r[0] for r in rules.REGISTRY} == set(rules.evaluated())
    quiet = replace(few, flows=fs.flows.limit(0), unbound_tools=fs.unbound_tools.limit(0), global_identities=fs.global_identities.limit(0))
    found = rules.evaluate(quiet)
    status = {r.risk: r.status for r in rules.by_risk(found).collect()}
    assert status["ASI06"] == status["ASI04"] == "no_mapped_findings" and status["ASI10"] == "not_assessed"
    assert {r.risk: r.status for r in rules.by_risk(found, disabled=("PATH007",)).collect()}["ASI06"] == "not_assessed"


def test_tools_and_identities_without_an_agent_are_found(spark):
    fs = facts(spark, SF)
    loose = fs.unbound_tools.filter("array_contains(caps, 'process.execute') and approval is not true").count()
    assert rules.tool_rules(fs).filter("agent is null").count() == loose > 0
    free = rules.identity_rules(fs).filter("agent is null")
    assert free.count() > 0 and free.filter("not startswith(subject, 'ga-')").count() == 0
    known = fs.global_identities.limit(1).select(F.lit(1).cast("long").alias("agent_key"), "name", "provider", "roles", "permissions", "oauth_scopes", "credential_source")
    linked = rules.identity_rules(replace(fs, identities=known.select(*fs.identities.columns)))
    name = known.first().name
    assert linked.filter(F.col("subject") == name).filter("agent is null").count() == 0


def test_reach_counts_pairs_not_paths(spark):
    # twelve diamonds on top of one another: 4096 paths, 25 agents
    names = [f"n{i}" for i in range(37)]
    edges = []
    for i in range(0, 36, 3):
        edges += [(i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3)]
    agents = spark.createDataFrame(list(enumerate(names)), "agent_key long, name string")
    delegations = spark.createDataFrame([(a, names[b]) for a, b in [*edges, (36, 36), (5, 0)]], "agent_key long, target string")
    step = {}
    for a, b in [*edges, (5, 0)]:
        step.setdefault(a, set()).add(b)
    want = set()
    for a in range(37):
        todo, seen = [a], set()
        while todo:
            for b in step.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(names[a], names[b]) for b in seen if b != a}
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert {(r.root, r.leaf) for r in closure.reachable(agents, delegations).collect()} == want
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_every_path_is_found_whatever_the_limit_on_recursive_rows(spark):
    # three diamonds on top of one another and a way back: more paths than the session lets a recursive query have
    edges = [(i + a, i + b) for i in (0, 3, 6) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))] + [(9, 3)]
    agents = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "agent_key long, name string")
    delegations = spark.createDataFrame([(a, f"n{b}") for a, b in edges], "agent_key long, target string")
    want, todo = set(), [(i,) for i in range(10)]
    while todo:
        path = todo.pop()
        want.add(path)
        todo += [(*path, b) for a, b in edges if a == path[-1] and b not in path]
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "20")
    try:
        found = closure.delegation_paths(agents, delegations).collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted((r.root, r.leaf, tuple(r.path)) for r in found) == sorted((f"n{p[0]}", f"n{p[-1]}", tuple(f"n{i}" for i in p)) for p in want)
    with pytest.raises(ValueError, match="deeper than 3 levels"):
        closure.delegation_paths(agents, delegations, max_depth=3)


def test_query_returns_every_path_to_a_tool(spark):
    fs = facts(spark, SF)
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "2")
    try:
        found = query.effective_authority(fs, capability="process.execute").count()
    finally:
        spark.conf.set(limit, before)
    tools = authority.relationships(fs).filter("array_contains(capabilities, 'process.execute')")
    assert found == tools.join(closure.delegation_paths(fs.agents, fs.delegations), F.col("leaf") == F.col("agent")).count() > 0


def test_query_broadcasts_no_paths_and_collects_no_sets(spark):
    # paths are written: by their files' size Spark would broadcast any number of them
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "1g")
    try:
        found = core.authority_query(spark, SF)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    nodes = [x.strip(" :+-") for x in plan.splitlines()]
    at = next(i for i, x in enumerate(nodes) if "Join" in x)
    assert nodes[at].startswith("SortMergeJoin [agent_key") and "collect_set" not in plan
    # tools come dealt by agent and stay in place: nothing is dealt by their names
    assert "hashpartitioning(target_name" not in plan and "hashpartitioning(owner_name" not in plan and ", owner_name" not in "".join(x for x in nodes if x.startswith("Exchange"))


def test_query_with_names_and_keys_that_recur(spark):
    # a name that recurs is on no path; a key that recurs under two names keeps each name's paths apart
    fs = facts(spark, SF)
    agents = fs.agents.filter("agent_key between 1 and 4").withColumn("name", F.expr("CASE WHEN agent_key = 4 THEN 'n3' ELSE concat('n', agent_key) END"))
    agents = agents.unionByName(agents.filter("agent_key = 2").withColumn("name", F.lit("twin")))
    tools = spark.createDataFrame([(k, f"t{k}", "generic", ["process.execute"], True, False, None, None) for k in (1, 2, 3, 4)], fs.tools.schema)
    delegations = spark.createDataFrame([(1, "n2"), (1, "twin"), (1, "n3")], fs.delegations.schema)
    found = query.effective_authority(replace(fs, agents=agents, tools=tools, delegations=delegations), capability="process.*").collect()
    want = [("n1", "n1", "t1"), ("n1", "n1 > n2", "t2"), ("n1", "n1 > twin", "t2"), ("n2", "n2", "t2"), ("twin", "twin", "t2")]
    assert sorted((r.root, r.path, r.target_name) for r in found) == want


def test_review_by_key_moves_no_relationships_and_agrees_with_the_general_one(spark):
    base, head = core._snapshots(spark, SF)
    b, h = authority.tool_relationships(base), authority.tool_relationships(head)
    changed = delta.result_delta(policy.evaluate(policy.observations(b), base.clauses), policy.evaluate(policy.observations(h), head.clauses))
    want = delta.security_review(delta.relationship_delta(b, h), changed)
    found = core.security_review(spark, SF)
    columns = ["relationship_id", "agent", "target_name", "change", "reasons", "violations"]
    assert found.columns == columns and sorted(found.collect()) == sorted(want.select(columns).collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(relationship_id" not in plan and "hashpartitioning(result_id" not in plan
    assert delta.keys_agree(base, head)
    twice = replace(head, tools=head.tools.unionByName(head.tools.limit(1)))
    assert not delta.keys_agree(base, twice)
    assert not delta.keys_agree(base, replace(head, agents=head.agents.withColumn("agent_key", F.col("agent_key") + 1)))
