"""Delegation: paths, reachable authority, and authority propagated from children to parents.

Only agents whose name is unique take part; a cycle is cut where a name would recur on a path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X
from grantscope.functions.cuts import cut

MAX_DEPTH = 100


def edges(agents: DataFrame, delegations: DataFrame) -> DataFrame:
    """(parent, child) names, both unambiguous."""
    named = agents.groupBy("name").agg(F.count("*").alias("n"), F.first("agent_key").alias("agent_key")).filter("n = 1")
    parents = named.select("agent_key", F.col("name").alias("parent"))
    return delegations.join(parents, "agent_key").join(named.select(F.col("name").alias("target")), "target").select("parent", F.col("target").alias("child")).distinct()


def delegation_paths(agents: DataFrame, delegations: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, leaf, path): every simple path, the root itself included; an error past `max_depth` levels.

    A round per step, each written before the next: a recursive query has a limit on its rows that Spark reads when
    the query runs, out of reach of an operator. Paths can be many more than agents; reachable() doesn't go through them.
    """
    step = cut(edges(agents, delegations), "delegation-edges")
    names = agents.groupBy("name").count().filter("count = 1")
    fresh = cut(names.select(F.col("name").alias("root"), F.col("name").alias("leaf"), F.array("name").alias("path")), "delegation-paths")
    found = [fresh]
    for _ in range(max_depth):
        longer = fresh.join(step, fresh.leaf == step.parent).filter(~F.array_contains("path", F.col("child")))
        fresh = cut(longer.select("root", F.col("child").alias("leaf"), F.array_append("path", F.col("child")).alias("path")), "delegation-paths")
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(fresh)
    raise ValueError(f"delegation goes deeper than {max_depth} levels")


def reachable(agents: DataFrame, delegations: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, leaf) pairs of delegated reach, the root itself excluded.

    Each round joins only the pairs that the last one found, and keeps those not yet known: pairs, not paths, so
    that many ways between two agents cost no more than one. Rounds end when nothing is new.
    """
    step = edges(agents, delegations).filter("parent <> child")
    known = fresh = step.select(F.col("parent").alias("root"), F.col("child").alias("leaf")).checkpoint()
    for _ in range(max_depth):
        found = fresh.join(step, fresh.leaf == step.parent).select("root", F.col("child").alias("leaf")).filter("root <> leaf").distinct()
        fresh = found.join(known, ["root", "leaf"], "left_anti").checkpoint()
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise ValueError(f"delegation goes deeper than {max_depth} levels")


def reachable_identities(fs) -> DataFrame:
    """(agent, identity): the identities of agents it can delegate to, over any number of steps."""
    keyed = fs.agents.select("agent_key", F.col("name").alias("leaf"))
    return reachable(fs.agents, fs.delegations).join(keyed, "leaf").join(fs.identities.select("agent_key", F.col("name").alias("identity")), "agent_key").select(F.col("root").alias("agent"), "leaf", "identity").distinct()


def propagated(fs) -> DataFrame:
    """One synthetic tool for each parent and child: what the child's subtree, without the parent, could do for it.

    It uses the facts as they were before propagation. approval is true only if every privileged tool below is
    approved; network_scope is fixed only if every outbound tool below is so.
    """
    below = reachable(fs.agents, fs.delegations).unionByName(fs.agents.select(F.col("name").alias("root"), F.col("name").alias("leaf")))
    pairs = edges(fs.agents, fs.delegations).join(below.withColumnRenamed("root", "child"), "child").filter("leaf <> parent").select("parent", "child", "leaf")
    keyed = fs.agents.select("agent_key", F.col("name").alias("leaf"))
    tools = fs.tools.join(keyed, "agent_key").select("leaf", "caps", "approval", "network_scope")
    # a leaf's tools are summed up once, then joined to all who reach it
    privileged, outbound = X.any_of(F.col("caps"), X.PRIVILEGED), X.any_of(F.col("caps"), X.OUTBOUND)
    fixed = F.coalesce(F.col("network_scope").isin("fixed_managed_service", "explicit_destination"), F.lit(False))
    sums = tools.groupBy("leaf").agg(F.array_distinct(F.flatten(F.collect_set("caps"))).alias("caps"), F.count_if(privileged & ~X.is_true(F.col("approval"))).alias("loose"), F.count_if(privileged).alias("privileged"), F.count_if(outbound).alias("outbound"), F.count_if(outbound & ~fixed).alias("free"))
    out = pairs.join(sums, "leaf", "left").groupBy("parent", "child").agg(
        F.flatten(F.collect_set("caps")).alias("caps"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("loose", "privileged", "outbound", "free")]
    )
    return out.select(
        F.col("parent").alias("agent"), F.concat(F.lit("delegate:"), "child").alias("name"), X.sorted_set(F.concat("caps", X.strings(("agent.delegate",)))).alias("caps"),
        F.when(F.col("privileged") > 0, F.col("loose") == 0).alias("approval"), F.when((F.col("outbound") > 0) & (F.col("free") == 0), F.lit("fixed_managed_service")).alias("network_scope"),
    )
