"""The dependency graph of the facts: typed nodes and edges with stable ids, inventories, and roots of a call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X
from grantscope.operators import closure

# The node kinds an inventory lists, zero-filled.
NODE_KINDS = ("agent", "tool", "mcp_server", "identity", "network_destination", "data_resource", "input", "model", "prompt", "memory")


def node_id(kind: str, *parts) -> F.Column:
    return X.stable_id("adg-node-v1:", F.lit(kind), *parts, digits=24)


def nodes(fs) -> DataFrame:
    """(id, kind, name): one row per node; a shared destination, input or identity name of an agent is its own node."""
    agent = fs.agents.select("agent_key", F.col("name").alias("agent"))
    owned = lambda df, kind, name: df.join(agent, "agent_key").select(node_id(kind, F.col("agent"), F.col(name)).alias("id"), F.lit(kind).alias("kind"), F.concat_ws(":", "agent", name).alias("name"))
    out = fs.agents.select(node_id("agent", F.col("name")).alias("id"), F.lit("agent").alias("kind"), "name")
    for df, kind, name in ((fs.tools, "tool", "name"), (fs.mcp_servers, "mcp_server", "name"), (fs.identities, "identity", "name"), (fs.inputs, "input", "name")):
        out = out.unionByName(owned(df, kind, name))
    for df, kind, name in ((fs.destinations, "network_destination", "target"), (fs.resources, "data_resource", "selector")):
        out = out.unionByName(df.select(node_id(kind, F.col(name)).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name")))
    return out.distinct()


def edges(fs) -> DataFrame:
    """(id, kind, source, target) over the nodes' ids."""
    agent = fs.agents.select("agent_key", F.col("name").alias("agent"))
    me = node_id("agent", F.col("agent"))

    def link(df, kind, source, target):
        return df.select(F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"))

    own = lambda df: df.join(agent, "agent_key")
    tool = lambda name: node_id("tool", F.col("agent"), F.col(name))
    used = own(fs.tools).filter("identity is not null").join(fs.identities.select("agent_key", F.col("name").alias("identity")).distinct(), ["agent_key", "identity"])
    reach = closure.reachable_identities(fs)
    parts = [
        link(own(fs.tools), "INVOKES", me, tool("name")),
        link(own(fs.mcp_servers), "INVOKES", me, node_id("mcp_server", F.col("agent"), F.col("name"))),
        link(used, "USES_IDENTITY", tool("name"), node_id("identity", F.col("agent"), F.col("identity"))),
        link(own(fs.destinations), "CONNECTS_TO", tool("owner_name"), node_id("network_destination", F.col("target"))),
        link(own(fs.resources), "READS_FROM", tool("owner_name"), node_id("data_resource", F.col("selector"))),
        link(own(fs.inputs), "RECEIVES_INPUT_FROM", me, node_id("input", F.col("agent"), F.col("name"))),
        link(closure.edges(fs.agents, fs.delegations), "DELEGATES_TO", node_id("agent", F.col("parent")), node_id("agent", F.col("child"))),
        link(reach, "CAN_REACH_AUTHORITY", me, node_id("identity", F.col("leaf"), F.col("identity"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct().withColumn("id", X.stable_id("adg-edge-v1:", "kind", "source", "target", digits=24)).select("id", "kind", "source", "target")


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def inventory(rows: DataFrame) -> DataFrame:
    """Counts of every node kind an inventory lists, zeros included."""
    kinds = rows.sparkSession.createDataFrame([(k,) for k in NODE_KINDS], "kind string")
    return kinds.join(kind_counts(rows), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def dangling(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Edges with an end that is no node; an intact graph has none."""
    ids = node_rows.select("id")
    ends = edge_rows.select("id", F.explode(F.array("source", "target")).alias("end"))
    return ends.join(ids.withColumnRenamed("id", "end"), "end", "left_anti").select("id").distinct()


def call_roots(calls: DataFrame, sinks: DataFrame, depth: int = 8) -> DataFrame:
    """(sink, root, chain, truncated): chains from functions nobody calls to each sink, cycles cut, at most `depth` calls.

    A chain that is cut by the depth names its last function as root and says truncated.
    """
    spark = calls.sparkSession
    calls.select("caller", "callee").distinct().createOrReplaceTempView("gs_calls")
    sinks.select("function").distinct().createOrReplaceTempView("gs_sinks")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "100")
    found = spark.sql(f"""
        WITH RECURSIVE up(sink, root, chain) AS (
          SELECT function, function, array(function) FROM gs_sinks
          UNION ALL
          SELECT u.sink, c.caller, array_prepend(u.chain, c.caller) FROM up u JOIN gs_calls c ON c.callee = u.root WHERE size(u.chain) <= {int(depth)} AND NOT array_contains(u.chain, c.caller))
        SELECT * FROM up""")
    called = calls.select(F.col("callee").alias("root")).distinct().withColumn("called", F.lit(True))
    return found.join(called, "root", "left").filter((F.col("called").isNull()) | (F.size("chain") > depth)).select("sink", "root", "chain", F.col("called").isNotNull().alias("truncated"))


def representative(entrypoints: DataFrame, most: int = 32) -> DataFrame:
    """At least one entrypoint of each kind, then by order up to `most` for each sink: (sink, kind, ordinal, ...)."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("sink", "kind").orderBy("ordinal"))
    rank = F.row_number().over(Window.partitionBy("sink").orderBy((F.col("_k") > 1).cast("int"), "ordinal"))
    return entrypoints.withColumn("_k", first).withColumn("_r", rank).filter(F.col("_r") <= most).drop("_k", "_r")
