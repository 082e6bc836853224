"""The interactive query: relationships, by any path of delegation that leads to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X
from grantscope.operators import authority, closure


def _like(value, pattern: str):
    return F.coalesce(F.lower(value).rlike(X.glob_regex(pattern.lower())), F.lit(False))


def effective_authority(fs, *, agent=None, capability=None, target=None, destination=None, identity=None, resolution=None) -> DataFrame:
    """Rows of relationship x delegation path. Filters are case-insensitive globs; `agent` is the path's root.

    At least one filter other than `agent` is required.
    """
    if not any((capability, target, destination, identity, resolution)):
        raise ValueError("a capability, target, destination, identity or resolution is required")
    rows = authority.relationships(fs)
    # the relationship filters come before the join with the paths
    if capability:
        rows = rows.filter(F.exists("capabilities", lambda c: _like(c, capability)))
    if target:
        rows = rows.filter(_like(F.col("target_name"), target) | _like(F.concat_ws(":", "target_kind", "target_name"), target))
    if destination:
        rows = rows.filter(F.exists(F.coalesce("targets", F.array().cast("array<string>")), lambda t: _like(t, destination)))
    if identity:
        rows = rows.filter(F.col("who").isNotNull() & _like(F.col("identity"), identity))
    if resolution:
        rows = rows.filter(F.col("resolution") == resolution)
    paths = closure.delegation_paths(fs.agents, fs.delegations).withColumnRenamed("leaf", "agent")
    if agent:
        paths = paths.filter(_like(F.col("root"), agent))
    # lists become text before the join, once per path and relationship; names on paths are unique, so that the key
    # joined besides changes nothing, and rows dealt by agent stay in place. Written paths are many times their files'
    # size, which Spark would go by in broadcasting them: never
    keyed = fs.agents.select("agent_key", F.col("name").alias("agent"))
    paths = paths.withColumn("path", F.array_join("path", " > ")).hint("merge").join(keyed, "agent")
    rows = rows.select("agent_key", "agent", "target_kind", "target_name", "relationship_id", "resolution", F.array_join("capabilities", ",").alias("capabilities"))
    found = rows.join(paths.hint("merge"), ["agent_key", "agent"])
    return found.select("root", "path", "agent", "target_kind", "target_name", "relationship_id", "resolution", "capabilities")


def query_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("paths"), F.countDistinct("relationship_id").alias("relationships"), F.countDistinct("agent").alias("agents"), F.count_if(F.col("root") != F.col("agent")).alias("delegated_paths"))
