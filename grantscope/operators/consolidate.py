"""Consolidation of facts found in several places, and resolution of references that must be unique.

Merges that depend on order take it from an explicit `ordinal`, so that partitioning can't change them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X


def merged_approval(c="approval"):
    """False is sticky, then true, then unknown: an aggregate."""
    return F.when(F.max(X.is_false(F.col(c))), False).when(F.max(X.is_true(F.col(c))), True)


def _union(c: str):
    return X.sorted_set(F.flatten(F.collect_set(c))).alias(c)


def merge_tools(tools: DataFrame) -> DataFrame:
    """One row per (agent_key, name): capabilities united, approval false-sticky, guardrails or-ed, a specific kind over generic."""
    specific = F.min_by(F.when(F.col("kind") != "generic", F.col("kind")), F.when(F.col("kind") != "generic", F.col("ordinal")))
    return tools.groupBy("agent_key", "name").agg(_union("caps"), merged_approval().alias("approval"), F.max("guardrails").alias("guardrails"), F.coalesce(specific, F.lit("generic")).alias("kind"))


def merge_identities(identities: DataFrame) -> DataFrame:
    """One row per (name, provider): sets united; the last known scalar wins."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    return identities.groupBy("name", "provider").agg(*[_union(c) for c in ("roles", "permissions", "oauth_scopes")], last("credential_source"), last("resource_scope"))


def first_servers(servers: DataFrame) -> DataFrame:
    """One row per (agent_key, name): the first found stays as it is."""
    rest = [c for c in servers.columns if c not in ("agent_key", "name")]
    return servers.groupBy("agent_key", "name").agg(F.min_by(F.struct(*rest), "ordinal").alias("s")).select("agent_key", "name", "s.*")


def resolve_unique(references: DataFrame, candidates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved): references joined to their candidate if exactly one has the key; else how many have."""
    counts = candidates.groupBy(key).agg(F.count("*").alias("candidates"))
    known = candidates.join(counts.filter("candidates = 1"), key, "left_semi")
    return references.join(known, key), references.join(counts, key, "left").filter("candidates is null or candidates > 1").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def nearest_scope(references: DataFrame, scopes: DataFrame) -> DataFrame:
    """References (ref_id, name, dir) to declarations (name, scope_dir, target): the deepest enclosing scope wins, if it is one.

    An equi-join on name with every ancestor of dir, so no theta join.
    """
    ancestors = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda n: F.array_join(F.slice(F.split("dir", "/"), 1, n), "/"))
    each = references.select("ref_id", "name", F.posexplode(ancestors).alias("depth", "scope_dir"))
    found = each.join(scopes, ["name", "scope_dir"]).groupBy("ref_id", "depth").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    return found.groupBy("ref_id").agg(F.max_by(F.struct("n", "target"), "depth").alias("x")).filter("x.n = 1").select("ref_id", "x.target")


def dedupe_diagnostics(diagnostics: DataFrame, most: int = 1000) -> DataFrame:
    """Distinct (kind, path, line, message); more than `most` is an error, not a truncation."""
    out = diagnostics.dropDuplicates(["kind", "path", "line", "message"])
    if out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} diagnostics")
    return out


def flow_summaries(local: DataFrame, calls: DataFrame, rounds: int = 8) -> DataFrame:
    """Interprocedural taint: sources that reach each function, by joining local facts over call edges until nothing is new.

    `local`: (function, source); `calls`: (caller, callee), a callee's result flows to its caller. Each round joins only
    what the last one added; rounds are bounded and what is still moving after them is marked by settled = false.
    """
    known = fresh = local.select("function", "source").distinct().checkpoint()
    moving = True
    for _ in range(rounds):
        step = calls.join(fresh, calls.callee == fresh.function).select(F.col("caller").alias("function"), "source").distinct()
        fresh = step.join(known, ["function", "source"], "left_anti").checkpoint()
        moving = fresh.limit(1).count() > 0
        if not moving:
            break
        known = known.unionByName(fresh)
    return known.withColumn("settled", F.lit(not moving))
