"""Relationships of agents to tools and servers: what is resolved, what is not, and how far it reaches.

A relationship is a row of agent x target with its capabilities, identity, approval, resources and destinations, a
status for each of these dimensions, and the sorted list of what is unresolved. Unknown never turns into safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X

EMPTY = "array<string>"
STATUSES = ("fully_resolved", "partially_resolved", "unknown")


def _known(c) -> F.Column:
    return F.when(c, "resolved").otherwise("unknown")


def _no_strings():
    return F.array().cast(EMPTY)


def _identified(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """Left join of the agent's identity by name, the first where a name recurs."""
    own = identities.groupBy("agent_key", F.col("name").alias("identity")).agg(F.min(F.struct("provider", "roles", "permissions", "oauth_scopes", "credential_source")).alias("who"))
    return rows.join(own, ["agent_key", "identity"], "left")


def _scoped(rows: DataFrame, resources: DataFrame, destinations: DataFrame) -> DataFrame:
    # counts say that there are any: a query that reads no more of them collects no sets
    held = resources.groupBy("agent_key", F.col("owner_name").alias("target_name")).agg(F.count("*").alias("n_selectors"), X.sorted_set(F.collect_set("selector")).alias("selectors"), F.max(F.col("classification").isin(*X.SENSITIVE_CLASSES)).alias("sensitive"))
    reach = destinations.groupBy("agent_key", F.col("owner_name").alias("target_name")).agg(X.sorted_set(F.collect_set("target")).alias("targets"), F.count("*").alias("n_targets"), F.sum((~F.col("restricted")).cast("int")).alias("unrestricted"))
    return rows.join(held, ["agent_key", "target_name"], "left").join(reach, ["agent_key", "target_name"], "left")


def _finish(rows: DataFrame, dimensions: dict, unresolved: list[tuple]) -> DataFrame:
    """Add dimensions (a map), unresolved (sorted) and resolution."""
    pairs = [v for k, c in dimensions.items() for v in (F.lit(k), c)]
    open_ = F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in unresolved])))
    out = rows.withColumn("dimensions", F.create_map(*pairs)).withColumn("unresolved", open_)
    some = F.exists(F.map_values("dimensions"), lambda v: v == "resolved")
    return out.withColumn("resolution", F.when(F.size("unresolved") == 0, STATUSES[0]).when(some, STATUSES[1]).otherwise(STATUSES[2]))


_COLUMNS = ("relationship_id", "agent_key", "agent", "target_kind", "target_name", "kind", "capabilities", "identity", "who", "approval", "guardrails", "inherited_control", "tool_scope", "selectors", "sensitive", "targets", "n_targets", "unrestricted", "network_scope", "dimensions", "unresolved", "resolution")


def tool_relationships(fs) -> DataFrame:
    agents = fs.agents.select("agent_key", F.col("name").alias("agent"), (F.col("approval_plugin") | F.col("before_tool_callback")).alias("inherited_control"))
    rows = fs.tools.withColumnsRenamed({"name": "target_name", "caps": "capabilities"}).join(agents, "agent_key")
    rows = _scoped(_identified(rows, fs.identities), fs.resources, fs.destinations)
    approved = F.col("approval").isNotNull() | F.col("guardrails") | F.col("inherited_control")
    named, sourced = F.col("who").isNotNull(), F.col("who.credential_source").isNotNull()
    caps, resources, targets = F.size("capabilities") > 0, F.col("n_selectors").isNotNull(), F.col("n_targets").isNotNull()
    dimensions = {
        "target": F.lit("resolved"), "capabilities": _known(caps), "identity": F.when(named & ~sourced, "partially_resolved").otherwise(_known(named)),
        "approval": _known(approved), "resources": _known(resources), "destinations": _known(targets),
    }
    open_ = [("capabilities", ~caps), ("identity", ~named), ("credential_source", named & ~sourced), ("approval", ~approved), ("resources", ~resources), ("destinations", ~targets)]
    rows = rows.withColumns({"target_kind": F.lit("tool"), "tool_scope": F.lit(None).cast("string"), "relationship_id": X.stable_id("authority-v1:", F.col("agent"), F.lit("tool"), F.col("target_name"))})
    return _finish(rows, dimensions, open_).select(*_COLUMNS)


def server_scope() -> F.Column:
    return (
        F.when(F.size("allowed_tools") > 0, "explicit_allowlist")
        .when(F.size("denied_tools") > 0, "denylist_only")
        .when(F.col("dynamic_tool_filter"), "dynamic_filter")
        .otherwise("unrestricted_or_unknown")
    )


def server_relationships(fs) -> DataFrame:
    agents = fs.agents.select("agent_key", F.col("name").alias("agent"))
    rows = fs.mcp_servers.withColumnRenamed("name", "target_name").join(agents, "agent_key")
    rows = _identified(rows, fs.identities)
    remote, local = F.coalesce(F.col("url") != "", F.lit(False)), F.coalesce(F.col("command") != "", F.lit(False))
    target = F.when(remote, F.col("url")).when(local, F.col("command"))
    rows = rows.withColumns(
        {
            "tool_scope": server_scope(), "target_kind": F.lit("mcp_server"), "kind": F.col("transport"), "inherited_control": F.lit(False), "network_scope": F.lit(None).cast("string"),
            "capabilities": F.when(remote, X.strings(("mcp.remote", "network.external"))).otherwise(X.strings(("mcp.local",))),
            "selectors": F.lit(None).cast(EMPTY), "sensitive": F.lit(None).cast("boolean"), "targets": F.when(target.isNotNull(), F.array(target)), "n_targets": target.isNotNull().cast("long"), "unrestricted": F.lit(0).cast("long"),
            "relationship_id": X.stable_id("authority-v1:", F.col("agent"), F.lit("mcp_server"), F.col("target_name")),
        }
    )
    approved = F.col("approval").isNotNull() | F.col("guardrails")
    named, sourced = F.col("who").isNotNull(), F.col("who.credential_source").isNotNull()
    scope = F.col("tool_scope")
    dimensions = {
        "target": F.lit("resolved"), "capabilities": F.lit("resolved"), "identity": F.when(named & ~sourced, "partially_resolved").otherwise(_known(named)), "approval": _known(approved),
        "resources": F.lit("unknown"), "destinations": _known(target.isNotNull()),
        "tool_scope": F.when(scope == "explicit_allowlist", "resolved").when(scope == "unrestricted_or_unknown", "unknown").otherwise("partially_resolved"),
    }
    open_ = [("tool_catalogue", scope != "explicit_allowlist"), ("tool_filter", scope == "dynamic_filter"), ("identity", ~named), ("credential_source", named & ~sourced), ("approval", ~approved), ("resources", F.lit(True)), ("destinations", target.isNull())]
    return _finish(rows, dimensions, open_).select(*_COLUMNS)


def relationships(fs) -> DataFrame:
    """All relationships; order (agent, target_kind, target_name, relationship_id) is for the sink to impose."""
    return tool_relationships(fs).unionByName(server_relationships(fs))


def summary(rows: DataFrame) -> DataFrame:
    """One row of conditional counts."""
    known = lambda d: F.count_if(F.col("dimensions")[d] == "resolved")
    return rows.agg(
        F.count("*").alias("relationships"), F.count_if(F.col("target_kind") == "tool").alias("tool_relationships"), F.count_if(F.col("target_kind") == "mcp_server").alias("mcp_relationships"),
        *[F.count_if(F.col("resolution") == s).alias(f"{s}_relationships") for s in STATUSES], F.count_if(F.col("who").isNotNull()).alias("relationships_with_identity"),
        known("approval").alias("relationships_with_approval_evidence"), known("destinations").alias("relationships_with_destination_evidence"), known("resources").alias("relationships_with_resource_evidence"),
    )


def unresolved_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("unresolved").alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n"))


def resolution_ratio(rows: DataFrame) -> DataFrame:
    """Status counts and the share that is fully resolved, half-even to 6 digits, 1 where there are none."""
    counts = rows.agg(F.count("*").alias("relationships"), *[F.count_if(F.col("resolution") == s).alias(s) for s in STATUSES])
    return counts.withColumn("resolution_ratio", F.when(F.col("relationships") == 0, 1.0).otherwise(F.bround(F.col(STATUSES[0]) / F.col("relationships"), 6)))


# Order of the boundary classes of a family, from least to most authority (control: from strongest).
BOUNDARY_RANKS = {
    "mutation": ("no_mutation", "local_session_mutation", "internal_mutation_unspecified", "persistent_internal_mutation", "external_side_effect", "destructive_mutation", "security_identity_sensitive_mutation"),
    "network": ("no_external_network", "fixed_destination", "provider_constrained_destination", "internet_retrieval", "arbitrary_egress"),
    "identity": ("workload_service_identity", "oauth_delegated_authority", "iam_authority", "broad_privileged_authority"),
    "mcp_scope": ("explicit_allowlist", "denylist_only"),
    "control": ("mandatory_approval", "guardrail_control", "explicitly_no_approval"),
}


def boundaries(rows: DataFrame) -> DataFrame:
    """(relationship_id, family, class): the trust boundary of a relationship in each of five families."""
    caps = F.col("capabilities")
    has = lambda c: F.array_contains(caps, c)
    mutation = X.mutation_semantics(caps, F.col("target_name"), F.col("kind"))
    network = X.network_semantics(caps, F.col("network_scope"), F.coalesce("n_targets", F.lit(0)), F.coalesce("unrestricted", F.lit(0)))
    unknown = F.size(caps) == 0
    families = {
        "mutation": F.when(has("identity.admin"), "security_identity_sensitive_mutation").when(has("destructive.write"), "destructive_mutation").when((mutation == "external_side_effect") | has("external.write"), "external_side_effect")
        .when(mutation == "persistent_internal_write", "persistent_internal_mutation").when(mutation == "local_session_state_write", "local_session_mutation").when(has("data.write"), "internal_mutation_unspecified")
        .when(has("process.execute") | has("computer.control") | (F.col("target_kind") == "mcp_server") | unknown, "unknown").otherwise("no_mutation"),
        "network": F.when(unknown, "unknown").when(~has("network.external"), "no_external_network").when(network == "arbitrary_egress", "arbitrary_egress").when(network == "arbitrary_internet_retrieval", "internet_retrieval")
        .when(network == "fixed_provider_network", "provider_constrained_destination").when(F.col("targets").isNotNull() & (F.col("unrestricted") == 0), "fixed_destination").otherwise("unknown"),
        "identity": F.when(F.col("who").isNull(), "unknown")
        .when(F.exists("who.roles", X.role_looks_admin) | F.exists("who.permissions", X.permission_is_wildcard) | X.any_of(F.col("who.oauth_scopes"), X.BROAD_OAUTH), "broad_privileged_authority")
        .when((F.size("who.roles") > 0) | (F.size("who.permissions") > 0), "iam_authority").when(F.size("who.oauth_scopes") > 0, "oauth_delegated_authority").otherwise("workload_service_identity"),
        "control": F.when(X.is_true(F.col("approval")), "mandatory_approval").when(F.col("guardrails") | F.col("inherited_control"), "guardrail_control").when(X.is_false(F.col("approval")), "explicitly_no_approval").otherwise("unknown"),
        "mcp_scope": F.when(F.col("target_kind") != "mcp_server", "not_applicable").when(F.col("tool_scope") == "dynamic_filter", "dynamic_scope").when(F.col("tool_scope") == "unrestricted_or_unknown", "unknown").otherwise(F.col("tool_scope")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), c.alias("class")) for k, c in families.items()])).alias("b")
    return rows.select("relationship_id", "agent", "target_name", each).select("relationship_id", "agent", "target_name", "b.family", "b.class")
