"""Deployed authority: the workloads agents run as, the roles bound to them, and what these mean for contracts.

Conditional bindings never count as granted or as absent; whatever they decide is unresolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X

STATUSES = ("compliant", "violation", "unresolved", "not_configured", "not_constrained")
CONSTRAINED = ("identities", "iam_roles", "permissions")


def identities(workloads: DataFrame) -> DataFrame:
    """(relationship_id, agent, provider, workload_id, identity, account, unresolved): whom each workload runs as.

    `workloads`: (agent, provider, workload_id, identity). An identity that is no service account is unresolved.
    """
    account = X.service_account(F.col("identity"))
    missing = F.array_compact(F.array(F.when(F.col("identity").isNull(), F.lit("deployed_identity")), F.when(F.col("identity").isNotNull() & account.isNull(), F.lit("canonical_identity"))))
    key = X.stable_id("deployed-identity-v1:", F.col("agent"), F.col("workload_id"), F.coalesce("identity", F.lit("")))
    return workloads.select(key.alias("relationship_id"), "agent", "provider", "workload_id", "identity", account.alias("account"), missing.alias("unresolved"))


def authority(deployed: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per deployed identity: roles and permissions, unconditional and conditional, scopes, inheritance, what is unresolved.

    `bindings`: (account, role, scope, inherited_from nullable, conditional, permissions nullable). Roles whose permissions
    are unknown are unresolved roles.
    """
    rows = deployed.join(bindings, "account", "left")
    bound, loose = F.col("role").isNotNull(), ~F.coalesce("conditional", F.lit(False))
    known = F.col("permissions").isNotNull()
    names = lambda test, c: X.sorted_set(F.collect_set(F.when(test, F.col(c))))
    lists = lambda test: X.sorted_set(F.flatten(F.collect_set(F.when(test & known, F.col("permissions")))))
    out = rows.groupBy("relationship_id", "agent", "provider", "workload_id", "account", F.col("unresolved").alias("open")).agg(
        names(bound & loose, "role").alias("roles"), names(bound & ~loose, "role").alias("conditional_roles"), lists(bound & loose).alias("permissions"), lists(bound & ~loose).alias("conditional_permissions"),
        names(bound, "scope").alias("scopes"), names(bound, "inherited_from").alias("inherited_from"), names(bound & ~known, "role").alias("unresolved_roles"), F.count("role").alias("bindings"),
    )
    more = F.array(
        F.when(F.col("bindings") == 0, F.lit("iam_bindings")), F.when(F.size("unresolved_roles") > 0, F.lit("permissions")),
        F.when(F.size("conditional_roles") > 0, F.lit("iam_condition_applicability")),
    )
    out = out.withColumn("unresolved", X.sorted_set(F.concat("open", F.array_compact(more)))).drop("open", "bindings")
    return out.withColumn("resolution", F.when(F.size("unresolved") == 0, "fully_resolved").otherwise("partially_resolved"))


def policy(deployed: DataFrame, clauses: DataFrame, agents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, statuses) of contracts over deployed authority, for identities, roles and permissions alone.

    `clauses`: (agent, mode, dimension, pattern), `agents`: (agent) that have a contract at all. What only a conditional
    binding gives is unresolved where it would be a violation.
    """
    mine = clauses.filter(F.col("dimension").isin(*CONSTRAINED))
    values = F.array(
        F.struct(F.lit("identities").alias("dimension"), F.lit(False).alias("conditional"), F.array("account").alias("v")),
        F.struct(F.lit("iam_roles").alias("dimension"), F.lit(False).alias("conditional"), F.col("roles").alias("v")),
        F.struct(F.lit("iam_roles").alias("dimension"), F.lit(True).alias("conditional"), F.col("conditional_roles").alias("v")),
        F.struct(F.lit("permissions").alias("dimension"), F.lit(False).alias("conditional"), F.col("permissions").alias("v")),
        F.struct(F.lit("permissions").alias("dimension"), F.lit(True).alias("conditional"), F.col("conditional_permissions").alias("v")),
    )
    seen = deployed.select("relationship_id", "agent", F.explode(values).alias("x")).select("relationship_id", "agent", "x.dimension", "x.conditional", F.explode("x.v").alias("value")).filter("value is not null")
    # a pattern meets a value once, however many relationships show it
    pairs = seen.select("agent", "dimension", "value").distinct().join(mine, ["agent", "dimension"])
    pairs = pairs.groupBy("agent", "dimension", "value", "mode").agg(F.max(F.regexp_like("value", X.glob_column(F.col("pattern")))).alias("hit"))
    bad = pairs.filter(((F.col("mode") == "deny") & F.col("hit")) | ((F.col("mode") == "allow") & ~F.col("hit")))
    prefix = F.when(F.col("conditional"), "conditional_").otherwise("")
    reason = F.when(F.col("mode") == "deny", F.concat(prefix, F.lit("denied_"), "dimension", F.lit("_observed"))).otherwise(F.concat(prefix, "dimension", F.lit("_outside_allowlist")))
    results = seen.join(bad, ["agent", "dimension", "value"]).groupBy("relationship_id", "agent", "mode", "dimension", "conditional").agg(F.array_join(X.sorted_set(F.collect_set("value")), ",").alias("observed"))
    results = results.select(
        "relationship_id", "agent", F.concat_ws(".", "mode", "dimension").alias("clause"), "dimension", F.when(F.col("conditional"), "unresolved").otherwise("violation").alias("status"), reason.alias("reason"), "observed"
    )
    worst = results.groupBy("relationship_id").agg(F.max((F.col("status") == "violation").cast("int")).alias("bad"))
    own = agents.select("agent").distinct().withColumn("configured", F.lit(True))
    limited = mine.select("agent").distinct().withColumn("constrained", F.lit(True))
    rows = deployed.join(own, "agent", "left").join(limited, "agent", "left").join(worst, "relationship_id", "left")
    status = (
        F.when(F.col("configured").isNull(), "not_configured").when(F.col("constrained").isNull(), "not_constrained").when(F.col("bad") == 1, "violation")
        .when((F.col("bad") == 0) | (F.size("unresolved") > 0), "unresolved").otherwise("compliant")
    )
    return results, rows.select("relationship_id", "agent", status.alias("status"))


def policy_summary(results: DataFrame, statuses: DataFrame) -> DataFrame:
    """(kind, n): relationships by status, all five, and results by theirs."""
    each = statuses.sparkSession.createDataFrame([(s,) for s in STATUSES], "kind string")
    counts = statuses.groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("n"))
    by_result = results.groupBy(F.concat("status", F.lit("_results")).alias("kind")).agg(F.count("*").alias("n"))
    more = statuses.sparkSession.createDataFrame([("violation_results",), ("unresolved_results",)], "kind string").join(by_result, "kind", "left")
    return each.join(counts, "kind", "left").unionByName(more).select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def wired_requirements(evidence: DataFrame, wiring: DataFrame, workloads: DataFrame) -> DataFrame:
    """(agent, role): roles that application code and infrastructure together ask for.

    `evidence`: (family) of client libraries used by the application, `wiring`: (account_id, family, role) of services that
    the infrastructure connects to an account, `workloads`: (agent, account). Account ids meet the local part of accounts.
    """
    local = F.substring_index("account", "@", 1)
    asked = wiring.join(evidence.select("family").distinct(), "family", "left_semi")
    return workloads.filter("account is not null").withColumn("account_id", local).join(asked, "account_id").select("agent", "role").distinct()


def with_requirements(required: DataFrame, wired: DataFrame) -> DataFrame:
    """`required` (agent, roles, permissions, incomplete: array) with wired roles added; `required_roles` is no gap then."""
    extra = wired.groupBy("agent").agg(F.collect_set("role").alias("more"))
    rows = required.join(extra, "agent", "left")
    roles = F.when(F.col("more").isNull(), F.col("roles")).otherwise(X.sorted_set(F.concat("roles", "more")))
    left = F.when(F.col("more").isNull(), F.col("incomplete")).otherwise(F.array_remove("incomplete", "required_roles"))
    return rows.withColumns({"roles": roles, "incomplete": left}).drop("more")


def certificates(agents: DataFrame, blockers: DataFrame) -> DataFrame:
    """(agent, complete, blockers): whether absence of a requirement could be certified. A measurement: nothing else reads it.

    `agents`: (agent, provider); `blockers`: (agent nullable, blocker): dynamic imports, parse failures and the like, a
    null agent blocks all.
    """
    # kept apart, as a join on "this agent or none" would be a nested loop
    general = blockers.filter("agent is null").agg(X.sorted_set(F.collect_set("blocker")).alias("general"))
    own = blockers.filter("agent is not null").groupBy("agent").agg(F.collect_set("blocker").alias("own"))
    rows = agents.join(own, "agent", "left").crossJoin(F.broadcast(general))  # one row
    every = X.sorted_set(F.concat(F.coalesce("own", F.array().cast("array<string>")), "general"))
    return rows.select("agent", ((F.col("provider") == "gcp") & (F.size(every) == 0)).alias("complete"), every.alias("blockers"))


def declared_roles(known: DataFrame, grants: DataFrame) -> DataFrame:
    """`known` (account, roles) with the roles that another repository's infrastructure declares for accounts known here."""
    extra = grants.withColumn("account", X.service_account(F.col("principal"))).filter("account is not null and role is not null").groupBy("account").agg(F.collect_set("role").alias("more"))
    return known.join(extra, "account", "left").withColumn("roles", X.sorted_set(F.concat("roles", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")


def report(deployed: DataFrame, reconciled: DataFrame, certified: DataFrame, statuses: DataFrame, drift: DataFrame) -> DataFrame:
    """One row per agent: deployed resolution, reconciliation, certificate, policy status and drift side by side."""
    worst = lambda df, by: df.groupBy("agent").agg(F.max(by).alias("x"))
    order = F.array(*[F.lit(s) for s in ("compliant", "not_constrained", "not_configured", "unresolved", "violation")])
    ranked = worst(statuses, F.array_position(order, F.col("status"))).select("agent", F.get(order, (F.col("x") - 1).cast("int")).alias("policy"))
    resolved = deployed.groupBy("agent").agg(F.count("*").alias("identities"), F.min((F.col("resolution") == "fully_resolved")).alias("deployed_resolved"))
    rows = resolved.join(reconciled.select("agent", F.col("status").alias("reconciliation")), "agent", "full").join(certified.select("agent", "complete"), "agent", "left")
    return rows.join(ranked, "agent", "left").join(drift.select("agent", "regressed"), "agent", "left")


def summary(deployed: DataFrame) -> DataFrame:
    """One row: relationships, agents, accounts, and how many are resolved, conditional, inherited or without bindings."""
    return deployed.agg(
        F.count("*").alias("relationships"), F.count_distinct("agent").alias("agents"), F.count_distinct("account").alias("accounts"),
        F.count_if(F.col("resolution") == "fully_resolved").alias("fully_resolved"), F.count_if(F.size("conditional_roles") > 0).alias("with_conditions"),
        F.count_if(F.size("inherited_from") > 0).alias("with_inheritance"), F.count_if(F.array_contains("unresolved", "iam_bindings")).alias("without_bindings"),
    )
