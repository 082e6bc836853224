"""Required against deployed authority, per agent.

What is deployed beyond the required counts only where the required is known completely; what is missing always
counts. A required role is met by itself or, on Google Cloud, by a role known to include it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Roles that include a role.
ROLE_SUPERSETS = {
    "roles/bigquery.dataViewer": ("roles/bigquery.dataEditor", "roles/bigquery.dataOwner", "roles/bigquery.admin"),
    "roles/bigquery.dataEditor": ("roles/bigquery.dataOwner", "roles/bigquery.admin"),
    "roles/bigquery.jobUser": ("roles/bigquery.user", "roles/bigquery.admin"),
    "roles/discoveryengine.viewer": ("roles/discoveryengine.editor", "roles/discoveryengine.admin"),
    "roles/secretmanager.secretAccessor": ("roles/secretmanager.admin",),
    "roles/cloudtasks.enqueuer": ("roles/cloudtasks.admin",),
    "roles/datastore.user": ("roles/datastore.owner",),
    "roles/cloudsql.client": ("roles/cloudsql.editor", "roles/cloudsql.admin"),
}
STATUSES = ("aligned", "excess_authority", "missing_authority", "mixed", "unresolved")


def required_authority(grants: DataFrame) -> DataFrame:
    return grants.groupBy("agent_key").agg(F.array_sort(F.collect_set("role")).alias("req_roles"), F.array_sort(F.collect_set("permission")).alias("req_permissions"))


def deployed_authority(grants: DataFrame) -> DataFrame:
    """Unconditional grants count as deployed; conditional ones are kept apart, and never decide."""
    some = lambda c, test: F.array_sort(F.collect_set(F.when(test, F.col(c))))
    sure = ~F.col("conditional")
    return grants.groupBy("agent_key").agg(some("role", sure).alias("dep_roles"), some("permission", sure).alias("dep_permissions"), some("role", F.col("conditional")).alias("cond_roles"))


def _supersets(role):
    pairs = [v for k, roles in ROLE_SUPERSETS.items() for v in (F.lit(k), F.array(*[F.lit(r) for r in roles]))]
    return F.coalesce(F.create_map(*pairs)[role], F.array().cast("array<string>"))


def reconcile(agents: DataFrame, required: DataFrame, deployed: DataFrame, complete: DataFrame) -> DataFrame:
    """(agent, excess_roles, missing_roles, excess_permissions, missing_permissions, unresolved, status).

    `complete`: (agent_key, roles_complete, permissions_complete), absent = not complete.
    """
    none = F.array().cast("array<string>")
    rows = agents.select("agent_key", F.col("name").alias("agent")).join(required, "agent_key", "left").join(deployed.withColumn("has", F.lit(True)), "agent_key", "left").join(complete, "agent_key", "left")
    for c in ("req_roles", "req_permissions", "dep_roles", "dep_permissions", "cond_roles"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    full = {k: F.coalesce(f"{k}_complete", F.lit(False)) for k in ("roles", "permissions")}
    bound = F.coalesce("has", F.lit(False))
    met = lambda r: F.array_contains("dep_roles", r) | F.arrays_overlap(_supersets(r), F.col("dep_roles"))
    rows = rows.withColumns(
        {
            "excess_roles": F.when(full["roles"], F.array_except("dep_roles", "req_roles")).otherwise(none),
            "excess_permissions": F.when(full["permissions"], F.array_except("dep_permissions", "req_permissions")).otherwise(none),
            "missing_roles": F.when(bound, F.filter("req_roles", lambda r: ~met(r))).otherwise(none),
            "missing_permissions": F.when(bound, F.array_except("req_permissions", "dep_permissions")).otherwise(none),
            "unresolved": F.array_compact(F.array(F.when(~bound, "deployed_identity"), F.when(~full["permissions"], "required_permissions"), F.when(~full["roles"], "required_roles"), F.when(F.size("cond_roles") > 0, "conditional_roles"))),
        }
    )
    excess, missing = (F.size("excess_roles") > 0) | (F.size("excess_permissions") > 0), (F.size("missing_roles") > 0) | (F.size("missing_permissions") > 0)
    status = F.when(excess & missing, "mixed").when(excess, "excess_authority").when(missing, "missing_authority").when(F.size("unresolved") > 0, "unresolved").otherwise("aligned")
    return rows.withColumn("status", status).select("agent", "excess_roles", "missing_roles", "excess_permissions", "missing_permissions", "unresolved", "status")


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("agents"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        *[F.sum(F.size(c)).alias(c) for c in ("excess_roles", "missing_roles", "excess_permissions", "missing_permissions")],
    )


def workloads_of(agents: DataFrame, workloads: DataFrame) -> DataFrame:
    """(agent, workload_id, basis): an explicit agent wins and rules hints out; else a hint names the id, or the name.

    `agents`: (name, hints array); `workloads`: (workload_id, name, agent nullable). Equi-joins on exploded hints.
    """
    hints = agents.select(F.col("name").alias("agent"), F.explode("hints").alias("hint"))
    named = workloads.filter("agent is not null").join(agents.select(F.col("name").alias("agent")), "agent").select("agent", "workload_id", F.lit("explicit_agent").alias("basis"))
    free = workloads.filter("agent is null").select("workload_id", F.col("name").alias("w_name"))
    by_id = hints.join(free, F.col("hint") == F.col("workload_id")).select("agent", "workload_id", F.lit("workload_id").alias("basis"))
    by_name = hints.join(free, F.col("hint") == F.col("w_name")).select("agent", "workload_id", F.lit("workload_name").alias("basis"))
    return named.unionByName(by_id.unionByName(by_name).groupBy("agent", "workload_id").agg(F.min("basis").alias("basis")))


def drift(base: DataFrame, head: DataFrame) -> DataFrame:
    """Per agent whose grants changed: roles and permissions added and removed, regressed, improved."""
    sets = lambda df, p: df.groupBy("agent_key").agg(F.array_sort(F.collect_set("role")).alias(f"{p}_roles"), F.array_sort(F.collect_set("permission")).alias(f"{p}_perms"))
    rows, none = sets(base, "b").join(sets(head, "h"), "agent_key", "full"), F.array().cast("array<string>")
    for c in ("b_roles", "b_perms", "h_roles", "h_perms"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    delta = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    rows = rows.select("agent_key", delta("h_roles", "b_roles").alias("roles_added"), delta("b_roles", "h_roles").alias("roles_removed"), delta("h_perms", "b_perms").alias("permissions_added"), delta("b_perms", "h_perms").alias("permissions_removed"))
    grew = (F.col("roles_added") != "") | (F.col("permissions_added") != "")
    shrank = (F.col("roles_removed") != "") | (F.col("permissions_removed") != "")
    return rows.filter(grew | shrank).withColumn("regressed", grew).withColumn("improved", shrank & ~grew)
