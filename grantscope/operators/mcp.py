"""The view of MCP servers: what is known of their authority, and why references to them stay unresolved.

Its rules for what is unresolved differ from those of relationships on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.operators.authority import server_scope


def effective(fs) -> DataFrame:
    """(agent, server, authentication, tool_scope, remote, gaps): what evidence of a bound server lacks."""
    rows = fs.mcp_servers.join(fs.agents.select("agent_key", F.col("name").alias("agent")), "agent_key")
    state = F.when(F.col("authenticated"), "authenticated").when(~F.col("authenticated"), "unauthenticated").otherwise("unknown")
    remote = F.coalesce(F.col("url") != "", F.lit(False))
    scope = server_scope()
    gaps = F.array_compact(
        F.array(
            F.when(remote & F.col("authenticated").isNull(), F.lit("authentication")), F.when(F.col("identity").isNull(), F.lit("identity")),
            F.when(~remote & F.coalesce(F.col("command") == "", F.lit(True)), F.lit("destination")), F.when(scope != "explicit_allowlist", F.lit("tool_catalogue")),
        )
    )
    return rows.select("agent", F.col("name").alias("server"), state.alias("authentication"), scope.alias("tool_scope"), remote.alias("remote"), F.array_join(gaps, ",").alias("gaps"))


def report(view: DataFrame) -> DataFrame:
    """Counts by authentication, scope and remoteness."""
    return view.groupBy("authentication", "tool_scope", "remote").agg(F.count("*").alias("n"), F.count_if(F.col("gaps") == "").alias("complete"))


# Why a reference is unresolved, and whether static evidence could mend it.
STATIC_REASONS = ("server_not_declared", "declaration_not_agent_bound", "cross_file_reference_unlinked", "name_mismatch", "scope_reference_unmatched")
LIMITED_REASONS = ("dynamic_server_selection", "dynamic_tool_filter", "catalogue_unknown", "external_configuration", "framework_semantics_unknown", "ambiguous_multiple_candidates", "unsupported_reference_shape")
GAPS = (
    ("server_not_declared", "server_declaration"), ("ambiguous_multiple_candidates", "unique_server_binding"), ("cross_file_reference_unlinked", "repository_linkage"), ("dynamic_server_selection", "static_server_name"),
    ("unsupported_reference_shape", "supported_reference_shape"), ("external_configuration", "repository_local_configuration"), ("framework_semantics_unknown", "supported_framework_binding_semantics"),
)


def link_imported(placeholders: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked, unresolved): servers an agent names by import, bound only where one declaration of the repository fits.

    `placeholders`: (ref_id, agent, name, import_module nullable); `declarations`: (decl_id, name, module). A module fits if
    it equals the imported one or ends with it; that is a residual test on an equi-join by name.
    """
    fits = (F.col("module") == F.col("import_module")) | F.endswith("module", F.concat(F.lit("."), "import_module"))
    found = placeholders.filter("import_module <> ''").join(declarations, "name").filter(fits)
    counts = found.groupBy("ref_id").agg(F.count("*").alias("n"), F.min("decl_id").alias("decl_id"))
    rows = placeholders.join(counts, "ref_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hint = F.when(F.coalesce("import_module", F.lit("")) == "", "unsupported_import_reference").when(F.col("n") > 1, "ambiguous_imported_reference").otherwise("unresolved_imported_reference")
    linked = rows.filter("n = 1").select("ref_id", "agent", "name", "decl_id")
    return linked, rows.filter("n <> 1").select("ref_id", "agent", "name", hint.alias("hint"), F.col("n").alias("candidates"))


def bind_clients(clients: DataFrame, tools: DataFrame, agents: DataFrame) -> DataFrame:
    """(path, agent, server): agents built from the tools that a client variable of the same file gave.

    `clients`: (path, client, server), `tools`: (path, alias, client), `agents`: (path, alias, agent). An agent whose name
    recurs in its file binds nothing.
    """
    unique = agents.groupBy("path", "agent").agg(F.count_distinct("alias").alias("n")).filter("n = 1").select("path", "agent")
    return agents.join(unique, ["path", "agent"], "left_semi").join(tools, ["path", "alias"]).join(clients, ["path", "client"]).select("path", "agent", "server").distinct()


def enrich(fs) -> tuple[DataFrame, DataFrame]:
    """(servers, identities): bound servers with their authentication state, scope, destination and identity, and the
    identities made for credentials that none had; such an identity is named after its agent and server.
    """
    rows = fs.mcp_servers.join(fs.agents.select("agent_key", F.col("name").alias("agent")), "agent_key")
    state = F.when(F.col("authenticated"), "authenticated").when(~F.col("authenticated"), "unauthenticated").otherwise("unknown")
    known = F.col("credential_source") if "credential_source" in rows.columns else F.when(F.col("authenticated"), "header")
    made = F.when(F.col("identity").isNull() & known.isNotNull(), F.concat_ws(":", "agent", "name", F.lit("mcp-auth")))
    host = F.nullif(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    rows = rows.withColumns({"auth_state": state, "scope": server_scope(), "destination": F.coalesce("url", "command"), "made": made, "source": known, "provider": F.coalesce(host, F.lit("mcp"))})
    servers = rows.select("agent", F.col("name").alias("server"), "auth_state", "scope", "destination", F.coalesce("identity", "made").alias("identity"))
    fresh = rows.filter("made is not null").select("agent_key", F.col("made").alias("name"), "provider", F.col("source").alias("credential_source"))
    return servers, fresh.join(fs.identities.select("agent_key", "name").distinct(), ["agent_key", "name"], "left_anti").select("agent_key", "name", "provider", "credential_source")


def unresolved(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """(ref_id, name, kind, reason, resolution_class, gaps, candidates): why each reference or declaration is not bound.

    `references`: (ref_id, name, reference_only, hint nullable); `declarations`: (ref_id, name) not bound to an agent.
    What a scanner noted (hint) decides first, then how many other declarations have the name.
    """
    same = references.filter("reference_only").join(declarations.withColumnRenamed("ref_id", "d_id"), "name").filter("d_id <> ref_id").groupBy("ref_id").agg(F.count("*").alias("n"))
    rows = references.join(same, "ref_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    hint, n = F.coalesce("hint", F.lit("")), F.col("n")
    by_count = F.when(n > 1, "ambiguous_multiple_candidates").when(n == 1, "cross_file_reference_unlinked").otherwise("server_not_declared")
    reference = (
        F.when(hint == "dynamic_server_selection", "dynamic_server_selection").when(hint.isin("ambiguous_fast_agent_reference", "ambiguous_imported_reference"), "ambiguous_multiple_candidates")
        .when(hint == "missing_fast_agent_declaration", "server_not_declared").when(hint == "unsupported_import_reference", "unsupported_reference_shape")
        .when(hint == "unresolved_imported_reference", by_count).when(hint == "external_configuration", "external_configuration").otherwise("framework_semantics_unknown")
    )
    declared = F.when(hint == "ambiguous_fast_agent_reference", "ambiguous_multiple_candidates").otherwise("declaration_not_agent_bound")
    rows = rows.withColumn("reason", F.when(F.col("reference_only"), reference).otherwise(declared))
    gap = F.array_compact(F.array(*[F.when(F.col("reason") == r, F.lit(g)) for r, g in GAPS]))
    kind = F.when(F.col("reference_only"), "agent_reference").otherwise("server_declaration")
    cls = F.when(F.col("reason").isin(*STATIC_REASONS), "resolvable_static").otherwise("evidence_limited")
    return rows.select("ref_id", "name", kind.alias("kind"), "reason", cls.alias("resolution_class"), F.array_join(gap, ",").alias("gaps"), n.alias("candidates"))


def unresolved_summary(rows: DataFrame) -> DataFrame:
    """(by, value, n): counts by reason, resolution class and kind."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in ("reason", "resolution_class", "kind")])).alias("x")
    return rows.select(each).groupBy("x.by", "x.value").agg(F.count("*").alias("n"))
