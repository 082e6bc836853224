"""Queries over flows, deployments, MCP bindings and gates; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantscope.functions import expr as X
from grantscope.operators import authority, delta, deployment, flows, gates, mcp, rules
from grantscope.plans import questions as Q
from grantscope.plans.catalog import register
from grantscope.plans.core import TOOL_VIEWS, _snapshots, sql
from grantscope.plans.lens import facts, with_views


def _sql(spark, sf_dir, text):
    """A table in SQL over the supplied tables, as the lens reads them; DuckDB runs the same text."""
    from grantscope.plans.lens import table

    return table(spark, sf_dir, text)


def _with(names: dict, body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in names.items()) + body


@register("flow_histograms", "WITH " + with_views("flows") + """
SELECT 'execution_context' AS by_what, v.value, count(f.flow_id) AS n FROM (SELECT unnest(['agent_tool', 'cli', 'application_support', 'test', 'example', 'tutorial', 'notebook', 'template_generated', 'runtime', 'unknown']) AS value) v
  LEFT JOIN f_flows f ON f.execution_context = v.value GROUP BY v.value
UNION ALL SELECT 'reachability', v.value, count(f.flow_id) FROM (SELECT unnest(['proven_agent_reachable', 'proven_non_agent', 'unknown']) AS value) v LEFT JOIN f_flows f ON f.reachability = v.value GROUP BY v.value""")
def flow_histograms(spark, sf_dir):
    own = facts(spark, sf_dir).flows
    by = lambda c, values: flows.histogram(own, c, values).select(F.lit(c).alias("by_what"), "value", "n")
    return by("execution_context", flows.CONTEXTS).unionByName(by("reachability", flows.REACHABILITIES))


CALLS = """SELECT DISTINCT CASE e_no % 14 WHEN 0 THEN 'requests.get' WHEN 1 THEN 'subprocess.run' WHEN 2 THEN 'input' WHEN 3 THEN 'mcp_client.call_tool' WHEN 4 THEN 'vault.read' WHEN 5 THEN 'httpx.post' WHEN 6 THEN 'agent_memory.save'
  WHEN 7 THEN 'google_search' WHEN 8 THEN 'os.system' WHEN 9 THEN 'mail.send_email' WHEN 10 THEN 'self.session.get' WHEN 11 THEN 'json.dumps' WHEN 12 THEN 'client.access_secret_version' ELSE 'checkpoint.put' END AS called FROM (SELECT c_custkey AS e_no FROM customer) x"""


@register("flow_kinds", _with({"calls": CALLS}, """
SELECT called, CASE WHEN called = 'input' THEN 'user_input' WHEN called IN ('requests.get', 'self.session.get') THEN 'external_http_response' WHEN called = 'google_search' THEN 'web_retrieval' WHEN called = 'mcp_client.call_tool' THEN 'mcp_response'
    WHEN called IN ('vault.read', 'client.access_secret_version') THEN 'secret_value' END AS source_kind,
  CASE WHEN called IN ('subprocess.run', 'os.system') THEN 'process_execute' WHEN called IN ('httpx.post', 'mail.send_email') THEN 'external_send' WHEN called IN ('agent_memory.save', 'checkpoint.put') THEN 'memory_write' END AS sink_kind FROM calls"""))
def flow_kinds(spark, sf_dir):
    return _sql(spark, sf_dir, CALLS).select("called", flows.source_kind(F.col("called")).alias("source_kind"), flows.sink_kind(F.col("called")).alias("sink_kind"))


WORKLOADS = """SELECT s_suppkey AS agent_key, s_name AS agent, 'gcp' AS provider, 'run-' || CAST(s_suppkey AS STRING) AS workload_id,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'user:someone@example.com' ELSE 'serviceAccount:sa-' || CAST(s_suppkey AS STRING) || '@proj.iam.gserviceaccount.com' END AS identity FROM supplier"""
BINDINGS = """SELECT 'sa-' || CAST(l_suppkey AS STRING) || '@proj.iam.gserviceaccount.com' AS account, 'roles/' || p_brand || '/' || CAST(p_size AS STRING) AS role, 'project/' || p_brand AS scope,
  CASE WHEN l_linestatus = 'F' THEN 'folder/f' ELSE NULL END AS inherited_from, l_returnflag = 'R' AS conditional, CASE WHEN p_size = 7 THEN NULL ELSE 'perm.' || p_type END AS permission FROM lineitem JOIN part ON l_partkey = p_partkey"""
DEPLOYED = """,
ids AS (SELECT *, CASE WHEN identity LIKE 'serviceAccount:%' THEN substr(identity, 16) END AS account FROM workloads),
dep AS (SELECT i.agent, i.agent_key, i.workload_id, i.account, i.identity, list_sort(list_distinct(list(b.role) FILTER (WHERE NOT b.conditional))) AS roles, list_sort(list_distinct(list(b.role) FILTER (WHERE b.conditional))) AS croles,
    list_sort(list_distinct(list(b.permission) FILTER (WHERE NOT b.conditional AND b.permission IS NOT NULL))) AS perms, list_sort(list_distinct(list(b.permission) FILTER (WHERE b.conditional AND b.permission IS NOT NULL))) AS cperms,
    list_sort(list_distinct(list(b.scope) FILTER (WHERE b.scope IS NOT NULL))) AS scopes, count(DISTINCT b.inherited_from) AS inh, count(b.role) AS nb, count(*) FILTER (WHERE b.role IS NOT NULL AND b.permission IS NULL) AS blank
  FROM ids i LEFT JOIN bindings b ON b.account = i.account GROUP BY i.agent, i.agent_key, i.workload_id, i.account, i.identity),
open_ AS (SELECT *, concat_ws(',', CASE WHEN identity IS NOT NULL AND account IS NULL THEN 'canonical_identity' END, CASE WHEN identity IS NULL THEN 'deployed_identity' END, CASE WHEN nb = 0 THEN 'iam_bindings' END, CASE WHEN len(croles) > 0 THEN 'iam_condition_applicability' END,
    CASE WHEN blank > 0 THEN 'permissions' END) AS unresolved FROM dep)"""


def _deployed(spark, sf_dir):
    who = deployment.identities(_sql(spark, sf_dir, WORKLOADS))
    bound = _sql(spark, sf_dir, BINDINGS).withColumn("permissions", F.when(F.col("permission").isNotNull(), F.array("permission"))).drop("permission").distinct()
    return deployment.authority(who, bound)


@register("deployed_authority", _with({"workloads": WORKLOADS, "bindings": BINDINGS}, DEPLOYED + """
SELECT agent, account, CAST(len(coalesce(roles, [])) AS INTEGER) AS roles, CAST(len(coalesce(croles, [])) AS INTEGER) AS conditional_roles, array_to_string(coalesce(perms, []), ',') AS permissions, array_to_string(coalesce(cperms, []), ',') AS conditional_permissions,
  array_to_string(coalesce(scopes, []), ',') AS scopes, unresolved, CASE WHEN unresolved = '' THEN 'fully_resolved' ELSE 'partially_resolved' END AS resolution FROM open_"""))
def deployed_authority(spark, sf_dir):
    text = lambda c: F.array_join(c, ",").alias(c)
    rows = _deployed(spark, sf_dir)
    return rows.select("agent", "account", F.size("roles").alias("roles"), F.size("conditional_roles").alias("conditional_roles"), *[text(c) for c in ("permissions", "conditional_permissions", "scopes", "unresolved")], "resolution")


@register("deployed_summary", _with({"workloads": WORKLOADS, "bindings": BINDINGS}, DEPLOYED + """
SELECT count(*) AS relationships, count(DISTINCT agent) AS agents, count(DISTINCT account) AS accounts, count(*) FILTER (WHERE unresolved = '') AS fully_resolved, count(*) FILTER (WHERE len(croles) > 0) AS with_conditions,
  count(*) FILTER (WHERE inh > 0) AS with_inheritance, count(*) FILTER (WHERE nb = 0) AS without_bindings FROM open_"""))
def deployed_summary(spark, sf_dir):
    return deployment.summary(_deployed(spark, sf_dir))


RULES_OF = """SELECT s_name AS agent, m AS mode, d AS dimension, p AS pattern FROM supplier, (SELECT 0 AS k, 'deny' AS m, 'iam_roles' AS d, 'roles/Brand#1*' AS p UNION ALL SELECT 1, 'allow', 'iam_roles', 'roles/Brand#[2-5]?/*'
  UNION ALL SELECT 1, 'allow', 'permissions', 'perm.*' UNION ALL SELECT 2, 'allow', 'identities', 'sa-[1-4]*' UNION ALL SELECT 2, 'deny', 'permissions', 'perm.PROMO*' UNION ALL SELECT 3, 'allow', 'capabilities', 'data.*') c WHERE s_suppkey % 5 = k"""
POLICED = DEPLOYED + """,
seen AS (SELECT agent, 'identities' AS dimension, FALSE AS conditional, account AS v FROM open_ WHERE account IS NOT NULL UNION ALL SELECT agent, 'iam_roles', FALSE, unnest(roles) FROM open_ UNION ALL SELECT agent, 'iam_roles', TRUE, unnest(croles) FROM open_
  UNION ALL SELECT agent, 'permissions', FALSE, unnest(perms) FROM open_ UNION ALL SELECT agent, 'permissions', TRUE, unnest(cperms) FROM open_),
met AS (SELECT s.agent, s.dimension, s.conditional, s.v, c.mode, bool_or(s.v GLOB c.pattern) AS hit FROM seen s JOIN contracts c ON c.agent = s.agent AND c.dimension = s.dimension GROUP BY ALL),
res AS (SELECT agent, mode || '.' || dimension AS clause, dimension, CASE WHEN conditional THEN 'unresolved' ELSE 'violation' END AS status,
    CASE WHEN conditional THEN 'conditional_' ELSE '' END || CASE WHEN mode = 'deny' THEN 'denied_' || dimension || '_observed' ELSE dimension || '_outside_allowlist' END AS reason, string_agg(v, ',' ORDER BY v) AS observed
  FROM met WHERE (mode = 'deny' AND hit) OR (mode = 'allow' AND NOT hit) GROUP BY agent, mode, dimension, conditional),
sts AS (SELECT o.agent, CASE WHEN o.agent_key % 5 = 4 THEN 'not_configured' WHEN o.agent_key % 5 = 3 THEN 'not_constrained' WHEN r.bad = 1 THEN 'violation' WHEN r.bad = 0 OR o.unresolved <> '' THEN 'unresolved' ELSE 'compliant' END AS status
  FROM open_ o LEFT JOIN (SELECT agent, max(CASE WHEN status = 'violation' THEN 1 ELSE 0 END) AS bad FROM res GROUP BY agent) r ON r.agent = o.agent)"""


def _policed(spark, sf_dir):
    clauses = _sql(spark, sf_dir, RULES_OF)
    return deployment.policy(_deployed(spark, sf_dir), clauses, clauses.select("agent"))


@register("deployed_policy", _with({"workloads": WORKLOADS, "bindings": BINDINGS, "contracts": RULES_OF}, POLICED + "\nSELECT * FROM res"))
def deployed_policy(spark, sf_dir):
    return _policed(spark, sf_dir)[0].drop("relationship_id")


@register("deployed_policy_summary", _with({"workloads": WORKLOADS, "bindings": BINDINGS, "contracts": RULES_OF}, POLICED + """
SELECT v.kind, count(s.agent) AS n FROM (SELECT unnest(['compliant', 'violation', 'unresolved', 'not_configured', 'not_constrained']) AS kind) v LEFT JOIN sts s ON s.status = v.kind GROUP BY v.kind
UNION ALL SELECT v.kind, count(r.agent) FROM (SELECT unnest(['violation_results', 'unresolved_results']) AS kind) v LEFT JOIN res r ON r.status || '_results' = v.kind GROUP BY v.kind"""))
def deployed_policy_summary(spark, sf_dir):
    return deployment.policy_summary(*_policed(spark, sf_dir))


EVIDENCE = "SELECT DISTINCT p_brand AS family FROM part"
WIRING = "SELECT 'sa-' || CAST(c_custkey % (SELECT count(*) FROM supplier) + 1 AS STRING) AS account_id, 'Brand#' || CAST(c_custkey % 7 + 10 AS STRING) AS family, 'roles/wired' || CAST(c_custkey % 11 AS STRING) AS role FROM customer"


@register("wired_requirements", _with({"workloads": WORKLOADS, "evidence": EVIDENCE, "wiring": WIRING}, """
SELECT DISTINCT w.agent, i.role FROM workloads w JOIN wiring i ON w.identity = 'serviceAccount:' || i.account_id || '@proj.iam.gserviceaccount.com' WHERE i.family IN (SELECT family FROM evidence)"""))
def wired_requirements(spark, sf_dir):
    who = deployment.identities(_sql(spark, sf_dir, WORKLOADS)).select("agent", "account")
    return deployment.wired_requirements(_sql(spark, sf_dir, EVIDENCE), _sql(spark, sf_dir, WIRING), who)


BLOCKERS = """SELECT s_name AS agent, CASE c.n % 3 WHEN 0 THEN 'dynamic_import' WHEN 1 THEN 'parse_failure' ELSE 'generic_http' END AS blocker
  FROM (SELECT c_custkey AS n, c_custkey % (SELECT count(*) * 2 FROM supplier) + 1 AS k FROM customer) c JOIN supplier ON s_suppkey = c.k"""


@register("absence_certificates", _with({"workloads": WORKLOADS, "blockers": BLOCKERS}, """
SELECT w.agent, count(b.blocker) = 0 AS complete, coalesce(string_agg(DISTINCT b.blocker, ',' ORDER BY b.blocker), '') AS blockers FROM workloads w LEFT JOIN blockers b ON b.agent = w.agent GROUP BY w.agent"""))
def absence_certificates(spark, sf_dir):
    rows = deployment.certificates(_sql(spark, sf_dir, WORKLOADS).select("agent", "provider"), _sql(spark, sf_dir, BLOCKERS))
    return rows.withColumn("blockers", F.array_join("blockers", ","))


@register("mcp_context", "WITH " + with_views("agents", "mcp_servers", "identities") + """
SELECT a.name AS agent, m.name AS server, CASE WHEN authenticated THEN 'authenticated' WHEN NOT authenticated THEN 'unauthenticated' ELSE 'unknown' END AS auth_state,
  CASE WHEN allowed_tools <> '' THEN 'explicit_allowlist' WHEN denied_tools <> '' THEN 'denylist_only' WHEN dynamic_tool_filter THEN 'dynamic_filter' ELSE 'unrestricted_or_unknown' END AS scope, coalesce(url, command) AS destination,
  coalesce(identity, CASE WHEN authenticated THEN a.name || ':' || m.name || ':mcp-auth' END) AS identity FROM f_mcp_servers m JOIN f_agents a ON a.agent_key = m.agent_key""")
def mcp_context(spark, sf_dir):
    return mcp.enrich(facts(spark, sf_dir))[0]


@register("mcp_identities", "WITH " + with_views("agents", "mcp_servers") + """
SELECT m.agent_key, a.name || ':' || m.name || ':mcp-auth' AS name, CASE WHEN url LIKE '%//%' THEN split_part(split_part(split_part(url, '//', 2), '/', 1), ':', 1) ELSE 'mcp' END AS provider, 'header' AS credential_source
FROM f_mcp_servers m JOIN f_agents a ON a.agent_key = m.agent_key WHERE identity IS NULL AND authenticated""")
def mcp_identities(spark, sf_dir):
    return mcp.enrich(facts(spark, sf_dir))[1]


REFERENCES = """SELECT c_custkey AS ref_id, 'srv-' || CAST(c_custkey % 97 AS STRING) AS name, c_custkey % 3 <> 0 AS reference_only, CASE c_custkey % 11 WHEN 0 THEN 'dynamic_server_selection' WHEN 1 THEN 'ambiguous_fast_agent_reference' WHEN 2 THEN 'missing_fast_agent_declaration'
  WHEN 3 THEN 'unsupported_import_reference' WHEN 4 THEN 'external_configuration' WHEN 5 THEN NULL ELSE 'unresolved_imported_reference' END AS hint FROM customer"""
UNRESOLVED = """,
decls AS (SELECT ref_id, name FROM refs WHERE NOT reference_only AND ref_id % 2 = 0),
cnt AS (SELECT r.ref_id, count(*) AS n FROM refs r JOIN decls d ON d.name = r.name AND d.ref_id <> r.ref_id WHERE r.reference_only GROUP BY r.ref_id),
why AS (SELECT r.ref_id, r.name, r.reference_only, coalesce(c.n, 0) AS candidates, CASE WHEN NOT reference_only THEN CASE WHEN hint = 'ambiguous_fast_agent_reference' THEN 'ambiguous_multiple_candidates' ELSE 'declaration_not_agent_bound' END
    WHEN hint = 'dynamic_server_selection' THEN hint WHEN hint = 'ambiguous_fast_agent_reference' THEN 'ambiguous_multiple_candidates' WHEN hint = 'missing_fast_agent_declaration' THEN 'server_not_declared' WHEN hint = 'unsupported_import_reference' THEN 'unsupported_reference_shape'
    WHEN hint = 'unresolved_imported_reference' THEN CASE WHEN c.n > 1 THEN 'ambiguous_multiple_candidates' WHEN c.n = 1 THEN 'cross_file_reference_unlinked' ELSE 'server_not_declared' END WHEN hint = 'external_configuration' THEN hint ELSE 'framework_semantics_unknown' END AS reason
  FROM refs r LEFT JOIN cnt c ON c.ref_id = r.ref_id),
unr AS (SELECT ref_id, name, CASE WHEN reference_only THEN 'agent_reference' ELSE 'server_declaration' END AS kind, reason, CASE WHEN reason IN ('server_not_declared', 'declaration_not_agent_bound', 'cross_file_reference_unlinked') THEN 'resolvable_static' ELSE 'evidence_limited' END AS resolution_class,
    CASE reason WHEN 'server_not_declared' THEN 'server_declaration' WHEN 'ambiguous_multiple_candidates' THEN 'unique_server_binding' WHEN 'cross_file_reference_unlinked' THEN 'repository_linkage' WHEN 'dynamic_server_selection' THEN 'static_server_name'
      WHEN 'unsupported_reference_shape' THEN 'supported_reference_shape' WHEN 'external_configuration' THEN 'repository_local_configuration' WHEN 'framework_semantics_unknown' THEN 'supported_framework_binding_semantics' ELSE '' END AS gaps, candidates FROM why)"""


def _unresolved(spark, sf_dir):
    refs = _sql(spark, sf_dir, REFERENCES)
    return mcp.unresolved(refs, refs.filter("not reference_only and ref_id % 2 = 0").select("ref_id", "name"))


@register("mcp_unresolved", _with({"refs": REFERENCES}, UNRESOLVED + "\nSELECT * FROM unr"))
def mcp_unresolved(spark, sf_dir):
    return _unresolved(spark, sf_dir)


@register("mcp_unresolved_summary", _with({"refs": REFERENCES}, UNRESOLVED + """
SELECT 'reason' AS by, reason AS value, count(*) AS n FROM unr GROUP BY reason UNION ALL SELECT 'resolution_class', resolution_class, count(*) FROM unr GROUP BY resolution_class UNION ALL SELECT 'kind', kind, count(*) FROM unr GROUP BY kind"""))
def mcp_unresolved_summary(spark, sf_dir):
    return mcp.unresolved_summary(_unresolved(spark, sf_dir))


PLACEHOLDERS = """SELECT p_partkey AS ref_id, p_brand AS agent, 'srv-' || CAST(p_partkey % 60 AS STRING) AS name, CASE p_partkey % 4 WHEN 0 THEN 'tools.m' || CAST(p_partkey % 3 AS STRING) WHEN 1 THEN 'app.tools.m1' WHEN 2 THEN '' ELSE NULL END AS import_module FROM part"""
DECLARED = "SELECT s_suppkey AS decl_id, 'srv-' || CAST(s_suppkey % 60 AS STRING) AS name, 'app.tools.m' || CAST(s_suppkey % 3 AS STRING) AS module FROM supplier"


@register("imported_servers", _with({"p": PLACEHOLDERS, "d": DECLARED}, """,
m AS (SELECT p.ref_id, count(d.decl_id) AS n, min(d.decl_id) AS decl_id FROM p LEFT JOIN d ON p.import_module <> '' AND d.name = p.name AND (d.module = p.import_module OR d.module LIKE '%.' || p.import_module) GROUP BY p.ref_id)
SELECT p.ref_id, p.agent, p.name, CASE WHEN m.n = 1 THEN m.decl_id END AS decl_id, CASE WHEN m.n = 1 THEN NULL WHEN coalesce(p.import_module, '') = '' THEN 'unsupported_import_reference' WHEN m.n > 1 THEN 'ambiguous_imported_reference' ELSE 'unresolved_imported_reference' END AS hint
FROM p JOIN m ON m.ref_id = p.ref_id"""))
def imported_servers(spark, sf_dir):
    linked, loose = mcp.link_imported(_sql(spark, sf_dir, PLACEHOLDERS), _sql(spark, sf_dir, DECLARED))
    both = linked.withColumn("hint", F.lit(None).cast("string")).unionByName(loose.drop("candidates").withColumn("decl_id", F.lit(None).cast("long")))
    return both.select("ref_id", "agent", "name", "decl_id", "hint")


DIAGNOSTICS = "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'unresolved_tool' WHEN 1 THEN 'unresolved_delegation' WHEN 2 THEN 'external_helper_semantics_unresolved' ELSE 'source_fragment' END AS kind, o_orderkey % 5 <= 1 AS incomplete FROM orders"


@register("coverage_metrics", "WITH " + with_views("tools", "unbound_tools", "mcp_servers", "identities", "global_identities", "flows") + f",\ndiag AS ({DIAGNOSTICS})" + """,
a AS (SELECT (SELECT count(*) FROM f_tools) + (SELECT count(*) FROM f_unbound_tools) + (SELECT count(*) FROM f_mcp_servers) AS resolved_tools, (SELECT count(*) FROM diag WHERE kind = 'unresolved_tool') AS unresolved_tools, CAST(0 AS BIGINT) AS delegations,
  (SELECT count(*) FROM diag WHERE kind = 'unresolved_delegation') AS unresolved_delegations)
SELECT resolved_tools, unresolved_tools, round_even(resolved_tools / CAST(resolved_tools + unresolved_tools AS DOUBLE), 6) AS tool_ratio, delegations, unresolved_delegations, 0.0 AS delegation_ratio,
  (SELECT count(*) FROM (SELECT name, provider FROM f_identities UNION SELECT name, provider FROM f_global_identities) x) AS identities, (SELECT count(*) FROM diag WHERE kind = 'external_helper_semantics_unresolved') AS helpers_unresolved,
  (SELECT count(*) FROM f_flows) AS flows, (SELECT count(*) FROM f_flows WHERE reachability = 'proven_agent_reachable') AS agent_flows, (SELECT count(*) FROM f_flows WHERE reachability = 'unknown') AS unknown_flows FROM a""")
def coverage_metrics(spark, sf_dir):
    return gates.coverage(facts(spark, sf_dir), _sql(spark, sf_dir, DIAGNOSTICS))


@register("resolution_regression", sql(TOOL_VIEWS, Q.HEAD + Q.SNAPSHOT + Q.of_head(Q.SNAPSHOT) + """,
ob AS (SELECT count(*) AS n FROM snap WHERE len(caps) = 0 OR NOT named OR NOT sourced OR (approval IS NULL AND NOT guardrails AND NOT held) OR len(selectors) = 0 OR len(targets) = 0),
oh AS (SELECT count(*) AS n FROM snap_h WHERE len(caps) = 0 OR NOT named OR NOT sourced OR (approval IS NULL AND NOT guardrails AND NOT held) OR len(selectors) = 0 OR len(targets) = 0)
SELECT ob.n AS base_unresolved, oh.n AS head_unresolved, oh.n > ob.n AS regressed FROM ob, oh"""))
def resolution_regression(spark, sf_dir):
    base, head = _snapshots(spark, sf_dir)
    return gates.resolution_regression(authority.tool_relationships(base), authority.tool_relationships(head))


@register("scan_gates", sql(Q.RULE_VIEWS, Q.RULES + Q.SNAPSHOT + f",\ndiag AS ({DIAGNOSTICS})" + """,
rel AS (SELECT count(*) AS n, count(*) FILTER (WHERE len(caps) > 0 AND named AND sourced AND (approval IS NOT NULL OR guardrails OR held) AND len(selectors) > 0 AND len(targets) > 0) AS whole FROM snap)
SELECT 'severity' AS gate, count(*) FILTER (WHERE severity >= 3) > 0 AS failed, CAST(count(*) FILTER (WHERE severity >= 3) AS DOUBLE) AS observed FROM found
UNION ALL SELECT 'resolution_budget', round_even(whole / CAST(n AS DOUBLE), 6) < 0.5, round_even(whole / CAST(n AS DOUBLE), 6) FROM rel
UNION ALL SELECT 'unresolved_budget', n - whole > 100, CAST(n - whole AS DOUBLE) FROM rel
UNION ALL SELECT 'completeness', count(*) FILTER (WHERE incomplete) > 0, CAST(count(*) FILTER (WHERE incomplete) AS DOUBLE) FROM diag"""))
def scan_gates(spark, sf_dir):
    fs = facts(spark, sf_dir)
    return gates.gates(rules.evaluate(fs), authority.tool_relationships(fs), _sql(spark, sf_dir, DIAGNOSTICS), budget=0.5, most_unresolved=100)


GRANTED = """SELECT s_suppkey AS agent_key, CASE s_suppkey % 4 WHEN 0 THEN 'process.execute,data.write' WHEN 1 THEN 'external.write' WHEN 2 THEN '' ELSE NULL END AS base, CASE s_suppkey % 6 WHEN 0 THEN 'process.execute' WHEN 1 THEN 'external.write,secrets.read' WHEN 2 THEN 'data.write' ELSE '' END AS head FROM supplier"""


@register("approval_clause_delta", _with({"g": GRANTED}, """,
b AS (SELECT agent_key, unnest(string_split(base, ',')) AS v FROM g WHERE base IS NOT NULL), h AS (SELECT agent_key, unnest(string_split(head, ',')) AS v FROM g),
x AS (SELECT g.agent_key, (SELECT coalesce(string_agg(DISTINCT h.v, ',' ORDER BY h.v), '') FROM h WHERE h.agent_key = g.agent_key AND h.v <> '' AND h.v NOT IN (SELECT v FROM b WHERE b.agent_key = g.agent_key)) AS added,
  (SELECT coalesce(string_agg(DISTINCT b.v, ',' ORDER BY b.v), '') FROM b WHERE b.agent_key = g.agent_key AND b.v <> '' AND b.v NOT IN (SELECT v FROM h WHERE h.agent_key = g.agent_key)) AS removed FROM g WHERE base IS NOT NULL)
SELECT agent_key, added, removed, removed <> '' AS weakened, added <> '' AS strengthened FROM x WHERE added <> '' OR removed <> ''"""))
def approval_clause_delta(spark, sf_dir):
    rows = _sql(spark, sf_dir, GRANTED)
    side = lambda c: rows.filter(F.col(c).isNotNull()).select("agent_key", F.array_remove(F.split(c, ","), "").alias("require_approval_for"))
    return delta.approval_delta(side("base"), side("head"))
