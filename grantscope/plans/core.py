"""The engine's own queries over the lens facts, with the same questions asked in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantscope.functions import expr as X
from grantscope.functions.cuts import in_place
from grantscope.operators import authority, closure, delta, graph, mcp, policy, query, reconcile, rules
from grantscope.plans.catalog import register
from grantscope.plans import questions as Q
from grantscope.plans.lens import agent_parts, facts, facts_by_agent, with_views

LIST = lambda c: F.array_join(F.array_sort(c), ",").alias(c)


def sql(views: str, body: str) -> str:
    """A query over the named lens views; `body` may open with further CTEs."""
    return f"WITH RECURSIVE {with_views(*views.split())}{body}"


PATHS = """,
named AS (SELECT name, min(agent_key) AS agent_key FROM f_agents GROUP BY name HAVING count(*) = 1),
edge AS (SELECT DISTINCT p.name AS parent, c.name AS child FROM f_delegations d JOIN named p ON d.agent_key = p.agent_key JOIN named c ON d.target = c.name),
walk(root, leaf, path) AS (SELECT name, name, [name] FROM named UNION ALL
  SELECT w.root, e.child, list_append(w.path, e.child) FROM walk w JOIN edge e ON e.parent = w.leaf WHERE NOT list_contains(w.path, e.child))"""
TOOL_ROWS = """,
ident AS (SELECT agent_key, name, min(coalesce(credential_source, '~null')) AS cs, min(roles) AS roles, min(permissions) AS permissions, min(oauth_scopes) AS oauth_scopes FROM f_identities GROUP BY agent_key, name),
res AS (SELECT DISTINCT agent_key, owner_name FROM f_resources),
dst AS (SELECT DISTINCT agent_key, owner_name FROM f_destinations),
trow AS (SELECT a.name AS agent, t.name AS target_name, t.caps, t.agent_key, t.identity, t.approval, i.name IS NOT NULL AS named, coalesce(i.cs <> '~null', FALSE) AS sourced, i.roles, i.permissions, i.oauth_scopes,
    t.approval IS NOT NULL OR t.guardrails OR a.approval_plugin OR a.before_tool_callback AS approved, r.owner_name IS NOT NULL AS resourced, d.owner_name IS NOT NULL AS aimed
  FROM f_tools t JOIN f_agents a ON t.agent_key = a.agent_key LEFT JOIN ident i ON i.agent_key = t.agent_key AND i.name = t.identity
  LEFT JOIN res r ON r.agent_key = t.agent_key AND r.owner_name = t.name LEFT JOIN dst d ON d.agent_key = t.agent_key AND d.owner_name = t.name),
trel AS (SELECT *, concat_ws(',', CASE WHEN NOT approved THEN 'approval' END, CASE WHEN caps = '' THEN 'capabilities' END, CASE WHEN named AND NOT sourced THEN 'credential_source' END,
    CASE WHEN NOT aimed THEN 'destinations' END, CASE WHEN NOT named THEN 'identity' END, CASE WHEN NOT resourced THEN 'resources' END) AS unresolved,
  'authority-v1:' || substr(sha256(agent || chr(0) || 'tool' || chr(0) || target_name), 1, 20) AS relationship_id FROM trow)"""
TOOL_VIEWS = "agents tools identities resources destinations"


@register("authority_query", sql(TOOL_VIEWS + " delegations", PATHS + TOOL_ROWS + """
SELECT w.root, array_to_string(w.path, ' > ') AS path, t.agent, 'tool' AS target_kind, t.target_name, t.relationship_id,
  CASE WHEN t.unresolved = '' THEN 'fully_resolved' ELSE 'partially_resolved' END AS resolution, t.caps AS capabilities
FROM trel t JOIN walk w ON w.leaf = t.agent WHERE ',' || t.caps || ',' LIKE '%,process.execute,%'"""))  # fmt: skip
def authority_query(spark, sf_dir):
    """Who can reach process.execute, directly or by delegation, and by which path?"""
    return query.effective_authority(facts_by_agent(in_place(spark), sf_dir), capability="process.execute")


@register("delegation_paths", sql("agents delegations", PATHS + "\nSELECT root, leaf, array_to_string(path, ' > ') AS path, CAST(len(path) AS BIGINT) AS steps FROM walk"))
def delegation_paths(spark, sf_dir):
    fs = facts(spark, sf_dir)
    return closure.delegation_paths(fs.agents, fs.delegations).select("root", "leaf", F.array_join("path", " > ").alias("path"), F.size("path").cast("long").alias("steps"))


@register("reachable_identities", sql("agents delegations identities", PATHS + "\nSELECT DISTINCT w.root AS agent, w.leaf, i.name AS identity FROM walk w JOIN f_agents a ON a.name = w.leaf JOIN f_identities i ON i.agent_key = a.agent_key WHERE w.root <> w.leaf"))
def reachable_identities(spark, sf_dir):
    return closure.reachable_identities(facts(spark, sf_dir))


@register("tool_relationships", sql(TOOL_VIEWS, TOOL_ROWS + """
SELECT relationship_id, agent, target_name, caps AS capabilities, unresolved, CASE WHEN unresolved = '' THEN 'fully_resolved' ELSE 'partially_resolved' END AS resolution FROM trel"""))  # fmt: skip
def tool_relationships(spark, sf_dir):
    rows = authority.tool_relationships(facts(spark, sf_dir))
    return rows.select("relationship_id", "agent", "target_name", LIST("capabilities"), LIST("unresolved"), "resolution")


SERVER_ROWS = """,
sident AS (SELECT DISTINCT agent_key, name, min(coalesce(credential_source, '~null')) AS cs FROM f_identities GROUP BY agent_key, name),
srel AS (SELECT a.name AS agent, m.name AS target_name, m.agent_key, m.url,
    CASE WHEN m.allowed_tools <> '' THEN 'explicit_allowlist' WHEN m.denied_tools <> '' THEN 'denylist_only' WHEN m.dynamic_tool_filter THEN 'dynamic_filter' ELSE 'unrestricted_or_unknown' END AS scope,
    i.name IS NOT NULL AS named, coalesce(i.cs <> '~null', FALSE) AS sourced, m.approval IS NOT NULL OR m.guardrails AS approved, m.url IS NOT NULL OR m.command IS NOT NULL AS aimed
  FROM f_mcp_servers m JOIN f_agents a ON m.agent_key = a.agent_key LEFT JOIN sident i ON i.agent_key = m.agent_key AND i.name = m.identity),
mrel AS (SELECT *, concat_ws(',', CASE WHEN NOT approved THEN 'approval' END, CASE WHEN named AND NOT sourced THEN 'credential_source' END, CASE WHEN NOT aimed THEN 'destinations' END,
    CASE WHEN NOT named THEN 'identity' END, 'resources', CASE WHEN scope <> 'explicit_allowlist' THEN 'tool_catalogue' END, CASE WHEN scope = 'dynamic_filter' THEN 'tool_filter' END) AS unresolved FROM srel)"""


@register("server_relationships", sql("agents mcp_servers identities", SERVER_ROWS + """
SELECT 'authority-v1:' || substr(sha256(agent || chr(0) || 'mcp_server' || chr(0) || target_name), 1, 20) AS relationship_id, agent, target_name, scope AS tool_scope,
  CASE WHEN url IS NOT NULL THEN 'mcp.remote,network.external' ELSE 'mcp.local' END AS capabilities, unresolved, 'partially_resolved' AS resolution FROM mrel"""))  # fmt: skip
def server_relationships(spark, sf_dir):
    rows = authority.server_relationships(facts(spark, sf_dir))
    return rows.select("relationship_id", "agent", "target_name", "tool_scope", LIST("capabilities"), LIST("unresolved"), "resolution")


@register("authority_summary", sql(TOOL_VIEWS + " mcp_servers", TOOL_ROWS + SERVER_ROWS + """,
u AS (SELECT 'tool' AS k, unresolved, named, approved, aimed, resourced FROM trel UNION ALL SELECT 'mcp_server', unresolved, named, approved, aimed, FALSE FROM mrel)
SELECT count(*) AS relationships, count(*) FILTER (WHERE k = 'tool') AS tool_relationships, count(*) FILTER (WHERE k <> 'tool') AS mcp_relationships,
  count(*) FILTER (WHERE unresolved = '') AS fully_resolved_relationships, count(*) FILTER (WHERE unresolved <> '') AS partially_resolved_relationships, CAST(0 AS BIGINT) AS unknown_relationships,
  count(*) FILTER (WHERE named) AS relationships_with_identity, count(*) FILTER (WHERE approved) AS relationships_with_approval_evidence,
  count(*) FILTER (WHERE aimed) AS relationships_with_destination_evidence, count(*) FILTER (WHERE resourced) AS relationships_with_resource_evidence FROM u"""))  # fmt: skip
def authority_summary(spark, sf_dir):
    return authority.summary(authority.relationships(facts(spark, sf_dir)))


@register("unresolved_histogram", sql(TOOL_VIEWS + " mcp_servers", TOOL_ROWS + SERVER_ROWS + """,
u AS (SELECT unnest(string_split(unresolved, ',')) AS dimension FROM (SELECT unresolved FROM trel UNION ALL SELECT unresolved FROM mrel))
SELECT dimension, count(*) AS n FROM u WHERE dimension <> '' GROUP BY dimension"""))  # fmt: skip
def unresolved_histogram(spark, sf_dir):
    return authority.unresolved_histogram(authority.relationships(facts(spark, sf_dir)))


@register("resolution_ratio", sql(TOOL_VIEWS + " mcp_servers", TOOL_ROWS + SERVER_ROWS + """,
u AS (SELECT unresolved FROM trel UNION ALL SELECT unresolved FROM mrel)
SELECT count(*) AS relationships, count(*) FILTER (WHERE unresolved = '') AS fully_resolved, count(*) FILTER (WHERE unresolved <> '') AS partially_resolved, CAST(0 AS BIGINT) AS unknown,
  round(count(*) FILTER (WHERE unresolved = '') / CAST(count(*) AS DOUBLE), 6) AS resolution_ratio FROM u"""))  # fmt: skip
def resolution_ratio(spark, sf_dir):
    return authority.resolution_ratio(authority.relationships(facts(spark, sf_dir)))


@register("propagated_authority", sql("agents delegations tools", PATHS + """,
below AS (SELECT DISTINCT e.parent, e.child, w.leaf FROM edge e JOIN walk w ON w.root = e.child WHERE w.leaf <> e.parent),
t AS (SELECT b.parent, b.child, f.caps, f.approval, f.network_scope, ',' || f.caps || ',' AS c FROM below b JOIN f_agents a ON a.name = b.leaf LEFT JOIN f_tools f ON f.agent_key = a.agent_key),
s AS (SELECT *, coalesce(c LIKE '%,process.execute,%' OR c LIKE '%,destructive.write,%' OR c LIKE '%,external.write,%' OR c LIKE '%,data.write,%' OR c LIKE '%,secrets.read,%' OR c LIKE '%,identity.admin,%', FALSE) AS p,
    coalesce(c LIKE '%,network.external,%' OR c LIKE '%,external.write,%', FALSE) AS o FROM t),
x AS (SELECT parent, child, unnest(string_split(caps, ',')) AS cap FROM s UNION SELECT parent, child, 'agent.delegate' FROM s),
g AS (SELECT parent, child, string_agg(cap, ',' ORDER BY cap) AS caps FROM (SELECT DISTINCT parent, child, cap FROM x WHERE cap IS NOT NULL AND cap <> '') GROUP BY parent, child),
m AS (SELECT parent, child, count(*) FILTER (WHERE p) AS np, count(*) FILTER (WHERE p AND approval IS NOT TRUE) AS loose, count(*) FILTER (WHERE o) AS no,
    count(*) FILTER (WHERE o AND coalesce(network_scope NOT IN ('fixed_managed_service', 'explicit_destination'), TRUE)) AS free FROM s GROUP BY parent, child)
SELECT m.parent AS agent, 'delegate:' || m.child AS name, g.caps, CASE WHEN np > 0 THEN loose = 0 END AS approval, CASE WHEN no > 0 AND free = 0 THEN 'fixed_managed_service' END AS network_scope
FROM m JOIN g ON m.parent = g.parent AND m.child = g.child"""))  # fmt: skip
def propagated_authority(spark, sf_dir):
    return closure.propagated(facts(spark, sf_dir)).withColumn("caps", F.array_join("caps", ","))


@register("boundary_classes", sql("agents identities tools mcp_servers", """,
i AS (SELECT DISTINCT agent_key, name, roles, permissions, oauth_scopes FROM f_identities),
u AS (SELECT agent_key, name, identity FROM f_tools UNION ALL SELECT agent_key, name, identity FROM f_mcp_servers)
SELECT CASE WHEN i.name IS NULL THEN 'unknown' WHEN i.roles LIKE '%owner%' OR lower(i.roles) LIKE '%editor%' OR i.permissions LIKE '%.*%' OR i.oauth_scopes <> '' THEN 'broad_privileged_authority'
  WHEN i.roles <> '' OR i.permissions <> '' THEN 'iam_authority' ELSE 'workload_service_identity' END AS class, count(*) AS n
FROM u JOIN f_agents a ON a.agent_key = u.agent_key LEFT JOIN i ON i.agent_key = u.agent_key AND i.name = u.identity GROUP BY 1"""))  # fmt: skip
def boundary_classes(spark, sf_dir):
    return authority.boundaries(authority.relationships(facts(spark, sf_dir))).filter("family = 'identity'").groupBy("class").agg(F.count("*").alias("n"))


@register("boundary_report", sql(TOOL_VIEWS + " mcp_servers", Q.SNAPSHOT + Q.SERVERS + Q.CLASSES.format(name="cls", rows="(SELECT * FROM snap UNION ALL SELECT * FROM srvs) x") + """
SELECT family, class, count(*) AS n FROM cls GROUP BY family, class"""))
def boundary_report(spark, sf_dir):
    return authority.boundaries(authority.relationships(facts(spark, sf_dir))).groupBy("family", "class").agg(F.count("*").alias("n"))


RULED = sql(Q.RULE_VIEWS, Q.RULES)


@register("tool_findings", RULED + """
SELECT rule_id, agent, subject, evidence FROM fnd WHERE rule_id IN ('AGT020', 'AGT021', 'AGT022', 'AGT023', 'AGT040')""")
def tool_findings(spark, sf_dir):
    return rules.tool_rules(facts(spark, sf_dir))


@register("framework_findings", RULED + """
SELECT rule_id, agent, subject, evidence FROM fnd WHERE rule_id LIKE 'ADK%'""")
def framework_findings(spark, sf_dir):
    return rules.framework_rules(facts(spark, sf_dir))


@register("server_findings", sql("agents mcp_servers", """,
m AS (SELECT a.name AS agent, m.name AS subject, coalesce(m.url, m.command, '') AS evidence, m.*, m.url IS NOT NULL AND m.url NOT LIKE '%//localhost%' AND m.url NOT LIKE '%//127.%' AS remote FROM f_mcp_servers m JOIN f_agents a ON m.agent_key = a.agent_key)
SELECT 'AGT001' AS rule_id, agent, subject, evidence FROM m WHERE transport = 'stdio' AND (',' || args || ',' LIKE '%,/,%' OR ',' || args || ',' LIKE '%,.,%')
UNION ALL SELECT 'AGT030', agent, subject, evidence FROM m WHERE remote AND authenticated IS FALSE
UNION ALL SELECT 'AGT031', agent, subject, evidence FROM m WHERE remote AND url LIKE 'http://%'
UNION ALL SELECT 'AGT032', agent, subject, evidence FROM m WHERE remote AND allowed_tools = ''
UNION ALL SELECT 'AGT050', agent, subject, evidence FROM m WHERE command = 'npx' AND args IN ('-y,@scope/server', 'server')"""))  # fmt: skip
def server_findings(spark, sf_dir):
    return rules.server_rules(facts(spark, sf_dir))


@register("identity_findings", RULED + """
SELECT rule_id, agent, subject, evidence FROM fnd WHERE rule_id LIKE 'IDN%'""")
def identity_findings(spark, sf_dir):
    return rules.identity_rules(facts(spark, sf_dir))


@register("capability_findings", RULED + """
SELECT rule_id, agent, subject, evidence FROM fnd WHERE rule_id LIKE 'CAP%'""")
def capability_findings(spark, sf_dir):
    fs = facts(spark, sf_dir)
    return rules.agent_rules(fs).filter("rule_id like 'CAP%'").unionByName(rules.approval_rules(fs))


@register("resource_findings", RULED + """
SELECT rule_id, agent, subject, evidence FROM fnd WHERE rule_id LIKE 'DATA%' OR rule_id = 'AGT010'""")
def resource_findings(spark, sf_dir):
    return rules.agent_rules(facts(spark, sf_dir)).filter("rule_id like 'DATA%' or rule_id = 'AGT010'")


@register("network_findings", RULED + """
SELECT rule_id, agent, subject, evidence FROM fnd WHERE rule_id LIKE 'NET%'""")
def network_findings(spark, sf_dir):
    return rules.agent_rules(facts(spark, sf_dir)).filter("rule_id like 'NET%'")


@register("attack_paths", RULED + """
SELECT rule_id, agent, subject, evidence FROM fnd WHERE rule_id LIKE 'PATH%'""")
def attack_paths(spark, sf_dir):
    fs = facts(spark, sf_dir)
    return rules.path_rules(fs).unionByName(rules.agent_rules(fs).filter("rule_id like 'PATH%'"))


@register("findings", RULED + "\nSELECT * FROM found")
def findings(spark, sf_dir):
    return rules.evaluate(facts(spark, sf_dir)).withColumn("owasp", F.array_join("owasp", ","))


@register("findings_by_layer", RULED + """
SELECT CAST(l.layer AS INTEGER) AS layer, count(f.rule_id) AS n, max(f.severity) AS worst FROM (SELECT unnest([1, 2, 3, 4, 5]) AS layer) l LEFT JOIN found f ON f.layer = l.layer GROUP BY l.layer""")
def findings_by_layer(spark, sf_dir):
    return rules.by_layer(rules.evaluate(facts(spark, sf_dir)))


@register("findings_by_context", RULED + """
SELECT x.source_context, count(f.rule_id) AS n FROM (SELECT unnest(['runtime', 'cli', 'application-support', 'test', 'example', 'tutorial', 'notebook', 'template-generated', 'unknown']) AS source_context) x
LEFT JOIN found f ON f.source_context = x.source_context GROUP BY x.source_context""")
def findings_by_context(spark, sf_dir):
    return rules.by_context(rules.evaluate(facts(spark, sf_dir)))


@register("findings_at_runtime", RULED + """
SELECT * FROM found WHERE source_context NOT IN ('test', 'example', 'notebook', 'application-support')""")
def findings_at_runtime(spark, sf_dir):
    """What remains when findings of tests, examples, notebooks and support code are left out before the gates."""
    kept, _ = rules.exclude_contexts(rules.evaluate(facts(spark, sf_dir)), ["test", "example", "notebook", "application-support"])
    return kept.withColumn("owasp", F.array_join("owasp", ","))


@register("findings_by_risk", RULED + Q.RISK_ROWS)
def findings_by_risk(spark, sf_dir):
    return rules.by_risk(rules.evaluate(facts(spark, sf_dir)))


@register("approval_contract", sql("agents tools policies", """,
t AS (SELECT a.name AS agent, t.name, t.approval, t.agent_key, unnest(string_split(t.caps, ',')) AS cap FROM f_tools t JOIN f_agents a ON t.agent_key = a.agent_key),
h AS (SELECT DISTINCT t.agent, t.name, t.approval FROM t JOIN f_policies p ON p.agent_key = t.agent_key WHERE ',' || p.require_approval_for || ',' LIKE '%,' || t.cap || ',%' AND t.cap <> '' AND t.approval IS NOT TRUE)
SELECT 'authority-v1:' || substr(sha256(agent || chr(0) || 'tool' || chr(0) || name), 1, 20) AS relationship_id, agent, 'require_approval_for' AS clause, 'approval' AS dimension, CASE WHEN approval IS FALSE THEN 'violation' ELSE 'unresolved' END AS status,
  CASE WHEN approval IS FALSE THEN 'required_approval_explicitly_disabled' ELSE 'required_approval_not_proven' END AS reason, CASE WHEN approval IS FALSE THEN 'approval=false' ELSE '' END AS observed FROM h"""))  # fmt: skip
def approval_contract(spark, sf_dir):
    fs = facts(spark, sf_dir)
    return policy.approvals(authority.tool_relationships(fs), fs.policies)


CLAUSES = TOOL_ROWS + """,
sel AS (SELECT agent_key, owner_name, selector AS v FROM f_resources), tgt AS (SELECT agent_key, owner_name, target AS v FROM f_destinations),
vals AS (
  SELECT relationship_id, agent, agent_key, 'capabilities' AS dimension, unnest(string_split(caps, ',')) AS v FROM trel WHERE caps <> ''
  UNION ALL SELECT t.relationship_id, t.agent, t.agent_key, 'resources', s.v FROM trel t JOIN sel s ON s.agent_key = t.agent_key AND s.owner_name = t.target_name
  UNION ALL SELECT t.relationship_id, t.agent, t.agent_key, 'destinations', s.v FROM trel t JOIN tgt s ON s.agent_key = t.agent_key AND s.owner_name = t.target_name
  UNION ALL SELECT relationship_id, agent, agent_key, 'identities', identity FROM trel WHERE named
  UNION ALL SELECT relationship_id, agent, agent_key, 'iam_roles', unnest(string_split(roles, ',')) FROM trel WHERE named
  UNION ALL SELECT relationship_id, agent, agent_key, 'permissions', unnest(string_split(permissions, ',')) FROM trel WHERE named
  UNION ALL SELECT relationship_id, agent, agent_key, 'oauth_scopes', unnest(string_split(oauth_scopes, ',')) FROM trel WHERE named),
dims AS (SELECT relationship_id, agent, agent_key, 'capabilities' AS dimension, caps <> '' AS known FROM trel UNION ALL SELECT relationship_id, agent, agent_key, 'resources', resourced FROM trel UNION ALL SELECT relationship_id, agent, agent_key, 'destinations', aimed FROM trel
  UNION ALL SELECT relationship_id, agent, agent_key, unnest(['identities', 'iam_roles', 'permissions', 'oauth_scopes']), named FROM trel),
modes AS (SELECT DISTINCT agent_key, mode, dimension FROM f_clauses),
hit AS (SELECT DISTINCT v.relationship_id, v.agent, v.agent_key, v.dimension, v.v, m.mode,
    EXISTS (SELECT 1 FROM f_clauses c WHERE c.agent_key = v.agent_key AND c.dimension = v.dimension AND c.mode = m.mode AND v.v GLOB c.pattern) AS ok
  FROM vals v JOIN modes m ON m.agent_key = v.agent_key AND m.dimension = v.dimension WHERE v.v <> ''),
results AS (
  SELECT d.relationship_id, d.agent, m.mode || '.' || d.dimension AS clause, d.dimension, 'unresolved' AS status, d.dimension || '_evidence_unknown' AS reason, '' AS observed FROM dims d JOIN modes m ON m.agent_key = d.agent_key AND m.dimension = d.dimension WHERE NOT d.known
  UNION ALL SELECT relationship_id, agent, 'deny.' || dimension, dimension, 'violation', 'denied_' || dimension || '_observed', string_agg(v, ',' ORDER BY v) FROM hit WHERE mode = 'deny' AND ok GROUP BY relationship_id, agent, dimension
  UNION ALL SELECT relationship_id, agent, 'allow.' || dimension, dimension, 'violation', dimension || '_outside_allowlist', string_agg(v, ',' ORDER BY v) FROM hit WHERE mode = 'allow' AND NOT ok GROUP BY relationship_id, agent, dimension)"""


@register("contract_results", sql(TOOL_VIEWS + " clauses", CLAUSES + "\nSELECT * FROM results"))
def contract_results(spark, sf_dir):
    fs = facts(spark, sf_dir)
    return policy.evaluate(policy.observations(authority.tool_relationships(fs)), fs.clauses)


@register("contract_report", sql(TOOL_VIEWS + " clauses", CLAUSES + """,
w AS (SELECT relationship_id, max(CASE WHEN status = 'violation' THEN 1 ELSE 0 END) AS bad FROM results GROUP BY relationship_id)
SELECT t.agent, count(*) AS relationships, count(*) FILTER (WHERE w.bad = 1) AS violation, count(*) FILTER (WHERE w.bad = 0) AS unresolved, count(*) FILTER (WHERE w.bad IS NULL) AS compliant
FROM trel t LEFT JOIN w ON w.relationship_id = t.relationship_id WHERE t.agent_key IN (SELECT agent_key FROM f_clauses) GROUP BY t.agent"""))  # fmt: skip
def contract_report(spark, sf_dir):
    fs = facts(spark, sf_dir)
    rows = authority.tool_relationships(fs)
    return policy.report(rows, policy.evaluate(policy.observations(rows), fs.clauses), fs.clauses)


@register("policy_proposal", sql(TOOL_VIEWS, CLAUSES.split(",\ndims AS")[0] + """
SELECT agent, dimension, string_agg(v, ',' ORDER BY v) AS patterns FROM (SELECT DISTINCT agent, dimension, v FROM vals WHERE v <> '' AND v <> '*') GROUP BY agent, dimension"""))  # fmt: skip
def policy_proposal(spark, sf_dir):
    return policy.propose(authority.tool_relationships(facts(spark, sf_dir)))


RECONCILED = """,
req AS (SELECT DISTINCT agent_key, role, permission FROM f_grants WHERE required), dep AS (SELECT DISTINCT agent_key, role, permission FROM f_grants WHERE NOT conditional),
has AS (SELECT DISTINCT agent_key FROM f_grants), cond AS (SELECT DISTINCT agent_key FROM f_grants WHERE conditional),
x AS (
  SELECT d.agent_key, 'er' AS k, d.role AS v FROM dep d WHERE d.agent_key % 2 = 0 AND d.role NOT IN (SELECT role FROM req r WHERE r.agent_key = d.agent_key)
  UNION SELECT d.agent_key, 'ep', d.permission FROM dep d WHERE d.agent_key % 3 = 0 AND d.permission NOT IN (SELECT permission FROM req r WHERE r.agent_key = d.agent_key)
  UNION SELECT r.agent_key, 'mr', r.role FROM req r WHERE r.role NOT IN (SELECT role FROM dep d WHERE d.agent_key = r.agent_key)
  UNION SELECT r.agent_key, 'mp', r.permission FROM req r WHERE r.permission NOT IN (SELECT permission FROM dep d WHERE d.agent_key = r.agent_key)),
rec AS (SELECT a.name AS agent, coalesce(string_agg(CASE WHEN k = 'er' THEN v END, ',' ORDER BY v), '') AS excess_roles, coalesce(string_agg(CASE WHEN k = 'mr' THEN v END, ',' ORDER BY v), '') AS missing_roles,
    coalesce(string_agg(CASE WHEN k = 'ep' THEN v END, ',' ORDER BY v), '') AS excess_permissions, coalesce(string_agg(CASE WHEN k = 'mp' THEN v END, ',' ORDER BY v), '') AS missing_permissions,
    concat_ws(',', CASE WHEN a.agent_key IN (SELECT agent_key FROM cond) THEN 'conditional_roles' END, CASE WHEN a.agent_key NOT IN (SELECT agent_key FROM has) THEN 'deployed_identity' END,
      CASE WHEN a.agent_key % 3 <> 0 THEN 'required_permissions' END, CASE WHEN a.agent_key % 2 <> 0 THEN 'required_roles' END) AS unresolved
  FROM f_agents a LEFT JOIN x ON x.agent_key = a.agent_key GROUP BY a.agent_key, a.name),
fin AS (SELECT *, CASE WHEN excess_roles || excess_permissions <> '' AND missing_roles || missing_permissions <> '' THEN 'mixed' WHEN excess_roles || excess_permissions <> '' THEN 'excess_authority'
    WHEN missing_roles || missing_permissions <> '' THEN 'missing_authority' WHEN unresolved <> '' THEN 'unresolved' ELSE 'aligned' END AS status FROM rec)"""


def _reconciled(spark, sf_dir):
    fs = facts(spark, sf_dir)
    complete = fs.agents.select("agent_key", (F.col("agent_key") % 2 == 0).alias("roles_complete"), (F.col("agent_key") % 3 == 0).alias("permissions_complete"))
    return reconcile.reconcile(fs.agents, reconcile.required_authority(fs.grants.filter("required")), reconcile.deployed_authority(fs.grants), complete)


@register("reconciliation", sql("agents grants", RECONCILED + "\nSELECT * FROM fin"))
def reconciliation(spark, sf_dir):
    rows = _reconciled(spark, sf_dir)
    return rows.select("agent", *[LIST(c) for c in ("excess_roles", "missing_roles", "excess_permissions", "missing_permissions", "unresolved")], "status")


@register("reconciliation_summary", sql("agents grants", RECONCILED + """
SELECT status, count(*) AS n FROM fin GROUP BY status"""))  # fmt: skip
def reconciliation_summary(spark, sf_dir):
    return _reconciled(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@register("deployment_drift", sql("grants", """,
b AS (SELECT DISTINCT agent_key, role, permission FROM f_grants WHERE base), h AS (SELECT DISTINCT agent_key, role, permission FROM f_grants WHERE NOT base),
x AS (SELECT agent_key, 'ra' AS k, role AS v FROM h WHERE role NOT IN (SELECT role FROM b WHERE b.agent_key = h.agent_key) UNION SELECT agent_key, 'rr', role FROM b WHERE role NOT IN (SELECT role FROM h WHERE b.agent_key = h.agent_key)
  UNION SELECT agent_key, 'pa', permission FROM h WHERE permission NOT IN (SELECT permission FROM b WHERE b.agent_key = h.agent_key) UNION SELECT agent_key, 'pr', permission FROM b WHERE permission NOT IN (SELECT permission FROM h WHERE b.agent_key = h.agent_key))
SELECT agent_key, coalesce(string_agg(CASE WHEN k = 'ra' THEN v END, ',' ORDER BY v), '') AS roles_added, coalesce(string_agg(CASE WHEN k = 'rr' THEN v END, ',' ORDER BY v), '') AS roles_removed,
  coalesce(string_agg(CASE WHEN k = 'pa' THEN v END, ',' ORDER BY v), '') AS permissions_added, coalesce(string_agg(CASE WHEN k = 'pr' THEN v END, ',' ORDER BY v), '') AS permissions_removed,
  count(*) FILTER (WHERE k IN ('ra', 'pa')) > 0 AS regressed, count(*) FILTER (WHERE k IN ('rr', 'pr')) > 0 AND count(*) FILTER (WHERE k IN ('ra', 'pa')) = 0 AS improved FROM x GROUP BY agent_key"""))  # fmt: skip
def deployment_drift(spark, sf_dir):
    g = facts(spark, sf_dir).grants
    return reconcile.drift(g.filter("base"), g.filter("not base"))


@register("capability_inference", """
WITH w AS (SELECT DISTINCT event_type || '_' || CASE user_id % 6 WHEN 0 THEN 'send-email' WHEN 1 THEN 'delete.file' WHEN 2 THEN 'run_shell' WHEN 3 THEN 'get_secret' WHEN 4 THEN 'admin-policy' ELSE 'noop' END AS name FROM events),
p AS (SELECT name, regexp_replace(name, '[_.-]+', ' ', 'g') AS n FROM w)
SELECT name, concat_ws(',', CASE WHEN regexp_matches(n, '(?i)\\b(read|search|lookup|get|retrieve|document|file|query|list)\\b') THEN 'data.read' END, CASE WHEN regexp_matches(n, '(?i)\\b(write|update|create|modify|edit|patch|apply)\\b') THEN 'data.write' END,
  CASE WHEN regexp_matches(n, '(?i)\\b(delete|remove|destroy|purge|drop|terminate)\\b') THEN 'destructive.write' END, CASE WHEN regexp_matches(n, '(?i)\\b(send|email|post|publish|upload|notify|message)\\b') THEN 'external.write' END,
  CASE WHEN regexp_matches(n, '(?i)\\b(admin|iam|permission|role|policy|grant)\\b') THEN 'identity.admin' END, CASE WHEN regexp_matches(n, '(?i)\\b(send|email|post|publish|upload|notify|message|http|https|web|request|fetch|browser|url|api)\\b') THEN 'network.external' END,
  CASE WHEN regexp_matches(n, '(?i)\\b(shell|exec|execute|command|terminal|bash|powershell)\\b') THEN 'process.execute' END, CASE WHEN regexp_matches(n, '(?i)\\b(secret|credential|token|password|key|vault)\\b') THEN 'secrets.read' END) AS capabilities FROM p""".replace("\\\\", "\\"))  # fmt: skip
def capability_inference(spark, sf_dir):
    words = F.when(F.col("user_id") % 6 == 0, "send-email").when(F.col("user_id") % 6 == 1, "delete.file").when(F.col("user_id") % 6 == 2, "run_shell").when(F.col("user_id") % 6 == 3, "get_secret").when(F.col("user_id") % 6 == 4, "admin-policy").otherwise("noop")
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("_", "event_type", words).alias("name")).distinct()
    return names.select("name", F.array_join(X.infer_capabilities(F.col("name")), ",").alias("capabilities"))


def _snapshots(spark, sf_dir, read=facts):
    """Base and head: later, some tools lose their approval, others gain capabilities, destinations or an identity."""
    from dataclasses import replace

    fs = read(spark, sf_dir)
    k = F.substring("name", 6, 20).cast("long") % 10
    tools = fs.tools.filter(k != 9).withColumns({"approval": F.when(k == 0, F.lit(None)).otherwise(F.col("approval")), "caps": F.when(k == 1, F.array_union("caps", X.strings(("network.external",)))).otherwise(F.col("caps")), "identity": F.when(k == 2, "sa-0").otherwise(F.col("identity"))})
    return fs, replace(fs, tools=tools, destinations=fs.destinations.unionByName(fs.tools.filter(k == 3).select("agent_key", F.col("name").alias("owner_name"), F.lit("new.example.com").alias("target"), F.lit(False).alias("restricted"))))


@register("relationship_delta", sql(TOOL_VIEWS, Q.HEAD + Q.SNAPSHOT + Q.of_head(Q.SNAPSHOT) + Q.DELTA + "\nSELECT * FROM dlt"))
def relationship_delta(spark, sf_dir):
    base, head = _snapshots(spark, sf_dir)
    return delta.relationship_delta(authority.tool_relationships(base), authority.tool_relationships(head))


@register("boundary_crossings", sql(TOOL_VIEWS, Q.HEAD + Q.SNAPSHOT + Q.of_head(Q.SNAPSHOT) + Q.CLASSES.format(name="cls", rows="snap") + Q.CLASSES.format(name="cls2", rows="snap_h") + Q.CROSSED))
def boundary_crossings(spark, sf_dir):
    base, head = (authority.boundaries(authority.tool_relationships(x)) for x in _snapshots(spark, sf_dir))
    return delta.crossing_summary(delta.boundary_crossings(base, head))


@register("finding_delta", sql(Q.RULE_VIEWS, Q.RULES + Q.HEAD + Q.of_head(Q.RULES) + """,
b AS (SELECT fingerprint, max(evidence) AS e FROM found GROUP BY fingerprint), h AS (SELECT fingerprint, max(evidence) AS e FROM found_h GROUP BY fingerprint)
SELECT coalesce(b.fingerprint, h.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'introduced' WHEN h.fingerprint IS NULL THEN 'resolved' ELSE 'changed' END AS change, FALSE AS worsened
FROM b FULL JOIN h ON b.fingerprint = h.fingerprint WHERE b.fingerprint IS NULL OR h.fingerprint IS NULL OR b.e <> h.e"""))
def finding_delta(spark, sf_dir):
    base, head = (rules.evaluate(x).select("fingerprint", "rule_id", "severity", "evidence") for x in _snapshots(spark, sf_dir))
    return delta.finding_delta(base, head)


@register("security_review", sql(TOOL_VIEWS + " clauses", Q.HEAD + Q.SNAPSHOT + Q.of_head(Q.SNAPSHOT) + Q.DELTA + CLAUSES + Q.of_head(CLAUSES) + """,
bad AS (SELECT relationship_id, string_agg(DISTINCT clause, ',' ORDER BY clause) AS violations FROM results_h h WHERE status = 'violation'
  AND NOT EXISTS (SELECT 1 FROM results b WHERE b.relationship_id = h.relationship_id AND b.clause = h.clause AND b.status = h.status AND b.reason = h.reason) GROUP BY relationship_id)
SELECT d.*, coalesce(x.violations, '') AS violations FROM dlt d LEFT JOIN bad x ON x.relationship_id = d.relationship_id WHERE d.change = 'added' OR d.reasons <> ''"""))
def security_review(spark, sf_dir):
    base, head = _snapshots(in_place(spark), sf_dir, facts_by_agent)
    b, h = authority.tool_relationships(base), authority.tool_relationships(head)
    if delta.keys_agree(base, head):
        return delta.security_review_by_key(b, h, base.clauses, head.clauses, agent_parts(spark))
    changed = delta.result_delta(policy.evaluate(policy.observations(b), base.clauses), policy.evaluate(policy.observations(h), head.clauses))
    return delta.security_review(delta.relationship_delta(b, h), changed)


@register("mcp_authority", sql("agents mcp_servers", """
SELECT a.name AS agent, m.name AS server, CASE WHEN authenticated THEN 'authenticated' WHEN NOT authenticated THEN 'unauthenticated' ELSE 'unknown' END AS authentication,
  CASE WHEN m.allowed_tools <> '' THEN 'explicit_allowlist' WHEN m.denied_tools <> '' THEN 'denylist_only' WHEN m.dynamic_tool_filter THEN 'dynamic_filter' ELSE 'unrestricted_or_unknown' END AS tool_scope, url IS NOT NULL AS remote,
  concat_ws(',', CASE WHEN url IS NOT NULL AND authenticated IS NULL THEN 'authentication' END, CASE WHEN identity IS NULL THEN 'identity' END, CASE WHEN url IS NULL AND command IS NULL THEN 'destination' END, CASE WHEN m.allowed_tools = '' THEN 'tool_catalogue' END) AS gaps
FROM f_mcp_servers m JOIN f_agents a ON m.agent_key = a.agent_key"""))  # fmt: skip
def mcp_authority(spark, sf_dir):
    return mcp.effective(facts(spark, sf_dir))


@register("graph_nodes", sql("agents tools mcp_servers identities inputs destinations resources", """
SELECT 'agent' AS kind, count(DISTINCT name) AS n FROM f_agents UNION ALL SELECT 'tool', count(DISTINCT (agent_key, name)) FROM f_tools UNION ALL SELECT 'mcp_server', count(DISTINCT (m.agent_key, m.name)) FROM f_mcp_servers m JOIN f_agents a ON a.agent_key = m.agent_key
UNION ALL SELECT 'identity', count(DISTINCT (agent_key, name)) FROM f_identities UNION ALL SELECT 'input', count(DISTINCT (agent_key, name)) FROM f_inputs
UNION ALL SELECT 'network_destination', count(DISTINCT target) FROM f_destinations UNION ALL SELECT 'data_resource', count(DISTINCT selector) FROM f_resources
UNION ALL SELECT 'model', 0 UNION ALL SELECT 'prompt', 0 UNION ALL SELECT 'memory', 0"""))  # fmt: skip
def graph_nodes(spark, sf_dir):
    return graph.inventory(graph.nodes(facts(spark, sf_dir)))


@register("graph_edges", sql("agents delegations tools mcp_servers identities inputs destinations resources", PATHS + """
SELECT 'INVOKES' AS kind, (SELECT count(DISTINCT (agent_key, name)) FROM f_tools) + (SELECT count(DISTINCT (m.agent_key, m.name)) FROM f_mcp_servers m JOIN f_agents a ON a.agent_key = m.agent_key) AS n
UNION ALL SELECT 'USES_IDENTITY', count(DISTINCT (t.agent_key, t.name, t.identity)) FROM f_tools t JOIN f_identities i ON i.agent_key = t.agent_key AND i.name = t.identity
UNION ALL SELECT 'CONNECTS_TO', count(DISTINCT (agent_key, owner_name, target)) FROM f_destinations UNION ALL SELECT 'READS_FROM', count(DISTINCT (agent_key, owner_name, selector)) FROM f_resources
UNION ALL SELECT 'RECEIVES_INPUT_FROM', count(DISTINCT (agent_key, name)) FROM f_inputs UNION ALL SELECT 'DELEGATES_TO', count(*) FROM edge
UNION ALL SELECT 'CAN_REACH_AUTHORITY', count(DISTINCT (w.root, w.leaf, i.name)) FROM walk w JOIN f_agents a ON a.name = w.leaf JOIN f_identities i ON i.agent_key = a.agent_key WHERE w.root <> w.leaf"""))  # fmt: skip
def graph_edges(spark, sf_dir):
    return graph.kind_counts(graph.edges(facts(spark, sf_dir)))
