"""SQL of the questions that need many steps: every rule, boundary classes, and two snapshots side by side."""

from __future__ import annotations

import re

from grantscope.operators.authority import BOUNDARY_RANKS
from grantscope.operators.rules import REGISTRY, RISKS

PRIVILEGED = "',(process.execute|destructive.write|external.write|data.write|secrets.read|identity.admin),'"
OUTBOUND = "',(network.external|external.write),'"
RELATIONSHIP = "'authority-v1:' || substr(sha256({a} || chr(0) || '{k}' || chr(0) || {n}), 1, 20)"
#: Views that RULES reads.
RULE_VIEWS = "agents tools tool_details unbound_tools identities global_identities resources destinations mcp_servers inputs policies flows"

_REGISTRY = ", ".join(f"('{r}', {layer}, {severity}, '{o}')" for r, layer, severity, o in REGISTRY)
_RISKS = ", ".join(f"('ASI{i:02}', '{t}')" for i, t in enumerate(RISKS, 1))
_RANKS = ", ".join(f"('{f}', '{c}', {i})" for f, order in BOUNDARY_RANKS.items() for i, c in enumerate(order))

RULES = f""",
bcap AS (SELECT DISTINCT agent_key, unnest(string_split(caps, ',')) AS cap FROM f_tools UNION SELECT agent_key, unnest(CASE WHEN url IS NOT NULL THEN ['mcp.remote', 'network.external'] ELSE ['mcp.local'] END) FROM f_mcp_servers),
acap AS (SELECT a.agent_key, a.name AS agent, ',' || coalesce(string_agg(c.cap, ',' ORDER BY c.cap), '') || ',' AS c FROM f_agents a LEFT JOIN bcap c ON c.agent_key = a.agent_key AND c.cap <> '' GROUP BY a.agent_key, a.name),
one AS (SELECT s.agent, s.agent_key, x.cap FROM (SELECT agent_key, unnest(string_split(trim(c, ','), ',')) AS cap FROM acap) x JOIN acap s ON s.agent_key = x.agent_key WHERE x.cap <> ''),
pol AS (SELECT agent_key, ',' || required || ',' AS r, ',' || denied || ',' AS d, max_privileged AS m, allowed_resources, allowed_destinations, ',' || require_approval_for || ',' AS q FROM f_policies),
tl AS (SELECT a.name AS agent, a.framework, a.a2a_exposed, a.approval_plugin OR a.before_tool_callback AS held, t.*, d.* EXCLUDE (agent_key, name), ',' || t.caps || ',' AS c, t.approval IS NOT TRUE AS loose,
    'approval=' || coalesce(CASE WHEN t.approval THEN 'true' WHEN NOT t.approval THEN 'false' END, 'unknown') AS ev, regexp_matches(',' || t.caps || ',', {PRIVILEGED}) AS priv, regexp_matches(',' || t.caps || ',', {OUTBOUND}) AS outb,
    'known_as=' || coalesce(d.builtin, d.executor, d.part_of, '') AS known
  FROM f_tools t JOIN f_agents a ON t.agent_key = a.agent_key LEFT JOIN f_tool_details d ON d.agent_key = t.agent_key AND d.name = t.name),
unt AS (SELECT DISTINCT agent_key FROM f_inputs WHERE trust = 'untrusted' OR kind IN ('web', 'browser', 'email', 'document', 'retrieval', 'external', 'webhook')),
rs AS (SELECT r.agent_key, r.selector, r.classification, t.c FROM f_resources r JOIN tl t ON t.agent_key = r.agent_key AND t.name = r.owner_name),
sens AS (SELECT DISTINCT agent_key FROM rs WHERE classification IN ('confidential', 'restricted', 'secret', 'highly-confidential', 'regulated') AND regexp_matches(c, ',(data.read|secrets.read),')),
tg AS (SELECT DISTINCT agent_key, target, restricted FROM f_destinations),
brd AS (SELECT DISTINCT agent_key FROM tg WHERE target IN ('*', '0.0.0.0/0') OR target LIKE '*.%' OR NOT restricted),
opn AS (SELECT t.agent_key, string_agg(DISTINCT {RELATIONSHIP.format(a='t.agent', k='tool', n='t.name')}, ',' ORDER BY {RELATIONSHIP.format(a='t.agent', k='tool', n='t.name')}) AS ids FROM tl t
  LEFT JOIN (SELECT DISTINCT agent_key, owner_name FROM f_destinations) e ON e.agent_key = t.agent_key AND e.owner_name = t.name
  WHERE t.outb AND e.owner_name IS NULL AND NOT (t.c LIKE '%,network.external,%' AND coalesce(t.network_scope IN ('fixed_managed_service', 'explicit_destination'), FALSE)) GROUP BY t.agent_key),
ag AS (SELECT s.agent, s.agent_key, s.c, regexp_matches(s.c, {OUTBOUND}) AS outb, s.agent_key IN (SELECT agent_key FROM unt) AS u, s.agent_key IN (SELECT agent_key FROM sens) AS sen, s.agent_key IN (SELECT agent_key FROM brd) AS broad,
    s.agent_key IN (SELECT agent_key FROM tg) AS aimed, s.agent_key IN (SELECT agent_key FROM tl WHERE outb AND loose) AS loose_out,
    s.agent_key IN (SELECT agent_key FROM tl WHERE outb AND coalesce(network_scope <> 'fixed_managed_service', TRUE)) AS free, s.agent_key IN (SELECT agent_key FROM tl WHERE c LIKE '%,secrets.read,%') AS sec, o.ids
  FROM acap s LEFT JOIN opn o ON o.agent_key = s.agent_key),
srv AS (SELECT a.name AS agent, m.name AS subject, coalesce(m.url, m.command, '') AS evidence, m.*, m.url IS NOT NULL AND m.url NOT LIKE '%//localhost%' AND m.url NOT LIKE '%//127.%' AS remote FROM f_mcp_servers m JOIN f_agents a ON m.agent_key = a.agent_key),
idn AS (SELECT a.name AS agent, i.name AS subject, roles, permissions, oauth_scopes, credential_source FROM f_identities i JOIN f_agents a ON i.agent_key = a.agent_key
  UNION ALL SELECT NULL, name, roles, permissions, oauth_scopes, credential_source FROM f_global_identities g WHERE NOT EXISTS (SELECT 1 FROM f_identities i WHERE i.name = g.name AND i.provider = g.provider)),
flw AS (SELECT CASE WHEN source_kind <> 'secret_value' AND sink_kind = 'process_execute' THEN 'PATH001' WHEN source_kind <> 'secret_value' AND sink_kind = 'memory_write' THEN 'PATH007' WHEN source_kind = 'secret_value' AND sink_kind = 'external_send' THEN 'PATH003' END AS rule_id,
    a.name AS agent, flow_id AS subject, 'basis=static_dataflow;' || source_kind || '>' || sink_kind AS evidence FROM f_flows f JOIN f_agents a ON a.agent_key = f.agent_key WHERE reachability = 'proven_agent_reachable' AND confidence = 'supported'),
fnd AS (
  SELECT 'AGT020' AS rule_id, agent, name AS subject, ev AS evidence FROM tl WHERE loose AND c LIKE '%,process.execute,%' AND kind <> 'delegated_agent'
  UNION SELECT 'AGT020', NULL, name, 'approval=' || coalesce(CASE WHEN approval THEN 'true' WHEN NOT approval THEN 'false' END, 'unknown') FROM f_unbound_tools WHERE caps LIKE '%process.execute%' AND approval IS NOT TRUE
  UNION SELECT 'AGT021', agent, name, ev FROM tl WHERE loose AND c LIKE '%,destructive.write,%'
  UNION SELECT 'AGT022', agent, name, ev FROM tl WHERE loose AND c LIKE '%,data.write,%' AND kind IN ('apply_patch', 'generic', 'function')
  UNION SELECT 'AGT023', agent, name, ev FROM tl WHERE loose AND c LIKE '%,computer.control,%' AND control_custom AND control_mutating AND NOT guardrails AND NOT held
  UNION SELECT 'AGT040', agent, name, ev FROM tl WHERE loose AND priv AND control_custom IS NOT TRUE AND NOT guardrails AND NOT held
  UNION SELECT 'ADK001', agent, '', 'privileged_tools=' || count(*) FROM tl WHERE framework = 'google-adk' AND priv AND NOT held GROUP BY agent HAVING bool_and(loose AND NOT guardrails)
  UNION SELECT 'ADK011', agent, '', 'privileged_tools=' || count(*) FROM tl WHERE framework = 'google-adk' AND priv AND NOT held GROUP BY agent HAVING bool_or(a2a_exposed)
  UNION SELECT unnest(list_filter([
      CASE WHEN executor = 'UnsafeLocalCodeExecutor' OR (part_of = 'adk_code_executor' AND sandboxed IS FALSE) THEN 'ADK002' END, CASE WHEN builtin = 'EnvironmentToolset' AND environment = 'LocalEnvironment' THEN 'ADK003' END,
      CASE WHEN builtin = 'ExecuteBashTool' AND NOT bash_restrictive THEN 'ADK004' END, CASE WHEN builtin = 'ComputerUseToolset' AND loose AND NOT guardrails THEN 'ADK005' END, CASE WHEN builtin = 'BigQueryToolset' AND c LIKE '%,data.write,%' THEN 'ADK006' END,
      CASE WHEN builtin IN ('GmailToolset', 'OpenAPIToolset') AND NOT filtered THEN 'ADK007' END, CASE WHEN part_of = 'adk_agent_tool' AND include_plugins IS FALSE THEN 'ADK008' END, CASE WHEN part_of = 'adk_a2a_remote' AND agent_card LIKE 'http://%' THEN 'ADK009' END,
      CASE WHEN part_of = 'adk_a2a_remote' AND card_authenticated IS NOT TRUE THEN 'ADK010' END, CASE WHEN part_of = 'adk_code_executor' AND sandboxed AND limits_applicable AND NOT limits_complete THEN 'ADK012' END], lambda x: x IS NOT NULL)), agent, name, known FROM tl WHERE framework = 'google-adk'
  UNION SELECT 'AGT001', agent, subject, evidence FROM srv WHERE transport = 'stdio' AND (',' || args || ',' LIKE '%,/,%' OR ',' || args || ',' LIKE '%,.,%')
  UNION SELECT 'AGT030', agent, subject, evidence FROM srv WHERE remote AND authenticated IS FALSE
  UNION SELECT 'AGT031', agent, subject, evidence FROM srv WHERE remote AND url LIKE 'http://%'
  UNION SELECT 'AGT032', agent, subject, evidence FROM srv WHERE remote AND allowed_tools = ''
  UNION SELECT 'AGT050', agent, subject, evidence FROM srv WHERE command = 'npx' AND args IN ('-y,@scope/server', 'server')
  UNION SELECT 'CAP001', o.agent, '', string_agg(o.cap, ',' ORDER BY o.cap) FROM one o JOIN pol p ON p.agent_key = o.agent_key WHERE p.r <> ',,' AND p.r NOT LIKE '%,' || o.cap || ',%' GROUP BY o.agent
  UNION SELECT 'CAP002', o.agent, '', string_agg(o.cap, ',' ORDER BY o.cap) FROM one o JOIN pol p ON p.agent_key = o.agent_key WHERE p.d LIKE '%,' || o.cap || ',%' GROUP BY o.agent
  UNION SELECT 'CAP003', o.agent, '', string_agg(o.cap, ',' ORDER BY o.cap) FROM one o LEFT JOIN pol p ON p.agent_key = o.agent_key WHERE regexp_matches(',' || o.cap || ',', {PRIVILEGED}) GROUP BY o.agent, p.m HAVING count(*) > coalesce(p.m, 3)
  UNION SELECT 'CAP004', agent, '', '' FROM acap WHERE c LIKE '%,process.execute,%' AND c LIKE '%,network.external,%'
  UNION SELECT 'CAP005', agent, '', '' FROM acap WHERE c LIKE '%,data.read,%' AND (c LIKE '%,data.write,%' OR c LIKE '%,destructive.write,%')
  UNION SELECT 'CAP006', t.agent, x.cap, '' FROM tl t JOIN pol p ON p.agent_key = t.agent_key JOIN one x ON x.agent_key = t.agent_key WHERE t.loose AND t.c LIKE '%,' || x.cap || ',%' AND p.q LIKE '%,' || x.cap || ',%'
  UNION SELECT 'IDN001', agent, subject, '' FROM idn WHERE lower(replace(replace(roles, '_', ''), '-', '')) LIKE '%owner%' OR lower(roles) LIKE '%editor%' OR lower(roles) LIKE '%admin%'
  UNION SELECT 'IDN002', agent, subject, '' FROM idn WHERE permissions LIKE '%.*%'
  UNION SELECT 'IDN003', agent, subject, '' FROM idn WHERE oauth_scopes LIKE '%/auth/drive%'
  UNION SELECT 'IDN004', agent, subject, '' FROM idn WHERE credential_source IN ('hardcoded', 'source', 'plaintext', 'file')
  UNION SELECT 'AGT010', agent, '', '' FROM ag WHERE sen AND outb AND loose_out
  UNION SELECT 'DATA001', a.name, '', string_agg(DISTINCT r.selector, ',' ORDER BY r.selector) FROM rs r JOIN f_agents a ON a.agent_key = r.agent_key WHERE r.selector IN ('*', '/') GROUP BY a.name
  UNION SELECT 'DATA002', a.name, '', string_agg(DISTINCT r.selector, ',' ORDER BY r.selector) FROM rs r JOIN f_agents a ON a.agent_key = r.agent_key JOIN pol p ON p.agent_key = r.agent_key WHERE p.allowed_resources <> '' AND NOT (r.selector GLOB 'bucket/*' OR r.selector GLOB 'db/?rders') GROUP BY a.name
  UNION SELECT 'DATA003', agent, '', '' FROM ag WHERE sen AND (broad OR (outb AND NOT aimed AND free))
  UNION SELECT 'NET001', agent, '', '' FROM ag WHERE broad
  UNION SELECT 'NET002', agent, '', 'capabilities=' || concat_ws(',', CASE WHEN c LIKE '%,external.write,%' THEN 'external.write' END, CASE WHEN c LIKE '%,network.external,%' THEN 'network.external' END) || ';authority_relationship=' || ids FROM ag WHERE NOT broad AND ids IS NOT NULL
  UNION SELECT 'NET003', a.name, '', string_agg(DISTINCT d.target, ',' ORDER BY d.target) FROM tg d JOIN f_agents a ON a.agent_key = d.agent_key JOIN pol p ON p.agent_key = d.agent_key WHERE p.allowed_destinations <> '' AND NOT (d.target GLOB '*.internal' OR d.target GLOB 'api.*') GROUP BY a.name
  UNION SELECT rule_id, agent, subject, evidence FROM flw WHERE rule_id IS NOT NULL
  UNION SELECT 'PATH001', agent, name, 'basis=capability_cooccurrence' FROM tl WHERE loose AND c LIKE '%,process.execute,%' AND agent_key IN (SELECT agent_key FROM unt) AND agent NOT IN (SELECT agent FROM flw WHERE rule_id = 'PATH001')
  UNION SELECT 'PATH002', agent, name, 'basis=capability_cooccurrence' FROM tl WHERE loose AND c LIKE '%,destructive.write,%' AND agent_key IN (SELECT agent_key FROM unt)
  UNION SELECT 'PATH003', agent, name, 'basis=capability_cooccurrence' FROM tl WHERE loose AND outb AND agent_key IN (SELECT agent_key FROM sens)
  UNION SELECT 'PATH004', agent, '', '' FROM ag WHERE u AND sen AND c LIKE '%,process.execute,%'
  UNION SELECT 'PATH005', agent, '', '' FROM ag WHERE u AND sec AND free
  UNION SELECT 'PATH006', g.agent, '', string_agg(o.cap, ',' ORDER BY o.cap) FROM ag g JOIN one o ON o.agent_key = g.agent_key WHERE g.u AND o.cap IN ('process.execute', 'destructive.write', 'secrets.read', 'identity.admin') GROUP BY g.agent HAVING count(*) >= 2),
reg(rule_id, layer, severity, owasp) AS (VALUES {_REGISTRY}),
ctx AS (SELECT name AS agent, CASE min(path) WHEN 'tests/test_agent.py' THEN 'test' WHEN 'examples/demo/agent.py' THEN 'example' WHEN 'notebooks/run.ipynb' THEN 'notebook' WHEN 'scripts/deploy.py' THEN 'application-support' WHEN 'app/agents/main.py' THEN 'runtime' ELSE 'unknown' END AS source_context FROM f_agents GROUP BY name),
found AS (SELECT f.*, r.layer, r.severity, r.owasp, coalesce(x.source_context, 'unknown') AS source_context, 'finding-v1:' || substr(sha256(f.rule_id || chr(0) || coalesce(f.agent, '') || chr(0) || f.subject), 1, 20) AS fingerprint
  FROM fnd f JOIN reg r ON r.rule_id = f.rule_id LEFT JOIN ctx x ON x.agent = f.agent)"""

RISK_ROWS = f""",
rk(risk, title) AS (VALUES {_RISKS}), hit AS (SELECT *, unnest(string_split(owasp, ',')) AS risk FROM found WHERE owasp <> ''),
asd AS (SELECT DISTINCT unnest(string_split(owasp, ',')) AS risk FROM reg WHERE owasp <> ''),
cnt AS (SELECT risk, count(*) AS n, count(*) FILTER (WHERE source_context = 'runtime') AS at_runtime, max(severity) AS worst, count(DISTINCT rule_id) AS rules, count(DISTINCT agent) AS agents FROM hit GROUP BY risk)
SELECT k.risk, k.title, coalesce(n, 0) AS n, coalesce(at_runtime, 0) AS at_runtime, coalesce(rules, 0) AS rules, coalesce(agents, 0) AS agents, worst, CASE WHEN n > 0 THEN 'finding' WHEN a.risk IS NOT NULL THEN 'no_mapped_findings' ELSE 'not_assessed' END AS status,
  CASE WHEN a.risk IS NULL THEN 'not_assessed' WHEN at_runtime > 0 THEN 'finding' WHEN n > 0 THEN 'no_runtime_findings' ELSE 'no_mapped_findings' END AS runtime_status
FROM rk k LEFT JOIN cnt c ON c.risk = k.risk LEFT JOIN asd a ON a.risk = k.risk"""

#: The second snapshot's tools and destinations; see core._snapshots.
HEAD = """,
h_tools AS (SELECT agent_key, name, kind, CASE WHEN k = 1 AND ',' || caps || ',' NOT LIKE '%,network.external,%' THEN CASE WHEN caps = '' THEN 'network.external' ELSE caps || ',network.external' END ELSE caps END AS caps,
    CASE WHEN k = 0 THEN NULL ELSE approval END AS approval, guardrails, CASE WHEN k = 2 THEN 'sa-0' ELSE identity END AS identity, network_scope FROM (SELECT *, CAST(substr(name, 6) AS BIGINT) % 10 AS k FROM f_tools) x WHERE k <> 9),
h_destinations AS (SELECT * FROM f_destinations UNION ALL SELECT agent_key, name, 'new.example.com', FALSE FROM f_tools WHERE CAST(substr(name, 6) AS BIGINT) % 10 = 3)"""


def of_head(steps: str) -> str:
    """The same steps over the second snapshot, their names told apart."""
    own = re.findall(r"(?:^|, )(\w+)(?:\([\w, ]+\))? AS \((?:SELECT|VALUES|\n)", steps, re.M)
    for name in sorted(set(own), key=len, reverse=True):
        steps = re.sub(rf"(?<![\w.']){name}(?![\w.'])(?=\s|\)|,|\(|$)", f"{name}_h", steps)
    return re.sub(r"\bf_(tools|destinations)\b", r"h_\1", steps)


#: One snapshot's relationships of tools, with all that a delta compares.
SNAPSHOT = f""",
who AS (SELECT agent_key, name, min(coalesce(credential_source, '~null')) AS cs, min(roles) AS roles, min(permissions) AS permissions, min(oauth_scopes) AS oauth FROM f_identities GROUP BY agent_key, name),
selx AS (SELECT agent_key, owner_name, list_sort(list_distinct(list(selector))) AS v FROM f_resources GROUP BY agent_key, owner_name),
tarx AS (SELECT agent_key, owner_name, list_sort(list_distinct(list(target))) AS v, count(*) AS nt, count(*) FILTER (WHERE NOT restricted) AS nu FROM f_destinations GROUP BY agent_key, owner_name),
snap AS (SELECT {RELATIONSHIP.format(a='a.name', k='tool', n='t.name')} AS id, 'tool' AS target_kind, a.name AS agent, a.agent_key, t.name AS target_name, t.identity, w.name IS NOT NULL AS named, coalesce(w.cs <> '~null', FALSE) AS sourced, t.approval, t.guardrails, a.approval_plugin OR a.before_tool_callback AS held,
    t.kind, t.network_scope, CAST(NULL AS VARCHAR) AS scope, CASE WHEN t.caps = '' THEN [] ELSE list_sort(list_distinct(string_split(t.caps, ','))) END AS caps, CASE WHEN coalesce(w.roles, '') = '' THEN [] ELSE string_split(w.roles, ',') END AS roles,
    CASE WHEN coalesce(w.permissions, '') = '' THEN [] ELSE string_split(w.permissions, ',') END AS permissions, CASE WHEN coalesce(w.oauth, '') = '' THEN [] ELSE string_split(w.oauth, ',') END AS oauth, coalesce(s.v, []) AS selectors, coalesce(d.v, []) AS targets, coalesce(d.nt, 0) AS nt, coalesce(d.nu, 0) AS nu
  FROM f_tools t JOIN f_agents a ON a.agent_key = t.agent_key LEFT JOIN who w ON w.agent_key = t.agent_key AND w.name = t.identity LEFT JOIN selx s ON s.agent_key = t.agent_key AND s.owner_name = t.name LEFT JOIN tarx d ON d.agent_key = t.agent_key AND d.owner_name = t.name)"""

DELTA = """,
dlt AS (SELECT coalesce(h.id, b.id) AS relationship_id, coalesce(h.agent, b.agent) AS agent, coalesce(h.target_name, b.target_name) AS target_name, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
    CASE WHEN b.id IS NULL OR h.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN NOT list_has_all(b.caps, h.caps) THEN 'capabilities_added' END, CASE WHEN b.named AND h.named AND NOT list_has_all(b.roles, h.roles) THEN 'identity_roles_added' END,
      CASE WHEN b.named AND h.named AND NOT list_has_all(b.permissions, h.permissions) THEN 'identity_permissions_added' END, CASE WHEN b.named AND h.named AND NOT list_has_all(b.oauth, h.oauth) THEN 'identity_oauth_scopes_added' END,
      CASE WHEN NOT b.named AND h.named THEN 'identity_attached' END, CASE WHEN b.named AND h.named AND b.identity IS DISTINCT FROM h.identity THEN 'identity_changed' END,
      CASE WHEN (b.approval IS TRUE AND h.approval IS NOT TRUE) OR (b.guardrails AND NOT h.guardrails) OR (b.held AND NOT h.held) THEN 'approval_weakened' END,
      CASE WHEN NOT list_has_all(b.selectors, h.selectors) THEN 'resources_added' END, CASE WHEN NOT list_has_all(b.targets, h.targets) THEN 'destinations_added' END) END AS reasons
  FROM snap b FULL JOIN snap_h h ON b.id = h.id
  WHERE (b.id, b.identity, b.named, b.sourced, b.approval, b.guardrails, b.held, b.caps, b.roles, b.permissions, b.oauth, b.selectors, b.targets) IS DISTINCT FROM (h.id, h.identity, h.named, h.sourced, h.approval, h.guardrails, h.held, h.caps, h.roles, h.permissions, h.oauth, h.selectors, h.targets))"""

#: Servers as rows of a snapshot; they are the same in both.
SERVERS = f""",
srvs AS (SELECT {RELATIONSHIP.format(a='a.name', k='mcp_server', n='m.name')} AS id, 'mcp_server' AS target_kind, a.name AS agent, a.agent_key, m.name AS target_name, m.identity, w.name IS NOT NULL AS named, coalesce(w.cs <> '~null', FALSE) AS sourced, m.approval, m.guardrails, FALSE AS held,
    m.transport AS kind, CAST(NULL AS VARCHAR) AS network_scope, CASE WHEN m.allowed_tools <> '' THEN 'explicit_allowlist' WHEN m.denied_tools <> '' THEN 'denylist_only' WHEN m.dynamic_tool_filter THEN 'dynamic_filter' ELSE 'unrestricted_or_unknown' END AS scope,
    CASE WHEN m.url IS NOT NULL THEN ['mcp.remote', 'network.external'] ELSE ['mcp.local'] END AS caps, CASE WHEN coalesce(w.roles, '') = '' THEN [] ELSE string_split(w.roles, ',') END AS roles, CASE WHEN coalesce(w.permissions, '') = '' THEN [] ELSE string_split(w.permissions, ',') END AS permissions,
    CASE WHEN coalesce(w.oauth, '') = '' THEN [] ELSE string_split(w.oauth, ',') END AS oauth, [] AS selectors, [] AS targets, CASE WHEN m.url IS NOT NULL OR m.command IS NOT NULL THEN 1 ELSE 0 END AS nt, 0 AS nu
  FROM f_mcp_servers m JOIN f_agents a ON a.agent_key = m.agent_key LEFT JOIN who w ON w.agent_key = m.agent_key AND w.name = m.identity)"""

#: Boundary classes of the rows of {rows}, as (id, family, class).
CLASSES = """,
{name} AS (SELECT id, unnest(['mutation', 'network', 'identity', 'control', 'mcp_scope']) AS family, unnest([
    CASE WHEN list_contains(caps, 'identity.admin') THEN 'security_identity_sensitive_mutation' WHEN list_contains(caps, 'destructive.write') THEN 'destructive_mutation' WHEN list_contains(caps, 'external.write') THEN 'external_side_effect'
      WHEN list_contains(caps, 'data.write') THEN 'internal_mutation_unspecified' WHEN list_has_any(caps, ['process.execute', 'computer.control']) OR target_kind = 'mcp_server' OR len(caps) = 0 THEN 'unknown' ELSE 'no_mutation' END,
    CASE WHEN len(caps) = 0 THEN 'unknown' WHEN NOT list_contains(caps, 'network.external') THEN 'no_external_network' WHEN coalesce(network_scope IN ('fixed_managed_service', 'explicit_destination'), FALSE) OR (nt > 0 AND nu = 0) THEN 'provider_constrained_destination'
      WHEN list_contains(caps, 'external.write') THEN 'arbitrary_egress' ELSE 'internet_retrieval' END,
    CASE WHEN NOT named THEN 'unknown' WHEN len(list_filter(roles, lambda r: regexp_matches(lower(r), 'owner|admin|editor'))) > 0 OR len(list_filter(permissions, lambda p: p LIKE '%.*')) > 0 OR len(oauth) > 0 THEN 'broad_privileged_authority'
      WHEN len(roles) > 0 OR len(permissions) > 0 THEN 'iam_authority' ELSE 'workload_service_identity' END,
    CASE WHEN approval THEN 'mandatory_approval' WHEN guardrails OR held THEN 'guardrail_control' WHEN NOT approval THEN 'explicitly_no_approval' ELSE 'unknown' END,
    CASE WHEN target_kind <> 'mcp_server' THEN 'not_applicable' WHEN scope = 'dynamic_filter' THEN 'dynamic_scope' WHEN scope = 'unrestricted_or_unknown' THEN 'unknown' ELSE scope END]) AS class FROM {rows})"""

CROSSED = f""",
rnk(family, class, r) AS (VALUES {_RANKS}),
crs AS (SELECT b.family, CASE WHEN b.family = 'control' THEN CASE WHEN y.r > x.r THEN 'weakened' ELSE 'strengthened' END WHEN y.r > x.r THEN 'expanded' ELSE 'narrowed' END AS direction
  FROM cls b JOIN cls2 h ON b.id = h.id AND b.family = h.family JOIN rnk x ON x.family = b.family AND x.class = b.class JOIN rnk y ON y.family = h.family AND y.class = h.class WHERE x.r <> y.r)
SELECT family, direction, count(*) AS n FROM crs GROUP BY family, direction"""
