"""Rules in five layers: each a DataFrame of (rule_id, agent, subject, evidence) over the facts.

"Not approved" means approval is not true, so unknown counts; "unauthenticated" means known to be false.
Severity, layer and risk categories come from the registry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantscope.functions import expr as X

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
# Rule, layer, severity, risk categories.
REGISTRY = (
    ("AGT001", 1, 2, ""), ("AGT020", 1, 3, "ASI05"), ("AGT021", 1, 3, "ASI02"), ("AGT022", 1, 2, "ASI02"), ("AGT023", 1, 3, "ASI02"), ("AGT030", 1, 3, "ASI07"), ("AGT031", 1, 3, "ASI07"), ("AGT032", 1, 2, "ASI02"), ("AGT040", 1, 2, "ASI02"), ("AGT050", 1, 2, "ASI04"),
    ("ADK001", 1, 2, "ASI02"), ("ADK002", 1, 4, "ASI05"), ("ADK003", 1, 3, "ASI05"), ("ADK004", 1, 3, "ASI05"), ("ADK005", 1, 3, "ASI02"), ("ADK006", 1, 2, "ASI02"), ("ADK007", 1, 2, "ASI02"), ("ADK008", 1, 2, ""), ("ADK009", 1, 3, "ASI07"), ("ADK010", 1, 3, "ASI07"), ("ADK011", 1, 3, "ASI07"), ("ADK012", 1, 2, "ASI05"),
    ("CAP001", 2, 3, "ASI02"), ("CAP002", 2, 4, "ASI02"), ("CAP003", 2, 3, "ASI02"), ("CAP004", 2, 3, ""), ("CAP005", 2, 2, "ASI02"), ("CAP006", 2, 3, "ASI02"),
    ("IDN001", 3, 3, "ASI03"), ("IDN002", 3, 4, "ASI03"), ("IDN003", 3, 3, "ASI03"), ("IDN004", 3, 3, "ASI03"),
    ("AGT010", 4, 4, ""), ("DATA001", 4, 3, ""), ("DATA002", 4, 3, ""), ("DATA003", 4, 4, ""), ("NET001", 4, 3, ""), ("NET002", 4, 2, ""), ("NET003", 4, 3, ""),
    ("PATH001", 5, 4, "ASI01,ASI05"), ("PATH002", 5, 3, "ASI01,ASI02"), ("PATH003", 5, 4, ""), ("PATH004", 5, 4, "ASI01,ASI05"), ("PATH005", 5, 3, "ASI01"), ("PATH006", 5, 3, "ASI01,ASI02"), ("PATH007", 5, 3, "ASI06"),
)
RISKS = ("Agent Goal Hijack", "Tool Misuse & Exploitation", "Identity & Privilege Abuse", "Agentic Supply Chain Vulnerabilities", "Unexpected Code Execution (RCE)", "Memory & Context Poisoning", "Insecure Inter-Agent Communication", "Cascading Failures", "Human-Agent Trust Exploitation", "Rogue Agents")


def registry(spark) -> DataFrame:
    """(rule_id, layer, severity, owasp array), ordered by layer and id where it matters."""
    return spark.createDataFrame(list(REGISTRY), "rule_id string, layer int, severity int, o string").select("rule_id", "layer", "severity", F.when(F.col("o") == "", F.array().cast("array<string>")).otherwise(F.split("o", ",")).alias("owasp"))


def catalogue(spark) -> DataFrame:
    """The rules with their layer, severity, risk categories and whether evaluate() runs them, by layer and id."""
    rows = registry(spark).withColumn("evaluated", F.col("rule_id").isin(evaluated()))
    return rows.withColumn("severity", F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))).orderBy("layer", "rule_id")


def _found(rows: DataFrame, rule: str, test, subject="target_name", evidence=None) -> DataFrame:
    return rows.filter(test).select(F.lit(rule).alias("rule_id"), "agent", F.col(subject).alias("subject"), (F.lit("") if evidence is None else evidence).alias("evidence"))


def _tools(fs) -> DataFrame:
    flags = fs.agents.select("agent_key", F.col("name").alias("agent"), "framework", "a2a_exposed", (F.col("approval_plugin") | F.col("before_tool_callback")).alias("controlled"))
    return fs.tools.join(flags, "agent_key").withColumnRenamed("name", "target_name")


def _detailed(fs) -> DataFrame:
    """Tools with what adapters know of them; a tool without details has null ones."""
    return _tools(fs).join(fs.tool_details.withColumnRenamed("name", "target_name"), ["agent_key", "target_name"], "left")


def has(c: str):
    return F.array_contains("caps", c)


def _tool_tests() -> dict:
    loose = ~X.is_true(F.col("approval"))
    return {
        "AGT020": has("process.execute") & loose & (F.col("kind") != "delegated_agent"),
        "AGT021": has("destructive.write") & loose,
        "AGT022": has("data.write") & loose & F.col("kind").isin("apply_patch", "generic", "function"),
        "AGT023": has("computer.control") & _yes("control_custom") & _yes("control_mutating") & ~F.col("guardrails") & loose & ~F.col("controlled"),
        "AGT040": ~_yes("control_custom") & X.any_of(F.col("caps"), X.PRIVILEGED) & loose & ~F.col("guardrails") & ~F.col("controlled"),
    }


def _yes(c: str):
    return F.coalesce(F.col(c), F.lit(False))


def _broken(tests: dict):
    return F.array_compact(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]))


def tool_rules(fs) -> DataFrame:
    """Rules on single tools, bound to an agent or not (agent is null then)."""
    approval = F.concat(F.lit("approval="), F.coalesce(F.col("approval").cast("string"), F.lit("unknown")))
    # one pass over the tools: the rules a tool breaks, exploded
    bound = _detailed(fs).select(F.explode(_broken(_tool_tests())).alias("rule_id"), "agent", F.col("target_name").alias("subject"), approval.alias("evidence"))
    loose = fs.unbound_tools.filter(has("process.execute") & ~X.is_true(F.col("approval")))
    return bound.unionByName(loose.select(F.lit("AGT020").alias("rule_id"), F.lit(None).cast("string").alias("agent"), F.col("name").alias("subject"), approval.alias("evidence")))


def _adk_tests() -> dict:
    """Rules on single tools of one framework, by what its adapter knows of them."""
    c, loose = F.col, ~X.is_true(F.col("approval"))
    executor, remote = F.coalesce(c("part_of") == "adk_code_executor", F.lit(False)), F.coalesce(c("part_of") == "adk_a2a_remote", F.lit(False))
    is_a = lambda *names: F.coalesce(c("builtin").isin(*names), F.lit(False))
    return {
        "ADK002": F.coalesce(c("executor") == "UnsafeLocalCodeExecutor", F.lit(False)) | (executor & X.is_false(c("sandboxed"))),
        "ADK003": is_a("EnvironmentToolset") & F.coalesce(c("environment") == "LocalEnvironment", F.lit(False)),
        "ADK004": is_a("ExecuteBashTool") & ~_yes("bash_restrictive"),
        "ADK005": is_a("ComputerUseToolset") & loose & ~c("guardrails"),
        "ADK006": is_a("BigQueryToolset") & has("data.write"),
        "ADK007": is_a(*X.BROAD_TOOLSETS) & ~_yes("filtered"),
        "ADK008": F.coalesce(c("part_of") == "adk_agent_tool", F.lit(False)) & X.is_false(c("include_plugins")),
        "ADK009": remote & F.coalesce(F.startswith("agent_card", F.lit("http://")), F.lit(False)),
        "ADK010": remote & ~X.is_true(c("card_authenticated")),
        "ADK012": executor & X.is_true(c("sandboxed")) & F.coalesce("limits_applicable", F.lit(True)) & ~_yes("limits_complete"),
    }


def _framework_tests() -> dict:
    return {"ADK001": F.col("open"), "ADK011": F.col("exposed")}


def framework_rules(fs) -> DataFrame:
    adk = _detailed(fs).filter(F.col("framework") == "google-adk")
    rows = adk.filter(~F.col("controlled") & X.any_of(F.col("caps"), X.PRIVILEGED))
    sums = rows.groupBy("agent").agg(F.every(~X.is_true(F.col("approval")) & ~F.col("guardrails")).alias("open"), F.max("a2a_exposed").alias("exposed"), F.count("*").cast("string").alias("n"))
    each = F.explode(_broken(_framework_tests()))
    whole = sums.select(each.alias("rule_id"), "agent", F.lit("").alias("subject"), F.concat(F.lit("privileged_tools="), "n").alias("evidence"))
    known = F.concat(F.lit("known_as="), F.coalesce("builtin", "executor", "part_of", F.lit("")))
    return whole.unionByName(adk.select(F.explode(_broken(_adk_tests())).alias("rule_id"), "agent", F.col("target_name").alias("subject"), known.alias("evidence")))


def flow_rules(fs) -> DataFrame:
    """Paths that a supported flow of a proven agent bears out; subject is the flow."""
    untrusted = F.col("source_kind").isin(*X.UNTRUSTED_SOURCES)
    rule = (
        F.when(untrusted & (F.col("sink_kind") == "process_execute"), "PATH001")
        .when(untrusted & (F.col("sink_kind") == "memory_write"), "PATH007")
        .when((F.col("source_kind") == "secret_value") & (F.col("sink_kind") == "external_send"), "PATH003")
    )
    rows = fs.flows.filter("reachability = 'proven_agent_reachable' and confidence = 'supported'").withColumn("rule_id", rule).filter("rule_id is not null")
    rows = rows.join(fs.agents.select("agent_key", F.col("name").alias("agent")), "agent_key")
    return rows.select("rule_id", "agent", F.col("flow_id").alias("subject"), F.concat(F.lit("basis=static_dataflow;"), "source_kind", F.lit(">"), "sink_kind").alias("evidence"))


def path_rules(fs) -> DataFrame:
    """Paths by flow, and by what an agent combines: a tool each for execution, destruction and sending."""
    flows = flow_rules(fs)
    untrusted = fs.inputs.filter((F.col("trust") == "untrusted") | F.col("kind").isin(*X.UNTRUSTED_KINDS)).select("agent_key").distinct().withColumn("u", F.lit(True))
    held = fs.resources.join(fs.tools.select("agent_key", F.col("name").alias("owner_name"), "caps"), ["agent_key", "owner_name"])
    sensitive = held.filter(F.col("classification").isin(*X.SENSITIVE_CLASSES) & X.any_of(F.col("caps"), ("data.read", "secrets.read"))).select("agent_key").distinct().withColumn("s", F.lit(True))
    proven = flows.filter("rule_id = 'PATH001'").select("agent").distinct().withColumn("proven", F.lit(True))
    rows = _tools(fs).filter(~X.is_true(F.col("approval"))).join(untrusted, "agent_key", "left").join(sensitive, "agent_key", "left").join(proven, "agent", "left")
    tests = {
        "PATH001": _yes("u") & has("process.execute") & ~_yes("proven"), "PATH002": _yes("u") & has("destructive.write"),
        "PATH003": _yes("s") & X.any_of(F.col("caps"), X.OUTBOUND),
    }
    each = rows.select(F.explode(_broken(tests)).alias("rule_id"), "agent", F.col("target_name").alias("subject"), F.lit("basis=capability_cooccurrence").alias("evidence"))
    return flows.unionByName(each)


def _server_tests() -> dict:
    remote = F.coalesce(F.col("url") != "", F.lit(False)) & ~F.coalesce(X.is_loopback(F.col("url")), F.lit(False))
    return {
        "AGT001": (F.col("transport") == "stdio") & F.exists("args", X.resource_is_broad),
        "AGT030": remote & X.is_false(F.col("authenticated")),
        "AGT031": remote & F.col("url").startswith("http://"),
        "AGT032": remote & (F.size("allowed_tools") == 0),
        "AGT050": X.package_is_unpinned(F.col("command"), F.col("args")),
    }


def server_rules(fs) -> DataFrame:
    rows = fs.mcp_servers.join(fs.agents.select("agent_key", F.col("name").alias("agent")), "agent_key")
    return rows.select(F.explode(_broken(_server_tests())).alias("rule_id"), "agent", F.col("name").alias("subject"), F.coalesce("url", "command", F.lit("")).alias("evidence"))


def agent_profile(fs) -> DataFrame:
    """One row per agent: its capabilities, and the flags that the rules on whole agents read."""
    # a destination makes a tool's reach known, as does a network that its provider fixes
    aimed = fs.destinations.select("agent_key", F.col("owner_name").alias("target_name"), F.lit(True).alias("aimed")).distinct()
    tools = _tools(fs).join(aimed, ["agent_key", "target_name"], "left")
    fixed = F.coalesce(X.network_semantics(F.col("caps"), F.col("network_scope"), F.lit(0), F.lit(0)) == "fixed_provider_network", F.lit(False))
    loose, outbound = ~X.is_true(F.col("approval")), X.any_of(F.col("caps"), X.OUTBOUND)
    read, write = has("data.read"), X.any_of(F.col("caps"), ("data.write", "destructive.write"))
    secret = has("secrets.read")
    by_tool = tools.groupBy("agent_key").agg(
        F.array_distinct(F.flatten(F.collect_set("caps"))).alias("t_caps"), F.max(loose & outbound).alias("loose_outbound"),
        F.max(outbound & ~F.coalesce(F.col("network_scope") == "fixed_managed_service", F.lit(False))).alias("free_outbound"), F.max(outbound).alias("outbound"), F.max(read).alias("reads"), F.max(write).alias("writes"), F.max(secret).alias("secrets"),
        F.collect_set(F.when(outbound & F.col("aimed").isNull() & ~fixed, X.stable_id("authority-v1:", F.col("agent"), F.lit("tool"), F.col("target_name")))).alias("open_outbound"),
    )
    by_server = fs.mcp_servers.groupBy("agent_key").agg(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("url") != "", X.strings(("mcp.remote", "network.external"))).otherwise(X.strings(("mcp.local",)))))).alias("s_caps"))
    held = fs.resources.join(fs.tools.select("agent_key", F.col("name").alias("owner_name"), "caps"), ["agent_key", "owner_name"])
    by_resource = held.groupBy("agent_key").agg(F.collect_set("selector").alias("selectors"), F.max(F.col("classification").isin(*X.SENSITIVE_CLASSES) & X.any_of(F.col("caps"), ("data.read", "secrets.read"))).alias("sensitive"))
    by_target = fs.destinations.groupBy("agent_key").agg(F.collect_set("target").alias("targets"), F.max(X.destination_is_broad(F.col("target")) | ~F.col("restricted")).alias("broad"))
    by_input = fs.inputs.groupBy("agent_key").agg(F.max((F.col("trust") == "untrusted") | F.col("kind").isin(*X.UNTRUSTED_KINDS)).alias("untrusted"))
    out = fs.agents.select("agent_key", F.col("name").alias("agent"))
    for side in (by_tool, by_server, by_resource, by_target, by_input, fs.policies):
        out = out.join(side, "agent_key", "left")
    none = F.array().cast("array<string>")
    caps = X.sorted_set(F.concat(F.coalesce("t_caps", none), F.coalesce("s_caps", none)))
    out = out.withColumn("caps", caps)
    lists, flags = ("open_outbound", "selectors", "targets", "required", "denied", "allowed_resources", "allowed_destinations", "require_approval_for"), ("loose_outbound", "free_outbound", "outbound", "reads", "writes", "secrets", "sensitive", "broad", "untrusted")
    return out.withColumns({c: F.coalesce(c, none) for c in lists} | {c: F.coalesce(c, F.lit(False)) for c in flags})


def _agent_tests() -> dict:
    """Rule -> (test, evidence), over the profiles."""
    c = F.col
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    privileged, high = F.array_intersect("caps", X.strings(X.PRIVILEGED)), F.array_intersect("caps", X.strings(X.HIGH_RISK))
    outside = lambda values, patterns: F.filter(values, lambda v: ~F.exists(patterns, lambda p: F.regexp_like(v, X.glob_column(p))))
    extra, banned = F.array_except("caps", "required"), F.array_intersect("caps", "denied")
    far, strange = outside("selectors", c("allowed_resources")), outside("targets", c("allowed_destinations"))
    outbound = X.any_of(c("caps"), X.OUTBOUND)
    return {
        "CAP001": ((F.size("required") > 0) & (F.size(extra) > 0), joined(extra)),
        "CAP002": (F.size(banned) > 0, joined(banned)),
        "CAP003": (F.size(privileged) > F.coalesce("max_privileged", F.lit(3)), joined(privileged)),
        "CAP004": (has("process.execute") & has("network.external"), F.lit("")),
        "CAP005": ((c("reads") & c("writes")) | (has("data.read") & (has("data.write") | has("destructive.write"))), F.lit("")),
        "DATA001": (F.exists("selectors", X.resource_is_broad), joined(F.filter("selectors", X.resource_is_broad))),
        "DATA002": ((F.size("allowed_resources") > 0) & (F.size(far) > 0), joined(far)),
        "DATA003": (c("sensitive") & (c("broad") | (outbound & (F.size("targets") == 0) & c("free_outbound"))), F.lit("")),
        "NET001": (c("broad"), F.lit("")),
        "NET002": (~c("broad") & (F.size("open_outbound") > 0), F.concat(F.lit("capabilities="), joined(F.array_intersect("caps", X.strings(X.OUTBOUND))), F.lit(";authority_relationship="), joined("open_outbound"))),
        "NET003": ((F.size("allowed_destinations") > 0) & (F.size(strange) > 0), joined(strange)),
        "AGT010": (c("sensitive") & outbound & c("loose_outbound"), F.lit("")),
        "PATH004": (c("untrusted") & c("sensitive") & has("process.execute"), F.lit("")),
        "PATH005": (c("untrusted") & c("secrets") & c("free_outbound"), F.lit("")),
        "PATH006": (c("untrusted") & (F.size(high) >= 2), joined(high)),
    }


def agent_rules(fs) -> DataFrame:
    """Capability, data, network and co-occurrence path rules; one pass over the profiles."""
    rows = agent_profile(fs)
    broken = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(r).alias("rule_id"), e.alias("evidence"))) for r, (t, e) in _agent_tests().items()]))
    return rows.select("agent", F.explode(broken).alias("x")).select("x.rule_id", "agent", F.lit("").alias("subject"), "x.evidence")


def approval_rules(fs) -> DataFrame:
    """CAP006: a capability that needs an approval, on a tool that hasn't one."""
    need = fs.policies.select("agent_key", F.explode("require_approval_for").alias("cap"))
    rows = _tools(fs).filter(~X.is_true(F.col("approval"))).select("agent_key", "agent", F.explode("caps").alias("cap")).distinct()
    return rows.join(need, ["agent_key", "cap"]).select(F.lit("CAP006").alias("rule_id"), "agent", F.col("cap").alias("subject"), F.lit("").alias("evidence")).distinct()


def _identity_tests() -> dict:
    return {
        "IDN001": F.exists("roles", X.role_looks_admin), "IDN002": F.exists("permissions", X.permission_is_wildcard),
        "IDN003": X.any_of(F.col("oauth_scopes"), X.BROAD_OAUTH), "IDN004": F.col("credential_source").isin("hardcoded", "source", "plaintext", "file"),
    }


def identity_rules(fs) -> DataFrame:
    """Identities of agents, and those that no agent has (agent is null)."""
    own = fs.identities.join(fs.agents.select("agent_key", F.col("name").alias("agent")), "agent_key")
    free = fs.global_identities.join(fs.identities.select("name", "provider").distinct(), ["name", "provider"], "left_anti").withColumn("agent", F.lit(None).cast("string"))
    columns = ["agent", "name", "roles", "permissions", "oauth_scopes", "credential_source"]
    rows = own.select(*columns).unionByName(free.select(*columns))
    return rows.select(F.explode(_broken(_identity_tests())).alias("rule_id"), "agent", F.col("name").alias("subject"), F.lit("").alias("evidence")).distinct()


def evaluated() -> list[str]:
    """The rules that evaluate() runs."""
    paths = {"PATH001", "PATH002", "PATH003", "PATH007"}
    return sorted({*_tool_tests(), *_adk_tests(), *_framework_tests(), *_server_tests(), *_agent_tests(), "CAP006", *_identity_tests(), *paths})


def evaluate(fs) -> DataFrame:
    """All findings, deduplicated, with severity, layer, risk categories, source context and a fingerprint.

    A finding without an agent has a null one and the context unknown.
    """
    out = tool_rules(fs)
    for part in (framework_rules(fs), server_rules(fs), agent_rules(fs), approval_rules(fs), identity_rules(fs), path_rules(fs)):
        out = out.unionByName(part)
    out = out.dropDuplicates(["rule_id", "agent", "subject", "evidence"])
    context = fs.agents.groupBy(F.col("name").alias("agent")).agg(X.source_context(F.min("path")).alias("source_context"))
    # the registry is a fixed table of 46 rows
    out = out.join(F.broadcast(registry(fs.agents.sparkSession)), "rule_id").join(context, "agent", "left")
    fingerprint = X.stable_id("finding-v1:", F.col("rule_id"), F.coalesce("agent", F.lit("")), F.col("subject"))
    return out.withColumn("source_context", F.coalesce("source_context", F.lit("unknown"))).withColumn("fingerprint", fingerprint)


def by_layer(findings: DataFrame) -> DataFrame:
    layers = findings.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("layer"))
    counts = findings.groupBy("layer").agg(F.count("*").alias("n"), F.max("severity").alias("worst"))
    return layers.join(counts, "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("n"), "worst")


def by_context(findings: DataFrame) -> DataFrame:
    """Findings per source context, all nine."""
    contexts = findings.sparkSession.createDataFrame([(c,) for c in X.CONTEXTS], "source_context string")
    counts = findings.groupBy("source_context").agg(F.count("*").alias("n"))
    return contexts.join(counts, "source_context", "left").select("source_context", F.coalesce("n", F.lit(0)).alias("n"))


def exclude_contexts(findings: DataFrame, contexts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(findings outside `contexts`, counts per context before and after); gates come after it."""
    unknown = sorted(set(contexts) - set(X.CONTEXTS))
    if unknown:
        raise ValueError(f"no source context: {', '.join(unknown)}")
    gone = F.col("source_context").isin(*contexts) if contexts else F.lit(False)
    counts = by_context(findings).select("source_context", F.col("n").alias("before"), F.when(gone, 0).otherwise(F.col("n")).alias("after"))
    return findings.filter(~gone), counts


def by_risk(findings: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Per risk category, all ten: findings at all and at run time, worst severity, rules, agents, both statuses."""
    spark = findings.sparkSession
    taxonomy = spark.createDataFrame([(f"ASI{i:02}", t) for i, t in enumerate(RISKS, 1)], "risk string, title string")
    running = [r for r in evaluated() if r not in disabled]
    assessed = registry(spark).filter(F.col("rule_id").isin(running)).select(F.explode("owasp").alias("risk")).distinct().withColumn("assessed", F.lit(True))
    counts = findings.select("rule_id", "agent", "severity", "source_context", F.explode("owasp").alias("risk")).groupBy("risk").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_context") == "runtime").alias("at_runtime"), F.max("severity").alias("worst"), F.countDistinct("rule_id").alias("rules"), F.countDistinct("agent").alias("agents")
    )
    out = taxonomy.join(counts, "risk", "left").join(F.broadcast(assessed), "risk", "left")
    status = F.when(F.col("n") > 0, "finding").when(F.col("assessed"), "no_mapped_findings").otherwise("not_assessed")
    runtime = F.when(F.col("assessed").isNull(), "not_assessed").when(F.col("at_runtime") > 0, "finding").when(F.col("n") > 0, "no_runtime_findings").otherwise("no_mapped_findings")
    return out.select("risk", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "at_runtime", "rules", "agents")], "worst", status.alias("status"), runtime.alias("runtime_status"))


def suppress(findings: DataFrame, suppressions: DataFrame, today) -> tuple[DataFrame, DataFrame]:
    """(active findings, diagnostics): the first suppression in force that fits all its scopes hides a finding.

    `suppressions`: (ordinal, id, rule_id, agent, fingerprint, expires), null = any; a small, hand-written table.
    """
    live = suppressions.filter(F.col("expires") >= F.lit(today))
    s = F.broadcast(live.withColumnsRenamed({c: f"s_{c}" for c in live.columns}))
    fits = lambda c: F.col(f"s_{c}").isNull() | (F.col(f"s_{c}") == F.col(c))
    hits = findings.join(s, fits("rule_id") & fits("agent") & fits("fingerprint"))
    first = hits.groupBy("fingerprint", "evidence").agg(F.min_by("s_id", "s_ordinal").alias("id"))
    matched = first.groupBy("id").agg(F.count("*").alias("n"))
    status = F.when(F.col("expires") < F.lit(today), "expired").when(F.col("n") > 0, "matched").otherwise("stale")
    return findings.join(first, ["fingerprint", "evidence"], "left_anti"), suppressions.join(matched, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def configure(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Drop disabled rules and override severities; `overrides`: (rule_id, enabled, severity nullable)."""
    o = F.broadcast(overrides.withColumnRenamed("severity", "new"))
    return findings.join(o, "rule_id", "left").filter(F.coalesce("enabled", F.lit(True))).withColumn("severity", F.coalesce("new", "severity")).drop("enabled", "new")


def score(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Multiset comparison of (rule_id, agent): per rule, true positives, false positives and false negatives."""
    count = lambda df, c: df.groupBy("rule_id", "agent").agg(F.count("*").alias(c))
    rows = count(expected, "e").join(count(actual, "a"), ["rule_id", "agent"], "full").select("rule_id", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a"))
    return rows.groupBy("rule_id").agg(F.sum(F.least("e", "a")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"))


