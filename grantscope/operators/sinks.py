"""Sinks: findings as SARIF, relationships as canonical JSON with a digest, summaries as Markdown, gates as exit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {0: "note", 1: "note", 2: "warning", 3: "error", 4: "error"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result per finding, ready to be written as the lines of a run's results."""
    level = F.create_map(*[F.lit(v) for pair in LEVELS.items() for v in pair])[F.col("severity")]
    message = F.struct(F.concat_ws(" ", "agent", "subject", "evidence").alias("text"))
    return findings.select(F.to_json(F.struct(level.alias("level"), message.alias("message"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), F.col("rule_id").alias("ruleId"))).alias("value"))


def canonical(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, document): each row as JSON with its fields in order of name, the form that digests and diffs compare."""
    return rows.select(*keys, F.to_json(F.struct(*sorted(rows.columns))).alias("document"))


def digest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: a digest of all rows that doesn't depend on their order or partitioning, and their number.

    Each document is hashed where it lies; the hashes' hex digests are summed by 15-digit limbs, so nothing is sorted or gathered.
    """
    hashed = canonical(rows, *keys).select(F.sha2("document", 256).alias("h"))
    limbs = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)]
    return hashed.agg(F.count("*").alias("n"), *limbs).select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.coalesce(F.col(f"l{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))


def markdown(rows: DataFrame, limit: int = 40) -> str:
    """A table of at most `limit` rows, for people; says how many it leaves out."""
    head = rows.limit(limit + 1).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in head[:limit]]
    return "\n".join(lines + ["", "More rows are left out."] * (len(head) > limit))


def exit_code(findings: DataFrame, threshold: int = 3, incomplete: bool = False, strict: bool = False) -> int:
    """0 in order, 1 if the scan is incomplete under `strict`, 2 if a finding reaches the threshold."""
    if strict and incomplete:
        return 1
    return 2 if findings.filter(F.col("severity") >= threshold).limit(1).count() else 0


def scan_report(findings: DataFrame, relationships: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: the scan as a JSON document of counts, coverage and findings in order of severity and fingerprint.

    A report is one document, so it is put together in one task; it is for scans, whose findings the caps bound.
    """
    shown = findings.select(F.struct((-F.col("severity")).alias("order"), "fingerprint", "rule_id", "agent", "subject", "evidence", "severity", "layer", "source_context").alias("f"))
    listed = shown.agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f.dropFields("order")).alias("findings"), F.count("*").alias("n"))
    related = relationships.agg(F.count("*").alias("relationships"), F.count_if(F.size("unresolved") > 0).alias("unresolved"))
    rows = listed.crossJoin(F.broadcast(related)).crossJoin(F.broadcast(coverage))  # one row each
    summary = F.struct(F.col("n").alias("findings"), "relationships", "unresolved")
    return rows.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), summary.alias("summary"), F.struct(*coverage.columns).alias("coverage"), "findings")).alias("document"))


def graph_document(nodes: DataFrame, edges: DataFrame, most_nodes: int = 20_000, most_edges: int = 50_000) -> DataFrame:
    """Lines of a graph's JSON, a node or edge each; a graph over the scan's caps is an error, not cut."""
    for rows, most, what in ((nodes, most_nodes, "nodes"), (edges, most_edges, "edges")):
        if rows.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} {what}")
    line = lambda rows, kind: rows.select(F.lit(kind).alias("part"), "id", F.to_json(F.struct(*sorted(rows.columns))).alias("document"))
    return line(nodes, "node").unionByName(line(edges, "edge"))


def policy_document(proposal: DataFrame, approvals: DataFrame | None = None) -> str:
    """A proposed contract as YAML text: per agent the observed patterns of each dimension; never a wildcard.

    `proposal`: (agent, dimension, patterns as comma-joined text), of one scan.
    """
    import yaml

    agents: dict = {}
    for r in proposal.orderBy("agent", "dimension").collect():
        allow = agents.setdefault(r.agent, {"name": r.agent, "policy": {"authority": {"allow": {}}}})["policy"]["authority"]["allow"]
        allow[r.dimension] = [p for p in r.patterns.split(",") if p and p != "*"]
    for r in approvals.orderBy("agent").collect() if approvals is not None else ():
        if r.agent in agents:
            agents[r.agent]["policy"]["authority"]["require_approval_for"] = sorted(r.capabilities)
    return yaml.safe_dump({"version": 1, "agents": list(agents.values())}, sort_keys=False, allow_unicode=True)


def suppression_baseline(findings: DataFrame, reason: str, expires, today, incomplete: bool) -> str:
    """Suppressions of all findings as YAML text; none for an incomplete scan, a past date or an empty reason."""
    import yaml

    if incomplete:
        raise ValueError("an incomplete scan is no baseline")
    if expires < today:
        raise ValueError("the baseline would be expired")
    if not reason.strip() or "\n" in reason:
        raise ValueError("a baseline needs a reason of one line")
    rows = findings.select("rule_id", "fingerprint").distinct().orderBy("rule_id", "fingerprint").collect()
    items = [{"id": f"baseline-{i:04d}-{r.rule_id.lower()}", "reason": reason, "expires": expires.isoformat(), "fingerprint": r.fingerprint, "rule_id": r.rule_id} for i, r in enumerate(rows, 1)]
    return yaml.safe_dump({"version": 1, "suppressions": items}, sort_keys=False)


def write_snapshot(rows: DataFrame, path: str, snapshot_id: str) -> None:
    """Append a snapshot's rows to a Parquet table partitioned by snapshot_id; a rerun replaces its own partition."""
    rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)
