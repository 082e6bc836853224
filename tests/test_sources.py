"""Walks, documents, manifests and suppressions."""

import json

import pytest
from pyspark.sql import functions as F

from grantscope.sources import documents, walk

MANIFEST = """
version: 1
identities:
  - {name: shared, provider: gcp, roles: roles/owner}
agents:
  - name: helper
    inputs: [mail, {name: site, trust: untrusted, kind: web}]
    identities: [shared, {name: own, service_account: x, scopes: [a, b]}]
    network: ["*", {host: api.example.com, restricted: true}]
    tools:
      - {name: run_shell, human_approval: false}
      - {name: plain, capabilities: [data.read], guardrails: true, resources: [bucket/a, {selector: db}]}
    mcp_servers: [{name: s, url: "https://x", allowed_tools: [read]}]
    policy:
      required: data.read
      max_privileged_capabilities: 2
      authority: {allow: {capabilities: [data.*], iam_roles: roles/viewer}, deny: {destinations: ["*"]}, require_approval_for: [process.execute]}
"""


def docs(spark, *texts, suffix="yaml"):
    return documents.read_documents(spark.createDataFrame([(f"d{i}.{suffix}", t) for i, t in enumerate(texts)], "path string, text string"))


def test_documents_are_read_safely(spark):
    deep, aliases = "[" * 60 + "]" * 60, "a: &x [1]\nb: [" + ", ".join(["*x"] * 60) + "]"
    rows = docs(spark, "a: 1", deep, aliases, "a: [", None, "x: " + "y" * (documents.MAX_DOCUMENT + 1), "a: !!python/object:os.system x").orderBy("path").collect()
    assert [r.diagnostic for r in rows] == [None, "nested_too_deep", "too_many_aliases", "parse_error:1", "unreadable_path", "document_too_large", "parse_error:1"]
    assert json.loads(rows[0].document) == {"a": 1}
    assert docs(spark, "{", suffix="json").first().diagnostic == "parse_error"


def test_manifest_tables(spark):
    m = documents.manifest(docs(spark, MANIFEST))
    rows = lambda name, *cols: sorted(map(tuple, m[name].select(*cols).collect()), key=str)
    assert rows("agents", "agent", "ordinal") == [("helper", 0)]
    assert rows("tools", "name", "caps", "approval", "guardrails") == [("plain", ["data.read"], None, True), ("run_shell", ["process.execute"], False, False)]
    assert rows("network", "target", "restricted") == [("*", False), ("api.example.com", True)]
    assert rows("inputs", "name", "trust", "kind") == [("mail", "trusted", "user"), ("site", "untrusted", "web")]
    assert rows("identities", "agent", "name", "roles", "oauth_scopes") == [("helper", "own", [], ["a", "b"]), ("helper", "shared", [], []), (None, "shared", ["roles/owner"], [])]
    assert rows("clauses", "mode", "dimension", "pattern") == [("allow", "capabilities", "data.*"), ("allow", "iam_roles", "roles/viewer"), ("deny", "destinations", "*")]
    p = m["policies"].first()
    assert (p.required, p.max_privileged, p.require_approval_for) == (["data.read"], 2, ["process.execute"])
    assert rows("servers", "name", "url", "allowed_tools", "authenticated") == [("s", "https://x", ["read"], None)]
    assert m["tools"].filter("name = 'plain'").first().resources[0] == "bucket/a"


@pytest.mark.parametrize("text, pointer, message", [
    ("version: 2", "version", "must be supported schema version 1"), ("version: 1\nnope: 1", "nope", "is an unknown field"), ("version: 1\nagent: {name: a, tools: [{approval: yes please}]}", "agent.tools[0].approval", "must be bool"),
    ("version: 1\nagent: {inputs: [{trust: maybe}]}", "agent.inputs[0].trust", "must be trusted or untrusted"), ("version: 1\nagent: {policy: {max_privileged_capabilities: -1}}", "agent.policy.max_privileged_capabilities", "must be nonnegative"),
    ("version: 1\nagent: {name: a}\nagents: []", "document", "cannot contain both agent and agents"), ("- 1", "document", "must be a mapping"), ("version: 1\nagents: [{name: [x]}]", "agents[0].name", "must be str"), ("a: [", "document", "parse_error:1"),
])
def test_faulty_manifests_are_errors(spark, text, pointer, message):
    with pytest.raises(ValueError, match=f"{pointer} {message}".replace("[", r"\[")):
        documents.manifest(docs(spark, text))


def test_suppressions(spark):
    good = "version: 1\nsuppressions:\n  - {id: a, reason: known, expires: 2030-01-01, rule_id: AGT020, path: app/*}\n"
    row = documents.suppressions(docs(spark, good)).first()
    assert (row.id, row.rule_id, str(row.expires)) == ("a", "AGT020", "2030-01-01")
    for bad in ("version: 1\nsuppressions: [{id: a, reason: x, expires: 2030-01-01}]", good + "  - {id: a, reason: known, expires: 2030-01-01, rule_id: AGT020, agent: x}\n", good.replace("app/*", "../x"), good.replace("reason", "why")):
        with pytest.raises(ValueError):
            documents.suppressions(docs(spark, bad))


def test_walk(spark, tmp_path):
    for name in ("a.py", "sub/b.yaml", "sub/c.txt", "venv/d.py", "skip/e.py", "skip/deep/f.py", "mcp.json", ".env.local", "snippets/g.py", "x/noext"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    (tmp_path / "skip" / ".scan-ignore").write_text("")
    (tmp_path / ".scan-ignore").write_text("")
    (tmp_path / "link.py").symlink_to("/etc/hostname")
    files = walk.listed(spark, str(tmp_path))
    assert sorted(r.relative for r in walk.candidates(files).collect()) == [".env.local", "a.py", "mcp.json", "snippets/g.py", "sub/b.yaml"]
    once = files.withColumn("real_path", F.lit("same"))
    assert walk.candidates(once).count() == 1
    with pytest.raises(ValueError):
        walk.candidates(files, most=2)
    with pytest.raises(ValueError):
        walk.listed(spark, str(tmp_path), most=3)
    notes = walk.skipped(files.withColumn("text", F.when(F.col("relative") == "sub/b.yaml", "{{ x }}").otherwise("x"))).collect()
    assert sorted(r.kind for r in notes) == ["source_fragment", "templated_source"]
