"""YAML and JSON documents: read safely, flattened to one row per field, and checked against a table of shapes.

Only the parser needs Python. What it yields, a row per field, is checked by a join with the shapes; the documents
themselves go on as JSON text that a schema reads.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantscope.functions import expr as X

# Limits of a document, and the shapes of manifest fields (what a field may be, by its path).
MAX_DOCUMENT, MAX_DEPTH, MAX_ALIASES = 2 * 1024 * 1024, 50, 50
STRINGS = ("str", "list:str")
_NAMED = lambda names, *kinds: {n: kinds for n in names.split()}
_IDENTITY = _NAMED("name service_account principal provider resource_scope credential_source", "str") | _NAMED("roles permissions oauth_scopes scopes", *STRINGS)
_RESOURCE = _NAMED("kind selector path resource classification", "str") | _NAMED("access", *STRINGS)
_SCOPE = _NAMED("capabilities identities resources destinations iam_roles permissions oauth_scopes mcp_servers", *STRINGS)
_POLICY = _NAMED(
    "required required_capabilities deny denied_capabilities allowed_resources resources allowed_destinations destinations require_approval_for", *STRINGS
) | {"max_privileged_capabilities": ("int",), "authority": {"allow": _SCOPE, "deny": _SCOPE, "require_approval_for": STRINGS, "mcp_tools[]": {"server": ("str",), "allow": STRINGS, "deny": STRINGS}}}
_AGENT = {
    "name": ("str",), "data[]": _NAMED("name source classification capability selector path resource", "str"), "inputs[]": _NAMED("name source trust kind", "str"), "identities[]": _IDENTITY,
    "network[]": _NAMED("target destination host direction", "str") | {"restricted": ("bool",)},
    "tools[]": _NAMED("name kind identity", "str") | _NAMED("capabilities capability destinations destination", *STRINGS) | _NAMED("approval human_approval guardrails", "bool") | {"resources[]": _RESOURCE},
    "mcp_servers[]": _NAMED("name transport url command identity", "str") | _NAMED("authenticated approval guardrails", "bool") | _NAMED("args allowed_tools denied_tools", *STRINGS), "policy": _POLICY, "permissions": _POLICY,
}
MANIFEST = {"version": ("int",), "agents[]": _AGENT, "agent": _AGENT, "identities[]": _IDENTITY}
#: Lists whose items may be plain strings too.
PLAIN_ITEMS = ("data[]", "inputs[]", "identities[]", "network[]", "resources[]")

FIELDS = "path string, pointer string, pattern string, kind string, value string"
PARSED = "path string, document string, diagnostic string"


def _depth(x) -> int:
    return 1 + max((_depth(v) for v in (x.values() if isinstance(x, dict) else x)), default=0) if isinstance(x, (dict, list)) else 0


def load(path: str, text: str | None) -> tuple[str, str | None, str | None]:
    """(path, document as JSON, diagnostic): exactly one of the two is null. No alias bombs, no deep nests, no tags."""
    if text is None:
        return path, None, "unreadable_path"
    if len(text.encode("utf-8", "surrogatepass")) > MAX_DOCUMENT:
        return path, None, "document_too_large"
    try:
        if path.lower().endswith(".json"):
            raw = json.loads(text)
        else:
            import yaml

            if sum(isinstance(e, yaml.AliasEvent) for e in yaml.parse(text, Loader=yaml.SafeLoader)) > MAX_ALIASES:
                return path, None, "too_many_aliases"
            raw = yaml.safe_load(text)
        if _depth(raw) > MAX_DEPTH:
            return path, None, "nested_too_deep"
        return path, json.dumps(raw, default=str), None
    except RecursionError:
        return path, None, "nested_too_deep"
    except Exception as e:  # a parser's message may hold the document's secrets, so only its kind is kept
        mark = getattr(e, "problem_mark", None)
        return path, None, f"parse_error:{mark.line + 1}" if mark else "parse_error"


def _load(frames):
    for f in frames:
        yield pd.DataFrame([load(p, t) for p, t in zip(f["path"], f["text"])], columns=["path", "document", "diagnostic"])


def read_documents(files: DataFrame) -> DataFrame:
    """(path, document, diagnostic) of YAML and JSON `files` (path, text); the document is JSON text."""
    return files.select("path", "text").mapInPandas(_load, PARSED)


def _kind(x) -> str:
    if isinstance(x, list):
        kinds = {_kind(v) for v in x}
        return "list:str" if kinds <= {"str"} else "list"
    return "map" if isinstance(x, dict) else type(x).__name__


def fields(path: str, x, pointer: str = "", pattern: str = ""):
    """(path, pointer, pattern, kind, value) of every field below `x`."""
    for key, value in (x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()):
        listed = isinstance(x, list)
        at, like = (f"{pointer}[{key}]", pattern + "[]") if listed else (f"{pointer}.{key}" if pointer else str(key), f"{pattern}.{key}" if pattern else str(key))
        kind = _kind(value)
        if not (listed and not isinstance(value, (dict, list))):
            yield path, at, like, kind, json.dumps(value) if kind in ("str", "int", "bool") else None
        elif not isinstance(value, str):
            yield path, at, like, kind, None
        yield from fields(path, value, at, like)


def _flatten(frames):
    for f in frames:
        rows = [r for p, d in zip(f["path"], f["document"]) if d is not None for r in ([(p, "document", "", _kind(json.loads(d)), None)] if not isinstance(json.loads(d), dict) else fields(p, json.loads(d)))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FIELDS.split(", ")])


def shapes(spark: SparkSession, tree: dict = MANIFEST) -> DataFrame:
    """(pattern, kinds): the table of shapes."""
    rows = []

    def walk(at, node):
        for key, below in node.items():
            name = f"{at}.{key}" if at else key
            if isinstance(below, dict):
                rows.append((name, ["map"]))
                if key.endswith("[]"):
                    rows.append((name[:-2], ["list", "list:str"] if key in PLAIN_ITEMS else ["list", "list:empty"]))
                walk(name, below)
            else:
                rows.append((name, list(below)))

    walk("", tree)
    return spark.createDataFrame(rows, "pattern string, kinds array<string>")


def problems(documents: DataFrame, tree: dict = MANIFEST) -> DataFrame:
    """(path, pointer, message) of fields that the shapes don't know, or know as something else. Empty: the document is valid."""
    flat = documents.filter("document is not null").select("path", "document").mapInPandas(_flatten, FIELDS)
    # a fixed table of some two hundred shapes
    rows = flat.join(F.broadcast(shapes(documents.sparkSession, tree)), "pattern", "left")
    plain = F.col("value")
    empty = (F.col("kind") == "list:str") & F.array_contains("kinds", "list:empty")
    wrong = ~F.array_contains("kinds", F.col("kind")) & ~empty
    last = lambda name: F.col("pattern").rlike(rf"(^|\.){name}$")
    message = (
        F.when(F.col("pointer") == "document", "must be a mapping")
        .when(F.col("kinds").isNull(), "is an unknown field")
        .when(wrong, F.concat(F.lit("must be "), F.array_join("kinds", " or ")))
        .when(last("trust") & ~plain.isin('"trusted"', '"untrusted"'), "must be trusted or untrusted")
        .when(last("direction") & ~plain.isin('"inbound"', '"outbound"'), "must be inbound or outbound")
        .when((F.col("pattern") == "version") & (plain != "1"), "must be supported schema version 1")
        .when(last("max_privileged_capabilities") & (plain.cast("int") < 0), "must be nonnegative")
    )
    both = flat.groupBy("path").agg(F.max(F.col("pointer") == "agent").alias("a"), F.max(F.col("pointer") == "agents").alias("b")).filter("a and b")
    return rows.select("path", "pointer", message.alias("message")).filter("message is not null").unionByName(both.select("path", F.lit("document").alias("pointer"), F.lit("cannot contain both agent and agents").alias("message")))


_TEXTS = "array<string>"
_READ = "struct<agents:array<string>,agent:string,identities:array<string>>"


def manifest(documents: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    """The tables of manifests, version 1: agents, tools, inputs, identities, network, servers, clauses, policies.

    Each row carries its path and agent. With `strict` a document that breaks a shape is an error, as a manifest is
    security configuration: what can't be read may not pass for nothing.
    """
    bad = problems(documents).unionByName(documents.filter("document is null").select("path", F.lit("document").alias("pointer"), F.col("diagnostic").alias("message")))
    if strict and (first := bad.orderBy("path", "pointer").first()):
        raise ValueError(f"{first.path}: {first.pointer} {first.message}")
    docs = documents.filter("document is not null").select("path", F.from_json("document", _READ).alias("d"))
    agents = docs.select("path", F.posexplode(F.when(F.size("d.agents") > 0, F.col("d.agents")).otherwise(F.array_compact(F.array("d.agent")))).alias("ordinal", "a"))
    get = lambda c, key: F.get_json_object(c, f"$.{key}")
    agents = agents.withColumn("agent", F.coalesce(get("a", "name"), F.lit("unnamed-agent")))
    items = lambda key, source=agents: source.select("path", "agent", F.posexplode(F.from_json(get("a", key), _TEXTS)).alias("at", "x"))
    # an item may be a plain string, which is its name then
    plain = ~F.startswith(F.ltrim("x"), F.lit("{"))
    of = lambda key, *more: F.coalesce(F.when(plain, F.col("x")), *[get("x", k) for k in (key, *more)])
    field = lambda *keys: F.coalesce(*[get("x", k) for k in keys])
    listed = lambda c: F.coalesce(F.from_json(c, _TEXTS), F.when(c.isNotNull(), F.array(c)), F.array().cast(_TEXTS))
    caps = listed(field("capabilities", "capability"))
    tools = items("tools").select(
        "path", "agent", F.coalesce(field("name"), F.lit("tool")).alias("name"), F.coalesce(field("kind"), F.lit("generic")).alias("kind"),
        F.when(F.size(caps) > 0, X.sorted_set(caps)).otherwise(X.infer_capabilities(F.coalesce(field("name"), F.lit("tool")))).alias("caps"),
        field("approval", "human_approval").cast("boolean").alias("approval"), F.coalesce(field("guardrails").cast("boolean"), F.lit(False)).alias("guardrails"), field("identity").alias("identity"),
        listed(field("destinations", "destination")).alias("destinations"), F.from_json(field("resources"), _TEXTS).alias("resources"),
    )
    network = items("network").select("path", "agent", of("target", "destination", "host").alias("target"), F.coalesce(field("direction"), F.lit("outbound")).alias("direction"), field("restricted").cast("boolean").alias("restricted"))
    network = network.withColumn("restricted", F.coalesce("restricted", ~F.col("target").isin("*", "internet", "all")))
    both = agents.select("path", "agent", F.coalesce(get("a", "policy"), get("a", "permissions")).alias("x"))
    side = lambda mode: F.map_entries(F.from_json(field(f"authority.{mode}"), "map<string,string>"))
    clauses = both.select("path", "agent", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), side(m).alias("e")) for m in ("allow", "deny")])).alias("s")).select("path", "agent", "s.mode", F.explode("s.e").alias("e"))
    clauses = clauses.select("path", "agent", "mode", F.col("e.key").alias("dimension"), F.explode(listed(F.col("e.value"))).alias("pattern"))
    policies = both.filter("x is not null").select(
        "path", "agent", listed(field("required", "required_capabilities")).alias("required"), listed(field("deny", "denied_capabilities")).alias("denied"), listed(field("allowed_resources", "resources")).alias("allowed_resources"),
        listed(field("allowed_destinations", "destinations")).alias("allowed_destinations"), listed(field("require_approval_for", "authority.require_approval_for")).alias("require_approval_for"), field("max_privileged_capabilities").cast("int").alias("max_privileged"),
    )
    shared = docs.select("path", F.lit(None).cast("string").alias("agent"), F.posexplode("d.identities").alias("at", "x"))
    identity = lambda rows: rows.select(
        "path", "agent", of("name", "service_account", "principal").alias("name"), F.coalesce(field("provider"), F.lit("generic")).alias("provider"), *[listed(field(c)).alias(c) for c in ("roles", "permissions")],
        listed(field("oauth_scopes", "scopes")).alias("oauth_scopes"), field("credential_source").alias("credential_source"),
    )
    servers = items("mcp_servers").select(
        "path", "agent", field("name").alias("name"), F.coalesce(field("transport"), F.lit("unknown")).alias("transport"), field("url").alias("url"), field("command").alias("command"), listed(field("args")).alias("args"),
        *[field(c).cast("boolean").alias(c) for c in ("authenticated", "approval")], listed(field("allowed_tools")).alias("allowed_tools"), listed(field("denied_tools")).alias("denied_tools"), field("identity").alias("identity"),
    )
    inputs = items("inputs").select("path", "agent", of("name", "source").alias("name"), F.lower(F.coalesce(field("trust"), F.lit("trusted"))).alias("trust"), F.lower(F.coalesce(field("kind"), F.lit("user"))).alias("kind"))
    data = items("data").select("path", "agent", of("name", "source").alias("name"), F.lower(F.coalesce(field("classification"), F.lit("internal"))).alias("classification"), F.coalesce(field("capability"), F.lit("data.read")).alias("capability"), field("selector", "path", "resource").alias("selector"))
    return {
        "agents": agents.select("path", "agent", "ordinal"), "tools": tools, "network": network, "clauses": clauses, "policies": policies, "identities": identity(items("identities")).unionByName(identity(shared)),
        "servers": servers, "inputs": inputs, "data": data,
    }


_SUPPRESSED = "struct<version:int,suppressions:array<struct<id:string,reason:string,expires:string,fingerprint:string,rule_id:string,agent:string,path:string>>>"


def suppressions(documents: DataFrame) -> DataFrame:
    """(ordinal, id, reason, expires, fingerprint, rule_id, agent, path) of suppression files; any fault is an error."""
    known = {"version": ("int",), "suppressions[]": _NAMED("id reason expires fingerprint rule_id agent path", "str")}
    bad = problems(documents, known).first()
    if bad:
        raise ValueError(f"{bad.path}: {bad.pointer} {bad.message}")
    rows = documents.select("path", F.from_json("document", _SUPPRESSED).alias("d")).select(F.col("path").alias("file"), F.posexplode("d.suppressions").alias("ordinal", "s")).select("file", "ordinal", "s.*")
    rows = rows.withColumn("expires", F.try_to_date("expires"))
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    fault = (
        F.when(~some("id") | ~some("reason") | F.col("expires").isNull(), "needs id, reason and expires")
        .when(F.col("reason").rlike(r"[\r\n]") | (F.length("reason") > 500), "reason must be one line of 500 characters at most")
        .when(~some("fingerprint") & ~some("rule_id"), "needs fingerprint or rule_id")
        .when(some("rule_id") & ~some("fingerprint") & ~some("agent") & ~some("path"), "rule_id needs an agent or path beside it")
        .when(F.startswith("path", F.lit("/")) | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "path must stay inside the repository")
        .when(F.count("*").over(Window.partitionBy("file", "id")) > 1, "id recurs")
    )
    wrong = rows.select("file", "ordinal", fault.alias("fault")).filter("fault is not null").orderBy("file", "ordinal").first()
    if wrong:
        raise ValueError(f"{wrong.file}: suppressions[{wrong.ordinal}] {wrong.fault}")
    return rows.drop("file")
