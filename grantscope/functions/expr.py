"""Column expressions: capability inference, globs, breadth and privilege tests, contexts, stable ids.

Three-valued logic throughout: a null approval or authentication is unknown, never false.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words of a name that imply capabilities.
CAPABILITY_WORDS = (
    ("shell exec execute command terminal bash powershell", ("process.execute",)),
    ("delete remove destroy purge drop terminate", ("destructive.write",)),
    ("send email post publish upload notify message", ("external.write", "network.external")),
    ("http https web request fetch browser url api", ("network.external",)),
    ("write update create modify edit patch apply", ("data.write",)),
    ("read search lookup get retrieve document file query list", ("data.read",)),
    ("secret credential token password key vault", ("secrets.read",)),
    ("admin iam permission role policy grant", ("identity.admin",)),
)
PRIVILEGED = ("process.execute", "destructive.write", "external.write", "data.write", "secrets.read", "identity.admin")
HIGH_RISK = ("process.execute", "destructive.write", "secrets.read", "identity.admin")
OUTBOUND = ("network.external", "external.write")
SENSITIVE_CLASSES = ("confidential", "restricted", "secret", "highly-confidential", "regulated")
UNTRUSTED_KINDS = ("web", "browser", "email", "document", "retrieval", "external", "webhook")
ADMIN_MARKERS = ("owner", "admin", "administrator", "editor", "contributor", "*", "fullaccess", "poweruser")
BROAD_OAUTH = ("https://www.googleapis.com/auth/cloud-platform", "https://www.googleapis.com/auth/drive", "https://graph.microsoft.com/.default", "offline_access", "*")
BROAD_DESTINATIONS = ("*", "0.0.0.0/0", "::/0", "any", "internet", "all")
BROAD_RESOURCES = ("*", "/", "~", ".", "..", "${HOME}", "/**", "**", "/*")
UNTRUSTED_SOURCES = ("user_input", "external_http_response", "web_retrieval", "mcp_response", "agent_tool_input")
BROAD_TOOLSETS = ("GoogleApiToolset", "GmailToolset", "CalendarToolset", "DocsToolset", "SheetsToolset", "SlidesToolset", "YoutubeToolset", "APIHubToolset", "ApplicationIntegrationToolset", "OpenAPIToolset")
CONTEXTS = ("runtime", "cli", "application-support", "test", "example", "tutorial", "notebook", "template-generated", "unknown")
PACKAGE_RUNNERS = ("npx", "bunx", "pnpx")
PERSISTENT_MARKERS = ("database", "db", "redis", "sql", "firestore", "storage", "store", "persist", "persistent", "checkpoint")
SESSION_MARKERS = ("state", "session", "context", "cache", "scratch", "temporary", "temp")
SENSITIVE_WRITE_MARKERS = ("payment", "transfer", "transaction", "billing", "account", "identity", "iam", "credential", "permission", "role", "security", "policy", "access")
CONTEXT_MARKERS = (
    ("test", ("test", "tests", "testing")),
    ("example", ("example", "examples", "sample", "samples", "demo", "demos")),
    ("tutorial", ("tutorial", "tutorials", "training", "lab", "labs", "workshop", "workshops", "course", "courses")),
    ("template-generated", ("template", "templates", "generated", "fixtures", "benchmark", "benchmarks")),
    ("cli", ("cli", "command", "commands")),
    ("application-support", ("ci", "cicd", "deploy", "deployment", "infra", "infrastructure", "migration", "migrations", "script", "scripts", "setup")),
)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_true(c: Column) -> Column:
    return c.eqNullSafe(True)


def is_false(c: Column) -> Column:
    return c.eqNullSafe(False)


def any_of(array: Column, values) -> Column:
    return F.arrays_overlap(array, strings(values))


def sorted_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def infer_capabilities(name: Column) -> Column:
    """Sorted capabilities that the words of a name imply."""
    plain = F.regexp_replace(name, r"[_\-.]+", " ")
    found = [F.when(plain.rlike(r"(?i)\b(" + "|".join(words.split()) + r")\b"), strings(caps)).otherwise(F.array().cast("array<string>")) for words, caps in CAPABILITY_WORDS]
    return sorted_set(F.flatten(F.array(*found)))


def glob_regex(pattern: str) -> str:
    """Anchored Java regex of a shell pattern: * and ? cross every character, [seq] and [!seq] are classes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "]"))
            if pattern[i : i + 2] == "!]":
                j += 1
            j = pattern.find("]", j)
            if j < 0:
                out.append(r"\[")
                continue
            body, i = pattern[i:j], j + 1
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:])
            out.append(f"[{'^' * negated}{body}]")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", c) if ord(c) < 128 else c)
    return "(?s)^" + "".join(out) + r"\z"


def glob_column(pattern: Column) -> Column:
    """The same translation for a column of patterns, for * ? and literals; classes keep their brackets."""
    quoted = F.regexp_replace(pattern, r"([.\\+(){}^$|])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[!", "[^")
    quoted = F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", ".")
    quoted = F.when(F.regexp_like(quoted, F.lit(r"\[[^\]]*\z")), F.regexp_replace(quoted, r"\[", r"\\[")).otherwise(quoted)
    return F.concat(F.lit("(?s)^"), quoted, F.lit(r"\z"))


def matches_any(value: Column, regexes: Column) -> Column:
    """Whether any of the (translated) patterns matches."""
    return F.exists(regexes, lambda r: F.regexp_like(value, r))


def role_looks_admin(role: Column) -> Column:
    plain = F.translate(F.lower(role), "_-", "")
    out = F.lit(False)
    for marker in ADMIN_MARKERS:
        out = out | F.contains(plain, F.lit(marker))
    return out


def permission_is_wildcard(permission: Column) -> Column:
    return F.trim(permission).isin("*", "*:*") | permission.endswith(".*") | permission.contains(":*")


def destination_is_broad(target: Column) -> Column:
    plain = F.lower(F.trim(target))
    return plain.isin(*BROAD_DESTINATIONS) | plain.startswith("*.")


def resource_is_broad(selector: Column) -> Column:
    return F.trim(selector).isin(*BROAD_RESOURCES)


def package_is_unpinned(command: Column, args: Column) -> Column:
    package = F.get(F.filter(args, lambda a: ~a.startswith("-")), F.lit(0))
    ats = F.char_length(package) - F.char_length(F.replace(package, F.lit("@"), F.lit("")))
    loose = F.when(package.isNull() | (package == ""), False).when(package.endswith("@latest"), True).when(package.startswith("@"), ats < 2).otherwise(ats == 0)
    return F.coalesce(F.lower(command).isin(*PACKAGE_RUNNERS) & loose, F.lit(False))


def host_of(target: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(target, F.lit("HOST"))), target)


def is_loopback(url: Column) -> Column:
    host = F.regexp_replace(host_of(url), r"^\[|\]$", "")
    return (host == "localhost") | host.endswith(".localhost") | host.rlike(r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$") | (host == "::1")


def service_account(principal: Column) -> Column:
    """Canonical e-mail of a service account, or null."""
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(principal, r"^serviceAccount:", ""), r"^.*/serviceAccounts/", "")))
    return F.when(plain.rlike(r"^[a-z0-9][a-z0-9-]*@[a-z0-9][a-z0-9.-]*\.gserviceaccount\.com$"), plain)


def source_context(path: Column) -> Column:
    """First matching context of a path: notebook, test, example, ... , runtime; unknown for null."""
    plain = F.lower(path)
    parts, name = F.split(plain, "/"), F.element_at(F.split(plain, "/"), -1)

    def marked(markers) -> Column:
        # a part equals a marker, or has it before or after _ or -
        pattern = "^(?:{0})$|^(?:{0})[_-]|[_-](?:{0})$".format("|".join(markers))
        return F.exists(parts, lambda p: p.rlike(pattern))

    more = {
        "test": name.rlike(r"^tests?_"),
        "template-generated": name.contains(".template.") | name.rlike(r"\.(template|j2|jinja|jinja2)$"),
        "cli": name.isin("__main__.py", "cli.py") | name.endswith("_cli.py"),
    }
    out = F.when(path.isNull(), "unknown").when(name.rlike(r"[^.].*\.ipynb$"), "notebook")
    for context, markers in CONTEXT_MARKERS:
        test = marked(markers)
        out = out.when(test | more[context] if context in more else test, context)
    return out.otherwise("runtime")


def _tokens(name: Column, kind: Column) -> Column:
    return F.split(F.lower(F.concat_ws(" ", name, kind)), "[^a-z0-9]+")


def mutation_semantics(caps: Column, name: Column, kind: Column) -> Column:
    has = lambda c: F.array_contains(caps, c)
    return (
        F.when(has("destructive.write"), "destructive_write")
        .when(has("external.write"), "external_side_effect")
        .when(~has("data.write"), None)
        .when(any_of(_tokens(name, kind), PERSISTENT_MARKERS), "persistent_internal_write")
        .when(any_of(_tokens(name, kind), SESSION_MARKERS), "local_session_state_write")
        .otherwise("internal_write_unspecified")
    )


def network_semantics(caps: Column, scope: Column, destinations: Column, unrestricted: Column) -> Column:
    """`destinations` and `unrestricted`: numbers of the tool's destinations, and of those not restricted."""
    has = lambda c: F.array_contains(caps, c)
    return (
        F.when(~has("network.external"), None)
        .when(scope.isin("fixed_managed_service", "explicit_destination") | ((destinations > 0) & (unrestricted == 0)), "fixed_provider_network")
        .when(has("external.write"), "arbitrary_egress")
        .otherwise("arbitrary_internet_retrieval")
    )


def sensitive_write_domain(caps: Column, name: Column, kind: Column) -> Column:
    return F.when(any_of(caps, ("data.write", "external.write", "destructive.write")) & any_of(_tokens(name, kind), SENSITIVE_WRITE_MARKERS), "financial_identity_or_security")


def stable_id(prefix: str, *parts: Column, digits: int = 20) -> Column:
    """prefix and the first hex digits of the SHA-256 of the NUL-joined parts."""
    payload = F.concat_ws("\x00", *parts)
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload.cast("binary"), 256), 1, digits))


def relative_path(path: Column, root: str) -> Column:
    """A path below `root` without it; any other path's last part, so that no report shows where a scan ran."""
    inside = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(inside)), F.substring(path, len(inside) + 1, F.length(path))).when(F.startswith(path, F.lit("/")), F.element_at(F.split(path, "/"), -1)).otherwise(path)


def nfc(text: Column) -> Column:
    """Text in Unicode's composed form, so that one fingerprint stands for both spellings. No built-in function does it."""

    return F.pandas_udf(lambda texts: texts.str.normalize("NFC"), StringType(), F.PandasUDFType.SCALAR)(text)


def permission_classes(permission: Column) -> Column:
    """Boundary classes a permission touches."""
    plain = F.lower(permission)
    tests = (
        ("destructive_mutation", plain.contains(".delete")),
        ("identity_or_iam_mutation", plain.contains("setiampolicy") | plain.contains("serviceaccounts.actas")),
        ("persistent_or_external_mutation", plain.rlike(r"\.(create|update|write|set|publish|send)")),
        ("secret_access", plain.contains("secretmanager") | plain.contains(".secrets.")),
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
