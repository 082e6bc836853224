"""Sources of declared facts: MCP server configs (JSON), deployment evidence (JSON) and Terraform IAM.

Files are read by Spark (binaryFile or text), parsed by a schema or by Catalyst expressions, and come out as rows;
what can't be read becomes a diagnostic row, never a silent gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantscope.functions import expr as X

# Headers that carry credentials, and the IAM resource types read from Terraform.
AUTH_HEADERS = ("authorization", "proxy-authorization", "x-api-key", "x-goog-api-key")
GCP_RESOURCES = ("google_project_iam_member", "google_project_iam_binding", "google_folder_iam_member", "google_folder_iam_binding", "google_organization_iam_member", "google_organization_iam_binding", "google_service_account_iam_member", "google_service_account_iam_binding")
AZURE_RESOURCES = ("azurerm_role_assignment",)
AWS_RESOURCES = ("aws_iam_role_policy", "aws_iam_policy", "aws_iam_user_policy")
MAX_BYTES = 5 * 1024 * 1024
MAX_NOTEBOOK_BYTES = 25 * 1024 * 1024

_SERVER = "struct<url:string,serverUrl:string,command:string,args:array<string>,headers:map<string,string>,authorization:string,oauth:string,token:string,transport:string,allowedTools:array<string>,allowed_tools:array<string>,deniedTools:array<string>,denied_tools:array<string>>"
_CONFIG = f"struct<mcpServers:map<string,{_SERVER}>,servers:map<string,{_SERVER}>>"
_EVIDENCE = (
    "struct<schema_version:int,provider:string,workloads:array<struct<workload_id:string,kind:string,name:string,identity:string,agent:string,project:string,region:string>>,"
    "iam_bindings:array<struct<principal:string,role:string,scope:struct<kind:string,name:string>,permissions:array<string>,condition:map<string,string>>>,role_permissions:map<string,array<string>>>"
)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text, diagnostic): whole files; text is null, and diagnostic says why, for those too large or not UTF-8."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    text = F.decode("content", "UTF-8")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    limit = F.when(F.lower("path").endswith(".ipynb"), MAX_NOTEBOOK_BYTES).otherwise(MAX_BYTES)
    why = F.when(F.col("length") > limit, "file_too_large").when(~valid, "decode_error")
    return files.select("path", why.alias("diagnostic"), F.when(why.isNull(), text).alias("text"))


def mcp_servers(files: DataFrame) -> DataFrame:
    """(path, name, transport, url, command, args, authenticated, allowed_tools, denied_tools) of MCP JSON configs.

    A config that was read and names no credential is known to be unauthenticated: false, not null.
    """
    parsed = files.select("path", F.from_json("text", _CONFIG).alias("c"))
    servers = F.when(F.size("c.mcpServers") > 0, F.col("c.mcpServers")).otherwise(F.col("c.servers"))
    rows = parsed.select("path", F.explode(servers).alias("name", "s")).filter("s is not null")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    headers = F.transform(F.map_keys("s.headers"), F.lower)
    known = F.coalesce(X.any_of(headers, AUTH_HEADERS), F.lit(False)) | some("s.authorization") | some("s.oauth") | some("s.token")
    filled = lambda *names: F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in names], none)
    url, command = F.coalesce(F.nullif("s.url", F.lit("")), "s.serverUrl"), F.nullif("s.command", F.lit(""))
    return rows.select(
        "path", "name", F.coalesce("s.transport", F.when(command.isNotNull(), "stdio").when(url.isNotNull(), "http").otherwise("unknown")).alias("transport"), url.alias("url"), command.alias("command"), F.coalesce("s.args", none).alias("args"), known.alias("authenticated"),
        filled("s.allowedTools", "s.allowed_tools").alias("allowed_tools"), filled("s.deniedTools", "s.denied_tools").alias("denied_tools"),
    )


def deployment_evidence(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(workloads, bindings, role_permissions) of evidence documents, version 1; any other version is an error."""
    docs = files.select("path", F.from_json("text", _EVIDENCE, {"mode": "FAILFAST"}).alias("e"))
    docs = docs.withColumn("e", F.when(F.col("e.schema_version") == 1, F.col("e")).otherwise(F.raise_error(F.concat(F.lit("unsupported deployment evidence version in "), "path")).cast(_EVIDENCE)))
    workloads = docs.select("path", "e.provider", F.explode("e.workloads").alias("w")).select("path", "provider", "w.*")
    bindings = docs.select("path", "e.provider", F.explode("e.iam_bindings").alias("b")).select("path", "provider", X.service_account(F.col("b.principal")).alias("account"), "b.*", (F.size("b.condition") > 0).alias("conditional"))
    permissions = docs.select("path", F.explode("e.role_permissions").alias("role", "permissions"))
    return workloads, bindings, permissions


def expand_roles(bindings: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Bindings with the permissions of their role added, and resolved = false where neither is known."""
    known = role_permissions.groupBy("role").agg(F.array_distinct(F.flatten(F.collect_list("permissions"))).alias("of_role"))
    out, none = bindings.join(known, "role", "left"), F.array().cast("array<string>")
    both = X.sorted_set(F.concat(F.coalesce("permissions", none), F.coalesce("of_role", none)))
    return out.withColumn("resolved", F.col("permissions").isNotNull() | F.col("of_role").isNotNull()).withColumn("permissions", both).drop("of_role")


def terraform_grants(files: DataFrame) -> DataFrame:
    """(path, resource_type, resource_name, provider, principal, role, permissions) of IAM resources in Terraform text.

    A block runs from its resource line to the next; members are the literal ones.
    """
    blocks = files.filter("text is not null").select("path", F.explode(F.split("text", r"(?m)^(?=\s*resource\s+\")")).alias("block"))
    head = lambda i: F.regexp_extract("block", r'^\s*resource\s+"([^"]+)"\s+"([^"]+)"', i)
    kind = head(1)
    provider = F.when(kind.isin(*GCP_RESOURCES), "gcp").when(kind.isin(*AZURE_RESOURCES), "azure").when(kind.isin(*AWS_RESOURCES), "aws")
    rows = blocks.select("path", "block", kind.alias("resource_type"), head(2).alias("resource_name"), provider.alias("provider")).filter("provider is not null")
    one = F.regexp_extract("block", r'(?m)^\s*(?:member|principal_id)\s*=\s*"([^"]*)"', 1)
    listed = F.regexp_extract_all(F.regexp_extract("block", r"(?s)\bmembers\s*=\s*\[([^\]]*)\]", 1), F.lit('"([^"]+)"'), 1)
    members = F.array_distinct(F.concat(F.when(one == "", F.array().cast("array<string>")).otherwise(F.array(one)), listed))
    role = F.nullif(F.regexp_extract("block", r'(?m)^\s*(?:role|role_definition_name)\s*=\s*"([^"]*)"', 1), F.lit(""))
    actions = F.flatten(F.transform(F.regexp_extract_all("block", F.lit(r'(?s)"?Action"?\s*[:=]\s*(\[[^\]]*\]|"[^"]+")'), 1), lambda a: F.regexp_extract_all(a, F.lit('"([^"]+)"'), 1)))
    rows = rows.select("path", "resource_type", "resource_name", "provider", F.explode_outer(members).alias("principal"), role.alias("role"), X.sorted_set(actions).alias("permissions"))
    return rows.withColumn("principal", F.when(F.col("provider") == "gcp", F.coalesce(X.service_account(F.col("principal")), "principal")).otherwise(F.col("principal")))
