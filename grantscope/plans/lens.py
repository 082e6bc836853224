"""Facts at volume: a fixed reading of the supplied tables as agent facts, in SQL that Spark and DuckDB share.

The reading is a device for running the operators over large tables; it says nothing about the tables
themselves. Suppliers are agents, the parts they ship their tools, customers the servers they are bound to.
No row is left out: every (supplier, part) pair is a tool, every lineitem a grant, every supplier has a policy.
A tool's resource and destination are attributes of the pair and may be null; a null one is no fact, and the
tool stays with that dimension unresolved. Roles and permissions are fine enough that an agent's sets differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantscope.functions.cuts import cut_by

VIEWS = {
    "agents": """
SELECT s_suppkey AS agent_key, s_name AS name, s_suppkey AS ordinal,
  CASE s_suppkey % 4 WHEN 0 THEN 'google-adk' WHEN 1 THEN 'openai-agents' WHEN 2 THEN 'langgraph' ELSE 'pydantic-ai' END AS framework,
  CASE s_suppkey % 9 WHEN 0 THEN 'tests/test_agent.py' WHEN 1 THEN 'examples/demo/agent.py' WHEN 2 THEN 'notebooks/run.ipynb' WHEN 3 THEN 'scripts/deploy.py' WHEN 4 THEN NULL ELSE 'app/agents/main.py' END AS path,
  s_suppkey % 11 = 0 AS approval_plugin, s_suppkey % 13 = 0 AS before_tool_callback, s_suppkey % 7 = 0 AS safety_plugin, s_suppkey % 5 = 0 AS a2a_exposed
FROM supplier""",
    "delegations": """
SELECT p.s_suppkey AS agent_key, c.s_name AS target FROM supplier p JOIN supplier c ON c.s_suppkey = 2 * p.s_suppkey
UNION ALL SELECT p.s_suppkey, c.s_name FROM supplier p JOIN supplier c ON c.s_suppkey = 2 * p.s_suppkey + 1
UNION ALL SELECT p.s_suppkey, c.s_name FROM supplier p JOIN supplier c ON p.s_suppkey % 17 = 0 AND c.s_suppkey = CAST((p.s_suppkey - p.s_suppkey % 2) / 2 AS BIGINT)""",
    "tools": """
SELECT l_suppkey AS agent_key, 'tool-' || CAST(l_partkey AS STRING) AS name,
  CASE l_partkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'generic' WHEN 2 THEN 'apply_patch' ELSE 'hosted' END AS kind,
  CASE l_partkey % 10 WHEN 0 THEN 'process.execute' WHEN 1 THEN 'data.read' WHEN 2 THEN 'data.write,network.external' WHEN 3 THEN 'external.write,network.external'
    WHEN 4 THEN 'destructive.write' WHEN 5 THEN 'data.read,secrets.read' WHEN 6 THEN 'identity.admin' WHEN 7 THEN 'network.external' WHEN 8 THEN '' ELSE 'computer.control' END AS caps,
  CASE min(l_linenumber) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS approval, min(l_returnflag) = 'A' AS guardrails,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'sa-' || CAST(l_partkey % 5 AS STRING) END AS identity,
  CASE l_partkey % 6 WHEN 0 THEN 'fixed_managed_service' WHEN 1 THEN 'explicit_destination' ELSE NULL END AS network_scope
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "tool_details": """
SELECT l_suppkey AS agent_key, 'tool-' || CAST(l_partkey AS STRING) AS name,
  CASE l_partkey % 9 WHEN 0 THEN 'adk_code_executor' WHEN 1 THEN 'adk_agent_tool' WHEN 2 THEN 'adk_a2a_remote' ELSE NULL END AS part_of,
  CASE l_partkey % 13 WHEN 0 THEN 'EnvironmentToolset' WHEN 1 THEN 'ExecuteBashTool' WHEN 2 THEN 'ComputerUseToolset' WHEN 3 THEN 'BigQueryToolset' WHEN 4 THEN 'GmailToolset' WHEN 5 THEN 'OpenAPIToolset' ELSE NULL END AS builtin,
  CASE l_partkey % 27 WHEN 0 THEN 'UnsafeLocalCodeExecutor' WHEN 9 THEN 'VertexAiCodeExecutor' ELSE NULL END AS executor,
  CASE l_partkey % 4 WHEN 0 THEN FALSE WHEN 1 THEN TRUE ELSE NULL END AS sandboxed, CASE l_partkey % 26 WHEN 0 THEN 'LocalEnvironment' ELSE NULL END AS environment,
  l_partkey % 5 = 0 AS bash_restrictive, l_partkey % 7 <> 0 AS limits_applicable, l_partkey % 3 = 0 AS limits_complete,
  CASE l_partkey % 6 WHEN 1 THEN FALSE WHEN 4 THEN TRUE ELSE NULL END AS include_plugins,
  CASE l_partkey % 4 WHEN 0 THEN 'http://card.example.com/a' WHEN 1 THEN 'https://card.example.com/a' ELSE NULL END AS agent_card,
  CASE l_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS card_authenticated, l_partkey % 8 = 4 AS filtered, l_partkey % 2 = 1 AS control_custom, l_partkey % 3 <> 1 AS control_mutating
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "unbound_tools": """
SELECT 'loose-' || CAST(p_partkey AS STRING) AS name, CASE p_partkey % 3 WHEN 0 THEN 'process.execute' WHEN 1 THEN 'data.read' ELSE '' END AS caps,
  CASE p_size % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS approval FROM part""",
    "global_identities": """
SELECT 'ga-' || CAST(c_custkey AS STRING) AS name, 'gcp' AS provider,
  CASE c_custkey % 4 WHEN 0 THEN 'roles/editor' WHEN 1 THEN 'roles/viewer' ELSE '' END AS roles, CASE c_custkey % 5 WHEN 0 THEN 'compute.*' ELSE '' END AS permissions,
  CASE c_custkey % 7 WHEN 0 THEN 'https://www.googleapis.com/auth/drive' ELSE '' END AS oauth_scopes, CASE c_custkey % 6 WHEN 0 THEN 'plaintext' ELSE NULL END AS credential_source
FROM customer""",
    "flows": """
SELECT 'flow-' || CAST(o_orderkey AS STRING) AS flow_id, o_custkey % (SELECT count(*) FROM supplier) + 1 AS agent_key,
  CASE o_orderkey % 6 WHEN 0 THEN 'user_input' WHEN 1 THEN 'web_retrieval' WHEN 2 THEN 'secret_value' WHEN 3 THEN 'agent_tool_input' WHEN 4 THEN 'mcp_response' ELSE 'external_http_response' END AS source_kind,
  CASE o_custkey % 3 WHEN 0 THEN 'process_execute' WHEN 1 THEN 'memory_write' ELSE 'external_send' END AS sink_kind,
  CASE o_orderstatus WHEN 'P' THEN 'potential' ELSE 'supported' END AS confidence,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'proven_agent_reachable' WHEN '2-HIGH' THEN 'proven_agent_reachable' WHEN '3-MEDIUM' THEN 'proven_non_agent' ELSE 'unknown' END AS reachability,
  CASE o_orderkey % 7 WHEN 0 THEN 'test' ELSE 'runtime' END AS execution_context
FROM orders""",
    "identities": """
SELECT s_suppkey AS agent_key, 'sa-' || CAST(k AS STRING) AS name, 'gcp' AS provider,
  CASE (s_suppkey + k) % 4 WHEN 0 THEN 'roles/owner' WHEN 1 THEN 'roles/storage.objectViewer,roles/bigquery.dataViewer' WHEN 2 THEN 'roles/bigquery.dataEditor' ELSE '' END AS roles,
  CASE (s_suppkey + k) % 3 WHEN 0 THEN 'storage.objects.get' WHEN 1 THEN 'storage.*,iam.roles.create' ELSE '' END AS permissions,
  CASE (s_suppkey + k) % 5 WHEN 0 THEN 'https://www.googleapis.com/auth/drive' ELSE '' END AS oauth_scopes,
  CASE (s_suppkey + k) % 6 WHEN 0 THEN 'hardcoded' WHEN 1 THEN NULL ELSE 'env' END AS credential_source
FROM supplier, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n""",
    "resources": """
SELECT * FROM (SELECT l_suppkey AS agent_key, 'tool-' || CAST(l_partkey AS STRING) AS owner_name,
  CASE WHEN min(l_orderkey) % 3 = 0 THEN NULL ELSE CASE l_partkey % 5 WHEN 0 THEN '*' WHEN 1 THEN 'bucket/' || CAST(l_partkey % 40 AS STRING) WHEN 2 THEN 'db/orders' WHEN 3 THEN '/' ELSE 'queue/' || CAST(l_partkey % 7 AS STRING) END END AS selector,
  CASE l_partkey % 6 WHEN 0 THEN 'confidential' WHEN 1 THEN 'restricted' ELSE 'internal' END AS classification
FROM lineitem GROUP BY l_suppkey, l_partkey) t WHERE selector IS NOT NULL""",
    "destinations": """
SELECT * FROM (SELECT l_suppkey AS agent_key, 'tool-' || CAST(l_partkey AS STRING) AS owner_name,
  CASE WHEN min(l_orderkey) % 4 = 0 THEN NULL ELSE CASE l_partkey % 6 WHEN 0 THEN '*' WHEN 1 THEN 'api.example.com' WHEN 2 THEN '*.corp.internal' WHEN 3 THEN 'https://Files.Example.com/x' WHEN 4 THEN '0.0.0.0/0' ELSE 'db.internal' END END AS target,
  l_partkey % 3 <> 0 AS restricted
FROM lineitem GROUP BY l_suppkey, l_partkey) t WHERE target IS NOT NULL""",
    "mcp_servers": """
SELECT c_custkey % (SELECT count(*) FROM supplier) + 1 AS agent_key, 'mcp-' || CAST(c_custkey AS STRING) AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'stdio' ELSE 'sse' END AS transport,
  CASE c_custkey % 6 WHEN 0 THEN 'http://tools.example.com/mcp' WHEN 2 THEN 'https://mcp.example.com/sse' WHEN 3 THEN 'http://localhost:8080/mcp' WHEN 5 THEN 'https://127.0.0.1/sse' ELSE NULL END AS url,
  CASE c_custkey % 6 WHEN 1 THEN 'npx' WHEN 4 THEN 'uvx' ELSE NULL END AS command,
  CASE c_custkey % 12 WHEN 1 THEN '-y,@scope/server' WHEN 7 THEN '-y,server@1.2.3,/' WHEN 4 THEN 'server,.' ELSE 'server' END AS args,
  CASE c_custkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS authenticated, CASE c_custkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS approval, c_custkey % 8 = 0 AS guardrails,
  CASE c_custkey % 4 WHEN 0 THEN 'read,search' WHEN 1 THEN 'read,write' ELSE '' END AS allowed_tools, CASE c_custkey % 6 WHEN 2 THEN 'delete' ELSE '' END AS denied_tools,
  c_custkey % 10 = 3 AS dynamic_tool_filter, CASE WHEN c_custkey % 3 = 0 THEN 'sa-1' ELSE NULL END AS identity
FROM customer""",
    "inputs": """
SELECT s_suppkey AS agent_key, 'in-' || CAST(s_nationkey AS STRING) AS name, CASE WHEN s_nationkey % 3 = 0 THEN 'untrusted' ELSE 'trusted' END AS trust,
  CASE s_nationkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'user' WHEN 2 THEN 'email' ELSE 'internal' END AS kind
FROM supplier""",
    "policies": """
SELECT s_suppkey AS agent_key, CASE s_suppkey % 3 WHEN 0 THEN 'data.read,network.external' ELSE '' END AS required, CASE s_suppkey % 4 WHEN 0 THEN 'process.execute,identity.admin' ELSE '' END AS denied,
  CASE s_suppkey % 2 WHEN 0 THEN 'bucket/*,db/?rders' ELSE '' END AS allowed_resources, CASE s_suppkey % 5 WHEN 0 THEN '*.internal,api.*' ELSE '' END AS allowed_destinations,
  CASE s_suppkey % 3 WHEN 1 THEN 'process.execute,external.write' ELSE '' END AS require_approval_for, CASE WHEN s_suppkey % 6 = 0 THEN 2 ELSE NULL END AS max_privileged
FROM supplier""",
    "clauses": """
SELECT s_suppkey AS agent_key, m AS mode, d AS dimension, p AS pattern FROM supplier, (
  SELECT 0 AS k, 'allow' AS m, 'capabilities' AS d, 'data.*' AS p UNION ALL SELECT 0, 'allow', 'capabilities', 'network.external' UNION ALL SELECT 1, 'deny', 'capabilities', 'process.*'
  UNION ALL SELECT 1, 'allow', 'resources', 'bucket/*' UNION ALL SELECT 2, 'deny', 'destinations', '0.0.0.0/?' UNION ALL SELECT 2, 'allow', 'destinations', '*.internal'
  UNION ALL SELECT 0, 'deny', 'iam_roles', 'roles/[op]*' UNION ALL SELECT 1, 'allow', 'permissions', 'storage.objects.*' UNION ALL SELECT 2, 'allow', 'identities', 'sa-[0-2]' UNION ALL SELECT 0, 'deny', 'oauth_scopes', '*drive') c
WHERE s_suppkey % 3 = k""",
    "grants": """
SELECT l_suppkey AS agent_key, 'roles/' || p_brand || '/' || CAST(p_size AS STRING) AS role, 'perm.' || p_type || '.' || CAST(p_partkey AS STRING) AS permission, l_returnflag = 'R' AS conditional, l_linestatus = 'F' AS required, l_shipdate < TIMESTAMP '1995-06-17 00:00:00' AS base
FROM lineitem JOIN part ON l_partkey = p_partkey""",
}
#: Columns that hold comma-joined lists.
LISTS = {"caps", "roles", "permissions", "oauth_scopes", "args", "allowed_tools", "denied_tools", "required", "denied", "allowed_resources", "allowed_destinations", "require_approval_for"}


@dataclass(frozen=True)
class FactSet:
    """The fact tables of one snapshot, as DataFrames; lists are arrays."""

    agents: DataFrame
    delegations: DataFrame
    tools: DataFrame
    tool_details: DataFrame
    unbound_tools: DataFrame
    global_identities: DataFrame
    flows: DataFrame
    identities: DataFrame
    resources: DataFrame
    destinations: DataFrame
    mcp_servers: DataFrame
    inputs: DataFrame
    policies: DataFrame
    clauses: DataFrame
    grants: DataFrame


#: The supplied tables that the views read.
SOURCES = ("supplier", "lineitem", "customer", "part", "orders")
#: What the views read of a (supplier, part) pair's lines: the least values of these.
PAIR_LEAST = ("l_orderkey", "l_linenumber", "l_returnflag")


def _sources(spark: SparkSession, sf_dir: str, names) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"lens_{t}")


def _reads(sql: str) -> list[str]:
    return [t for t in SOURCES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]


def facts(spark: SparkSession, sf_dir: str) -> FactSet:
    _sources(spark, sf_dir, SOURCES)
    return FactSet(**{name: _rows(spark, sql) for name, sql in VIEWS.items()})


def agent_parts(spark: SparkSession) -> int:
    """Into how many parts facts_by_agent() deals the agents."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def facts_by_agent(spark: SparkSession, sf_dir: str) -> FactSet:
    """facts(), with tools, resources, destinations and identities dealt by agent: what is joined within one stays in place.

    The (supplier, part) pairs are written once, each with the least values of its lines; the views read them as they
    would the lines.
    """
    fs, parts = facts(spark, sf_dir), agent_parts(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", *PAIR_LEAST).repartition(parts, "l_suppkey")
    pairs = cut_by(lines.groupBy("l_suppkey", "l_partkey").agg(*[F.min(c).alias(c) for c in PAIR_LEAST]), "lens-pairs", "l_suppkey", parts)
    pairs.createOrReplaceTempView("lens_pairs")
    of_pairs = {name: _rows(spark, VIEWS[name].replace("FROM lineitem GROUP BY", "FROM lens_pairs GROUP BY")) for name in ("tools", "tool_details", "resources", "destinations")}
    return replace(fs, **of_pairs, identities=fs.identities.repartition(parts, "agent_key"))


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of `sql` over the supplied tables; columns named like lists become arrays."""
    _sources(spark, sf_dir, _reads(sql))
    return _rows(spark, sql)


def _rows(spark: SparkSession, sql: str) -> DataFrame:
    for t in _reads(sql):
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 lens_{t}", sql)
    df = spark.sql(sql)
    empty = F.array().cast("array<string>")
    lists = {c: F.when(F.col(c) == "", empty).otherwise(F.split(c, ",")) for c in df.columns if c in LISTS and dict(df.dtypes)[c] == "string"}
    return df.withColumns(lists) if lists else df


def with_views(*names: str) -> str:
    """The WITH clause (without WITH) that gives a DuckDB query the named facts."""
    return ",\n".join(f"f_{n} AS ({VIEWS[n]})" for n in names)
