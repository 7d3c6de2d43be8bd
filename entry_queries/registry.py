"""Change logs to current registries, and validation of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_queries.base import LINES_SQL, logs, query, table, text
from linefold.operators import catalog, changes, validation
from linefold.session import scratch
from linefold.sources import registries

RULE_CHANGES_SQL = """
changes AS (
  SELECT event_id AS ord, 'u' || (user_id % 30) AS source_id, event_type AS field, 'v' || event_id AS value,
    CASE WHEN event_id % 13 = 0 THEN 'remove' WHEN event_id % 13 <= 3 THEN 'toggle'
         WHEN event_id % 91 = 4 THEN 'clear' ELSE 'add' END AS op FROM events)"""

# One change after the other, per (source, field); a clear counts for every field.
RULE_STATE_SQL = f"""WITH RECURSIVE {RULE_CHANGES_SQL},
seen AS (SELECT DISTINCT source_id, field FROM changes),
steps AS (
  SELECT s.source_id, s.field, c.ord, c.op, c.value, row_number() OVER (PARTITION BY s.source_id, s.field ORDER BY c.ord) AS n
  FROM seen s JOIN changes c ON c.source_id = s.source_id AND (c.field = s.field OR c.op = 'clear')),
fold(source_id, field, n, here, value, enabled, position) AS (
  SELECT source_id, field, CAST(0 AS BIGINT), false, CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) FROM seen
  UNION ALL
  SELECT f.source_id, f.field, s.n,
    CASE s.op WHEN 'add' THEN true WHEN 'toggle' THEN f.here ELSE false END,
    CASE WHEN s.op = 'add' THEN s.value ELSE f.value END,
    CASE WHEN s.op = 'add' AND NOT f.here THEN true WHEN s.op = 'toggle' AND f.here THEN NOT f.enabled ELSE f.enabled END,
    CASE WHEN s.op = 'add' AND NOT f.here THEN s.ord ELSE f.position END
  FROM fold f JOIN steps s ON s.source_id = f.source_id AND s.field = f.field AND s.n = f.n + 1),
last AS (SELECT source_id, field, max(n) AS n FROM fold GROUP BY 1, 2),
state AS (SELECT f.* FROM fold f JOIN last USING (source_id, field, n) WHERE f.here)"""


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    op = (
        F.when(key % 13 == 0, "remove")
        .when(key % 13 <= 3, "toggle")
        .when(key % 91 == 4, "clear")
        .otherwise("add")
    )
    return table(spark, sf_dir, "events").select(
        key.alias("ord"),
        op.alias("op"),
        text("u", F.col("user_id") % 30).alias("source_id"),
        F.col("event_type").alias("field"),
        text("v", key).alias("value"),
        key.cast("double").alias("ts"),
    )


@query(
    "rule_state",
    RULE_STATE_SQL + " SELECT source_id, field, value, enabled, position FROM state",
)
def rule_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.rule_state(rule_changes(spark, sf_dir)).drop("created")


@query(
    "rule_preview",
    RULE_STATE_SQL
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS place FROM state)
SELECT source_id, place, field, value FROM placed WHERE place <= 2 AND enabled""",
)
def rule_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = changes.rule_state(rule_changes(spark, sf_dir))
    return changes.rule_preview(held).withColumn("place", F.col("place").cast("bigint"))


POLICY_CHANGES_SQL = """
changes AS (
  SELECT event_id AS ord, 'u' || (user_id % 40) AS source_id,
    CASE WHEN event_id % 33 = 0 THEN 'delete_template' WHEN event_id % 11 <= 1 THEN 'template'
         WHEN event_id % 11 <= 3 THEN 'create' WHEN event_id % 11 = 8 THEN 'delete' ELSE 'update' END AS op,
    CASE WHEN event_id % 2 = 0 THEN event_type || ',k' || event_id END AS fields,
    CASE WHEN event_id % 2 = 1 THEN event_id % 4 = 1 END AS enabled FROM events)"""

POLICY_STATE_SQL = f"""WITH RECURSIVE {POLICY_CHANGES_SQL},
steps AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS n FROM changes),
fold(source_id, n, tpl, pol, fields, enabled, created_ord) AS (
  SELECT DISTINCT source_id, CAST(0 AS BIGINT), false, false, CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) FROM changes
  UNION ALL
  SELECT f.source_id, s.n,
    CASE s.op WHEN 'template' THEN true WHEN 'delete_template' THEN false ELSE f.tpl END,
    CASE WHEN s.op = 'create' THEN f.tpl OR f.pol WHEN s.op IN ('delete', 'delete_template') THEN false ELSE f.pol END,
    CASE WHEN s.op = 'create' AND f.tpl THEN coalesce(s.fields, 'none')
         WHEN s.op = 'update' AND f.pol THEN coalesce(s.fields, f.fields) ELSE f.fields END,
    CASE WHEN s.op = 'create' AND f.tpl THEN true
         WHEN s.op = 'update' AND f.pol THEN coalesce(s.enabled, f.enabled) ELSE f.enabled END,
    CASE WHEN s.op = 'create' AND f.tpl THEN s.ord ELSE f.created_ord END
  FROM fold f JOIN steps s ON s.source_id = f.source_id AND s.n = f.n + 1),
last AS (SELECT source_id, max(n) AS n FROM fold GROUP BY 1)
SELECT source_id, fields, enabled, created_ord FROM fold JOIN last USING (source_id, n) WHERE pol"""


@query("policy_state", POLICY_STATE_SQL)
def policy_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    op = (
        F.when(key % 33 == 0, "delete_template")
        .when(key % 11 <= 1, "template")
        .when(key % 11 <= 3, "create")
        .when(key % 11 == 8, "delete")
        .otherwise("update")
    )
    fields = F.when(key % 2 == 0, F.array(F.col("event_type"), text("k", key)))
    log = table(spark, sf_dir, "events").select(
        key.alias("ord"),
        op.alias("op"),
        text("u", F.col("user_id") % 40).alias("source_id"),
        F.when(op == "create", F.coalesce(fields, F.array(F.lit("none")))).otherwise(fields).alias("fields"),
        F.when(key % 2 == 1, key % 4 == 1).alias("enabled"),
    )
    return changes.policy_state(log).withColumn("fields", F.array_join("fields", ","))


SOURCE_STATE_SQL = """WITH RECURSIVE changes AS (
  SELECT event_id AS ord, 'u' || (user_id % 50) AS source_id,
    CASE WHEN event_id % 9 = 0 THEN 'delete' WHEN event_id % 9 <= 2 THEN 'add' ELSE 'update' END AS op,
    CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END AS name,
    CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 1000 AS VARCHAR) END AS port,
    CASE WHEN event_id % 5 = 0 THEN 'TCP' END AS protocol,
    CASE WHEN event_id % 4 = 0 THEN 'HEC' ELSE 'FOLDER' END AS target FROM events),
steps AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS n FROM changes),
fold(source_id, n, here, name, port, protocol, target, position) AS (
  SELECT DISTINCT source_id, CAST(0 AS BIGINT), false, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM changes
  UNION ALL
  SELECT f.source_id, s.n, CASE s.op WHEN 'add' THEN true WHEN 'delete' THEN false ELSE f.here END,
    CASE s.op WHEN 'add' THEN s.name WHEN 'update' THEN coalesce(s.name, f.name) END,
    CASE s.op WHEN 'add' THEN s.port WHEN 'update' THEN coalesce(s.port, f.port) END,
    CASE s.op WHEN 'add' THEN s.protocol WHEN 'update' THEN coalesce(s.protocol, f.protocol) END,
    CASE s.op WHEN 'add' THEN s.target WHEN 'update' THEN coalesce(s.target, f.target) END,
    CASE s.op WHEN 'add' THEN s.ord ELSE f.position END
  FROM fold f JOIN steps s ON s.source_id = f.source_id AND s.n = f.n + 1),
last AS (SELECT source_id, max(n) AS n FROM fold GROUP BY 1)
SELECT source_id, position, name AS source_name, port AS listener_port, coalesce(protocol, 'UDP') AS protocol, target AS target_type,
  CAST(CASE target WHEN 'HEC' THEN 500 WHEN 'FOLDER' THEN 5000 END AS BIGINT) AS batch_size
FROM fold JOIN last USING (source_id, n) WHERE here"""


@query("source_state", SOURCE_STATE_SQL)
def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    none = F.lit(None).cast("string")
    log = table(spark, sf_dir, "events").select(
        key.alias("ord"),
        text("u", F.col("user_id") % 50).alias("source_id"),
        F.when(key % 9 == 0, "delete").when(key % 9 <= 2, "add").otherwise("update").alias("op"),
        F.when(key % 2 == 0, text("n", key)).alias("source_name"),
        F.when(key % 3 == 0, (key % 1000).cast("string")).alias("listener_port"),
        F.when(key % 5 == 0, "TCP").alias("protocol"),
        F.when(key % 4 == 0, "HEC").otherwise("FOLDER").alias("target_type"),
        F.lit(None).cast("bigint").alias("batch_size"),
        *[none.alias(c) for c in ("source_ip", "folder_path", "compression_enabled", "compression_level", "hec_url", "hec_token")],
    )
    return changes.source_state(log).select(
        "source_id", "position", "source_name", "listener_port", "protocol", "target_type", "batch_size"
    )


CANDIDATES_SQL = """
candidates AS (
  SELECT c_custkey AS ord, 'c' || c_custkey AS source_id,
    CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS source_name,
    '10.0.' || (c_custkey % 200) || '.1' AS source_ip,
    CASE WHEN c_custkey % 19 = 0 THEN 'port' ELSE CAST(c_custkey * 97 AS VARCHAR) END AS listener_port,
    CASE WHEN c_custkey % 23 = 0 THEN 'ICMP' ELSE 'TCP' END AS protocol,
    CASE c_custkey % 4 WHEN 0 THEN 'HEC' WHEN 1 THEN 'SYSLOG' ELSE 'FOLDER' END AS target_type,
    CASE WHEN c_custkey % 7 <> 0 THEN '/logs' END AS folder_path,
    CASE WHEN c_custkey % 10 = 0 THEN 'maybe' WHEN c_custkey % 3 = 0 THEN 'true' END AS compression_enabled,
    CASE WHEN c_custkey % 6 = 0 THEN 'best' ELSE CAST(c_custkey % 11 AS VARCHAR) END AS compression_level,
    CASE WHEN c_custkey % 8 <> 0 THEN 'http://hec' END AS hec_url,
    CASE WHEN c_custkey % 12 <> 0 THEN 'token' END AS hec_token
  FROM customer),
checked AS (
  SELECT *, CASE WHEN source_name IS NULL THEN 'Missing required field: source_name'
    WHEN try_cast(listener_port AS BIGINT) IS NULL THEN 'Listener port must be a valid number'
    WHEN CAST(listener_port AS BIGINT) NOT BETWEEN 1 AND 65535 THEN 'Listener port must be between 1 and 65535'
    WHEN protocol NOT IN ('UDP', 'TCP') THEN 'Protocol must be either UDP or TCP'
    WHEN target_type = 'FOLDER' THEN CASE WHEN folder_path IS NULL THEN 'Folder path is required for Folder target'
      WHEN compression_enabled NOT IN ('true', 'false') THEN 'compression_enabled must be a boolean value'
      WHEN try_cast(compression_level AS BIGINT) IS NULL THEN 'Compression level must be a valid integer'
      WHEN CAST(compression_level AS BIGINT) NOT BETWEEN 1 AND 9 THEN 'Compression level must be between 1 and 9' END
    WHEN target_type = 'HEC' THEN CASE WHEN hec_url IS NULL THEN 'HEC URL is required for HEC Connector target'
      WHEN hec_token IS NULL THEN 'HEC token is required for HEC Connector target' END
    ELSE 'Target type must be either FOLDER or HEC' END AS error FROM candidates)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("ord"),
        text("c", key).alias("source_id"),
        F.when(key % 17 != 0, F.col("c_name")).alias("source_name"),
        text("10.0.", key % 200, ".1").alias("source_ip"),
        F.when(key % 19 == 0, "port").otherwise((key * 97).cast("string")).alias("listener_port"),
        F.when(key % 23 == 0, "ICMP").otherwise("TCP").alias("protocol"),
        F.when(key % 4 == 0, "HEC").when(key % 4 == 1, "SYSLOG").otherwise("FOLDER").alias("target_type"),
        F.when(key % 7 != 0, "/logs").alias("folder_path"),
        F.lit(None).cast("bigint").alias("batch_size"),
        F.when(key % 10 == 0, "maybe").when(key % 3 == 0, "true").alias("compression_enabled"),
        F.when(key % 6 == 0, "best").otherwise((key % 11).cast("string")).alias("compression_level"),
        F.when(key % 8 != 0, "http://hec").alias("hec_url"),
        F.when(key % 12 != 0, "token").alias("hec_token"),
    )


@query(
    "source_validation",
    f"WITH {CANDIDATES_SQL} SELECT source_id, error IS NULL AS valid, error FROM checked",
)
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate_sources(candidates(spark, sf_dir))


@query(
    "add_sources",
    f"""WITH {CANDIDATES_SQL},
held AS (SELECT '10.0.' || (s_suppkey * 40) || '.1' AS source_ip, s_name FROM supplier),
takers AS (SELECT source_ip, min(ord) AS ord, arg_min(source_name, ord) AS name FROM checked WHERE error IS NULL GROUP BY 1)
SELECT c.source_id, c.error IS NULL AND h.s_name IS NULL AND c.ord = t.ord AS accepted,
  CASE WHEN h.s_name IS NOT NULL THEN 'IP address ' || c.source_ip || ' is already used by source ''' || h.s_name || ''''
       WHEN c.ord > t.ord THEN 'IP address ' || c.source_ip || ' is already used by source ''' || t.name || ''''
       ELSE c.error END AS error
FROM checked c LEFT JOIN held h USING (source_ip) LEFT JOIN takers t USING (source_ip)""",
)
def add_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "supplier").select(
        text("s", F.col("s_suppkey")).alias("source_id"),
        F.col("s_name").alias("source_name"),
        text("10.0.", F.col("s_suppkey") * 40, ".1").alias("source_ip"),
    )
    return changes.add_sources(current, candidates(spark, sf_dir))


@query(
    "address_check",
    """SELECT c_custkey, CASE WHEN c_custkey % 400 > 255 THEN 'Invalid IP address. Please enter a valid IPv4 address.'
  WHEN c_custkey % 5 = 0 THEN 'Invalid URL. Please enter a valid URL starting with http:// or https://.' END AS error FROM customer""",
)
def address_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    url = F.when(key % 5 == 0, F.lit("ftp://x")).otherwise(F.lit("https://x"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", validation.address_error(text("10.0.0.", key % 400), url).alias("error")
    )


ACCOUNT_FIELDS = "source_id STRING, source_name STRING, source_ip STRING, listener_port STRING, target_type STRING, batch_size BIGINT"


@query(
    "registry_sources",
    """SELECT 'c' || c_custkey AS source_id, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position, c_name AS source_name,
  '10.1.' || (c_custkey % 250) || '.' || (c_custkey // 250 % 250) AS source_ip, CAST(500 + c_custkey % 9 AS VARCHAR) AS listener_port,
  CASE WHEN c_custkey % 2 = 0 THEN 'HEC' ELSE 'FOLDER' END AS target_type,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 700 + 1 AS BIGINT) END AS batch_size, CAST(2 AS BIGINT) AS version FROM customer""",
)
def registry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry saved in its order, exported as a document, read back and saved as the second version."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        text("c", key).alias("source_id"),
        F.col("c_name").alias("source_name"),
        text("10.1.", key % 250, ".", F.floor(key / 250) % 250).alias("source_ip"),
        (F.lit(500) + key % 9).cast("string").alias("listener_port"),
        F.when(key % 2 == 0, "HEC").otherwise("FOLDER").alias("target_type"),
        F.when(key % 3 == 0, key % 700 + 1).cast("bigint").alias("batch_size"),
        F.struct("c_acctbal", key).alias("rank"),
    )
    path = scratch(spark, "registry")
    held = registries.Registry(f"{path}/sources", ACCOUNT_FIELDS)
    held.save(rows, "rank")
    registries.save_document(registries.sources_document(held.load(spark)), f"{path}/document")
    held.save(registries.load_sources(spark, f"{path}/document"))
    return held.load(spark).withColumn("version", F.lit(held.version(spark)).cast("bigint"))


@query(
    "registry_rules",
    """SELECT 'u' || (user_id % 20) AS source_id, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS INTEGER) AS position,
  event_type AS field, CASE WHEN event_id % 7 <> 0 THEN 'v' || event_id END AS value, event_id % 5 <> 0 AS enabled,
  CAST(event_id AS DOUBLE) AS created FROM events""",
)
def registry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules to a document and back; a null value stays null, an absent flag means enabled."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        text("u", F.col("user_id") % 20).alias("source_id"),
        F.col("event_type").alias("field"),
        F.when(key % 7 != 0, text("v", key)).alias("value"),
        F.when(key % 5 == 0, False).when(key % 2 == 0, True).alias("enabled"),
        key.cast("double").alias("created"),
    )
    path = scratch(spark, "registry")
    registries.save_document(registries.rules_document(rows), path)
    return registries.load_rules(spark, path)


@query(
    "registry_policies",
    f"""WITH {LINES_SQL}, t AS (SELECT source_id, arg_min(raw, (us, seq)) AS raw FROM lines GROUP BY 1)
SELECT 'template' AS kind, source_id, raw AS content, true AS enabled, CAST(4 AS BIGINT) AS fields FROM t
UNION ALL SELECT 'policy', 'c' || c_custkey, c_mktsegment || ',k' || c_custkey, c_custkey % 2 = 0, 2 FROM customer""",
)
def registry_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies and learned templates to their common document and back."""
    key = F.col("c_custkey")
    policies = table(spark, sf_dir, "customer").select(
        text("c", key).alias("source_id"),
        F.array("c_mktsegment", text("k", key)).alias("fields"),
        (key % 2 == 0).alias("enabled"),
        key.cast("double").alias("created"),
    )
    learned = catalog.learn_templates(logs(spark, sf_dir)).withColumn("learned", F.lit(0.0))
    path = scratch(spark, "registry")
    registries.save_document(registries.policies_document(policies, learned), path)
    size = F.size("fields").cast("bigint").alias("fields")
    templates = registries.load_templates(spark, path).select(
        F.lit("template").alias("kind"), "source_id", F.col("raw").alias("content"), F.lit(True).alias("enabled"), size
    )
    held = registries.load_policies(spark, path).select(
        F.lit("policy").alias("kind"), "source_id", F.array_join("fields", ",").alias("content"), "enabled", size
    )
    return templates.unionByName(held)
