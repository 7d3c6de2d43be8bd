"""Shared inputs: log lines and registries derived from the driver tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.session import configure, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` is its counterpart for the side-by-side check."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take long to read."""
    return spread(table(spark, sf_dir, name))


def text(*parts: Column | str) -> Column:
    """Concatenation of text parts; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def json_line() -> Column:
    return text(
        '{"event_id":', F.col("event_id"), ',"user":{"id":', F.col("user_id"), '},"type":"',
        F.col("event_type"), '","props":', F.col("props"), "}",
    )


def pair_line() -> Column:
    return text("id=", F.col("event_id"), " type=", F.col("event_type"), " user=", F.col("user_id"))


def logs(spark: SparkSession, sf_dir: str, raw: Column | None = None) -> DataFrame:
    """Events as attributed lines: ``source_id, recv_ts, seq, raw``."""
    return lines_of(spark, sf_dir, "events").select(
        text("src", F.col("user_id") % 5).alias("source_id"),
        F.col("ts").cast("timestamp").alias("recv_ts"),
        F.col("event_id").alias("seq"),
        (json_line() if raw is None else raw).alias("raw"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw messages from seven addresses over both transports."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("recv_ts"),
        F.when(F.col("event_id") % 3 == 0, "TCP").otherwise("UDP").alias("transport"),
        (F.lit(514) + (F.col("event_id") % 2).cast("int")).alias("port"),
        text("10.0.0.", F.col("user_id") % 7).alias("source_ip"),
        text("c", F.col("user_id")).alias("conn_id"),
        F.col("event_id").alias("seq"),
        json_line().cast("binary").alias("payload"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as a source registry. Even regions listen on 514, odd ones on 515."""
    key = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        text("src", key).alias("source_id"),
        F.col("r_name").alias("source_name"),
        text("10.0.0.", key).alias("source_ip"),
        (F.lit(514) + (key % 2).cast("int")).cast("int").alias("listener_port"),
        F.when(key == 0, "TCP").otherwise("UDP").alias("protocol"),
        F.when(key % 2 == 0, "FOLDER").otherwise("HEC").alias("target_type"),
        F.lit(7).cast("bigint").alias("batch_size"),
    )


RULE_ROWS = """
    ('src1', 'type', 'error', true, 1.0),
    ('src1', 'props.k', '9', true, 2.0),
    ('src2', 'user.id', '7', true, 1.0),
    ('src2', 'type', 'view', false, 2.0),
    ('src3', 'type', 'click', true, 1.0),
    ('src3', 'absent', 'x', true, 2.0),
    ('src9', 'type', 'signup', true, 1.0)
"""
PAIR_RULE_ROWS = """
    ('src0', 'type', 'error', true, 1.0),
    ('src1', 'user', '6', true, 1.0),
    ('src2', 'a.b', '1', true, 1.0),
    ('src3', 'id', '13', true, 1.0),
    ('src4', 'type', 'view', false, 1.0)
"""


def rules(spark: SparkSession, rows: str = RULE_ROWS) -> DataFrame:
    return spark.sql(
        "SELECT source_id, field, value, enabled, CAST(created AS DOUBLE) AS created "
        f"FROM VALUES {rows} AS t(source_id, field, value, enabled, created)"
    )


def policies(spark: SparkSession, fields: str = "'type','props.k'") -> DataFrame:
    """Active on src0 to src2, switched off on src3, none on src4."""
    return spark.sql(
        f"SELECT source_id, array({fields}) AS fields, enabled, CAST(1.0 AS DOUBLE) AS created "
        "FROM VALUES ('src0', true), ('src1', true), ('src2', true), ('src3', false) "
        "AS t(source_id, enabled)"
    )


# -- the same inputs in SQL -------------------------------------------------------------

LINES_SQL = """
lines AS (
  SELECT 'src' || (user_id % 5) AS source_id, epoch_us(ts) AS us, event_id AS seq,
         user_id, event_type, ts, props,
         '{"event_id":' || event_id || ',"user":{"id":' || user_id || '},"type":"'
           || event_type || '","props":' || props || '}' AS raw,
         'id=' || event_id || ' type=' || event_type || ' user=' || user_id AS kv
  FROM events)"""

SOURCES_SQL = """
sources AS (
  SELECT 'src' || r_regionkey AS source_id, r_name AS source_name,
         '10.0.0.' || r_regionkey AS source_ip, 514 + r_regionkey % 2 AS listener_port,
         CASE WHEN r_regionkey = 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
         CASE WHEN r_regionkey % 2 = 0 THEN 'FOLDER' ELSE 'HEC' END AS target_type,
         7 AS batch_size
  FROM region)"""

MESSAGES_SQL = """
messages AS (
  SELECT event_id AS seq, 514 + event_id % 2 AS port, '10.0.0.' || (user_id % 7) AS source_ip,
         CASE WHEN event_id % 3 = 0 THEN 'TCP' ELSE 'UDP' END AS transport
  FROM events)"""

RULES_SQL = f"rules(source_id, field, value, enabled, created) AS (VALUES {RULE_ROWS})"

# Lines that no rule denies, by JSON path.
KEPT_SQL = """
kept AS (
  SELECT l.* FROM lines l WHERE NOT EXISTS (
    SELECT 1 FROM rules r WHERE r.source_id = l.source_id AND r.enabled
      AND json_extract_string(l.raw, '$.' || r.field) = r.value))"""


def batches_sql(source: str, size: str, idle_us: int) -> str:
    """CTE ``batched`` over ``source`` by plain ordered windows."""
    return f"""
gaps AS (
  SELECT *, us - lag(us) OVER w AS gap FROM {source} WINDOW w AS (PARTITION BY source_id ORDER BY us, seq)),
runs AS (
  SELECT *, CAST(sum(CASE WHEN gap >= {idle_us} THEN 1 ELSE 0 END)
    OVER (PARTITION BY source_id ORDER BY us, seq) AS BIGINT) AS session FROM gaps),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, session ORDER BY us, seq) - 1 AS rn FROM runs),
batched AS (
  SELECT *, rn // {size} AS chunk, rn % {size} + 1 AS place FROM numbered)"""


POLICY_SOURCES_SQL = "('src0', 'src1', 'src2')"
AGG_KEY_SQL = f"""CASE WHEN source_id IN {POLICY_SOURCES_SQL} THEN
  md5(coalesce(json_extract_string(raw, '$.type'), 'None') || '|' ||
      coalesce(json_extract_string(raw, '$.props.k'), 'None')) END"""
