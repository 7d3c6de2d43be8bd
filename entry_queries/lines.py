"""Deny rules, batching, collapse and the envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_queries.base import (
    AGG_KEY_SQL,
    KEPT_SQL,
    LINES_SQL,
    PAIR_RULE_ROWS,
    RULES_SQL,
    SOURCES_SQL,
    batches_sql,
    json_line,
    lines_of,
    logs,
    pair_line,
    policies,
    query,
    rules,
    sources,
    table,
)
from linefold.operators import batching, collapse, deny, envelope
from linefold.operators.reports import processed_metrics
from linefold.plans.flow import LogFlow

HALF_HOUR = 1800


@query("deny_json", f"WITH {LINES_SQL}, {RULES_SQL}, {KEPT_SQL} SELECT source_id, seq, raw FROM kept")
def deny_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deny.apply_deny_rules(logs(spark, sf_dir), rules(spark)).select("source_id", "seq", "raw")


@query(
    "deny_pairs",
    f"""WITH {LINES_SQL}, rules(source_id, field, value, enabled, created) AS (VALUES {PAIR_RULE_ROWS})
SELECT source_id, seq, kv AS raw FROM lines l WHERE NOT EXISTS (
  SELECT 1 FROM rules r WHERE r.source_id = l.source_id AND r.enabled
    AND list_contains(string_split(l.kv, ' '), r.field || '=' || r.value))""",
)
def deny_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deny.apply_deny_rules(logs(spark, sf_dir, pair_line()), rules(spark, PAIR_RULE_ROWS))
    return kept.select("source_id", "seq", "raw")


@query(
    "deny_dropped",
    f"""WITH {LINES_SQL}, {RULES_SQL}
SELECT l.source_id, l.seq, arg_min(r.field, r.created) AS rule_field, arg_min(r.value, r.created) AS rule_value
FROM lines l JOIN rules r ON r.source_id = l.source_id AND r.enabled
  AND json_extract_string(l.raw, '$.' || r.field) = r.value GROUP BY 1, 2""",
)
def deny_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deny.denied_lines(logs(spark, sf_dir), rules(spark)).select(
        "source_id", "seq", "rule_field", "rule_value"
    )


@query(
    "rule_counts",
    """SELECT 'u' || user_id AS source_id, count(*) AS total_rules,
  count(*) FILTER (WHERE event_type <> 'view') AS enabled_rules FROM events GROUP BY 1""",
)
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_id"),
        F.col("event_type").alias("field"),
        # An unset flag counts as enabled.
        F.when(F.col("event_type") == "view", False).when(F.col("event_type") == "click", True).alias("enabled"),
    )
    return deny.rule_counts(held)


def _batched(spark: SparkSession, sf_dir: str, size: int, idle: int) -> DataFrame:
    return batching.assign_batches(logs(spark, sf_dir), size, idle)


@query(
    "batch_assign",
    f"""WITH {LINES_SQL}, {batches_sql("lines", "500", 60_000_000)}
SELECT source_id, seq, session, chunk, place FROM batched""",
)
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir, 500, 60).select("source_id", "seq", "session", "chunk", "place")


@query(
    "batch_assign_long_idle",
    f"""WITH {LINES_SQL}, {batches_sql("lines", "3", HALF_HOUR * 1_000_000)}
SELECT source_id, seq, session, chunk, place FROM batched""",
)
def batch_assign_long_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir, 3, HALF_HOUR).select("source_id", "seq", "session", "chunk", "place")


@query(
    "batch_assign_hot_cells",
    f"""WITH {LINES_SQL}, {batches_sql("lines", "5", 86_400_000_000)}
SELECT source_id, seq, session, chunk, place FROM batched""",
)
def batch_assign_hot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Day-wide cells hold many seconds each.
    return _batched(spark, sf_dir, 5, 86_400).select(
        "source_id", "seq", "session", "chunk", "place"
    )


@query(
    "batch_sizes",
    f"""WITH {LINES_SQL}, {batches_sql("lines", "3", HALF_HOUR * 1_000_000)}
SELECT source_id, session, chunk, count(*) AS rows FROM batched GROUP BY 1, 2, 3""",
)
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batch_sizes(_batched(spark, sf_dir, 3, HALF_HOUR))


@query(
    "idle_gaps",
    f"""WITH {LINES_SQL}, g AS (
  SELECT source_id, lag(us) OVER (PARTITION BY source_id ORDER BY us, seq) AS last_us, us AS next_us FROM lines)
SELECT source_id, last_us, next_us, next_us - last_us AS gap_us FROM g WHERE next_us - last_us >= 60000000""",
)
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.idle_gaps(logs(spark, sf_dir))


@query("agg_key", f"WITH {LINES_SQL} SELECT source_id, seq, {AGG_KEY_SQL} AS agg_key FROM lines")
def agg_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.with_collapse_key(logs(spark, sf_dir), policies(spark)).select(
        "source_id", "seq", "agg_key"
    )


@query(
    "agg_key_pairs",
    f"""WITH {LINES_SQL}
SELECT source_id, seq, CASE WHEN source_id IN ('src0', 'src1', 'src2') THEN
  md5(event_type || '|None|' || user_id) END AS agg_key FROM lines""",
)
def agg_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = collapse.with_collapse_key(
        logs(spark, sf_dir, pair_line()), policies(spark, "'type','x.y','user'")
    )
    return keyed.select("source_id", "seq", "agg_key")


def _seconds(us: str) -> str:
    """Exact epoch seconds text with six decimals."""
    return f"(({us}) // 1000000) || '.' || lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0')"


def _collapse_sql(scope: list[str], source: str, before: str = "") -> str:
    keys = ", ".join(["source_id", *scope])
    render = f"""CASE WHEN n = 1 THEN first_raw ELSE left(first_raw, length(first_raw) - 1)
  || ', "is_aggregated": "yes", "first_log_time": ' || {_seconds("first_us")}
  || ', "last_log_time": ' || {_seconds("last_us")}
  || ', "total_logs_aggregated": ' || n || '}}' END"""
    return f"""WITH {LINES_SQL}{before},
keyed AS (SELECT *, coalesce({AGG_KEY_SQL}, 'row' || seq) AS k FROM {source}),
grouped AS (
  SELECT {keys}, k, count(*) AS n, min(us) AS first_us, max(us) AS last_us,
         arg_min(raw, (us, seq)) AS first_raw FROM keyed GROUP BY {keys}, k)
SELECT {keys}, n, {render} AS raw FROM grouped"""


@query(
    "collapse_batch",
    _collapse_sql(["session", "chunk"], "batched", ", " + batches_sql("lines", "40", 86_400_000_000)),
)
def collapse_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = collapse.with_collapse_key(logs(spark, sf_dir), policies(spark))
    batched = batching.assign_batches(keyed, 40, 86_400)
    return collapse.collapse(batched).select("source_id", "session", "chunk", "n", "raw")


@query(
    "collapse_minute",
    _collapse_sql(["minute"], "(SELECT *, us // 60000000 AS minute FROM lines)"),
)
def collapse_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = collapse.with_collapse_key(logs(spark, sf_dir), policies(spark))
    return collapse.collapse(keyed, scope="minute").select("source_id", "minute", "n", "raw")


@query("collapse_all", _collapse_sql([], "lines"))
def collapse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = collapse.with_collapse_key(logs(spark, sf_dir), policies(spark))
    return collapse.collapse(keyed, scope="all").select("source_id", "n", "raw")


@query(
    "collapse_pairs",
    f"""WITH {LINES_SQL}, g AS (
  SELECT source_id, CASE WHEN source_id IN ('src0', 'src1', 'src2') THEN event_type ELSE 'row' || seq END AS k,
    count(*) AS n, min(us) AS first_us, max(us) AS last_us, arg_min(seq, (us, seq)) AS f FROM lines GROUP BY 1, 2)
SELECT g.source_id, g.n, CASE WHEN g.n = 1 THEN l.kv ELSE
  '{{' || CASE WHEN l.event_type = 'error' THEN '"log_level":"ERROR",' ELSE '' END || '"id":"' || l.seq || '","type":"' || l.event_type || '","user":"' || l.user_id || '"'
  || ', "is_aggregated": "yes", "first_log_time": ' || {_seconds("g.first_us")}
  || ', "last_log_time": ' || {_seconds("g.last_us")}
  || ', "total_logs_aggregated": ' || g.n || '}}' END AS raw
FROM g JOIN lines l ON l.seq = g.f""",
)
def collapse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = collapse.with_collapse_key(
        logs(spark, sf_dir, pair_line()), policies(spark, "'type'"), mode="clean"
    )
    return collapse.collapse(keyed, scope="all", mode="clean").select("source_id", "n", "raw")


@query(
    "collapse_json_values",
    f"""WITH {LINES_SQL}
SELECT source_id, count(*) AS n, '[' || arg_min(seq, (us, seq)) || ', 1]' ||
  CASE WHEN count(*) > 1 THEN ' [Aggregated: ' || count(*) || ' logs]' ELSE '' END AS raw
FROM lines GROUP BY source_id, CASE WHEN source_id IN ('src0', 'src1', 'src2') THEN 0 ELSE seq + 1 END""",
)
def collapse_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that is no object shares the all-absent key."""
    line = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(", 1]"))
    keyed = collapse.with_collapse_key(logs(spark, sf_dir, line), policies(spark))
    return collapse.collapse(keyed, scope="all").select("source_id", "n", "raw")


@query(
    "collapse_slots",
    f"""WITH {LINES_SQL}, {batches_sql("lines", "40", 86_400_000_000)},
keyed AS (SELECT *, {AGG_KEY_SQL} AS k, seq % 10 = 0 AS failed FROM batched),
g AS (SELECT source_id, session, chunk, coalesce(CASE WHEN NOT failed THEN k END, 'row' || seq) AS kk,
  bool_or(failed) AS failed, min(place) AS own, count(*) AS n FROM keyed GROUP BY 1, 2, 3, 4)
SELECT source_id, session, chunk, n, own AS slot_order,
  CASE WHEN failed THEN min(own) OVER (PARTITION BY source_id, session, chunk, failed) ELSE own END AS slot FROM g""",
)
def collapse_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a usable key stay whole, together at the slot of their first."""
    keyed = collapse.with_collapse_key(logs(spark, sf_dir), policies(spark))
    batched = batching.assign_batches(keyed, 40, 86_400).withColumn("failed", F.col("seq") % 10 == 0)
    return collapse.collapse(batched, failed="failed").select(
        "source_id", "session", "chunk", "n", "slot", "slot_order"
    )


@query(
    "reduction_stats",
    f"""WITH {LINES_SQL}, {batches_sql("lines", "40", 86_400_000_000)}
SELECT source_id, session, chunk, count(*) AS rows_in, count(DISTINCT coalesce({AGG_KEY_SQL}, 'row' || seq)) AS rows_out
FROM batched GROUP BY 1, 2, 3""",
)
def reduction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = collapse.with_collapse_key(logs(spark, sf_dir), policies(spark))
    return collapse.reduction_stats(batching.assign_batches(keyed, 40, 86_400))


@query(
    "envelope",
    """SELECT event_id AS seq, '{"time": ' || epoch_us(ts) // 1000000 || ', "event": {"event_id":' || event_id
  || ',"user":{"id":' || user_id || '},"type":"' || event_type || '","props":' || props
  || '}, "source": "' || event_type || '"}' AS line FROM events
UNION ALL SELECT -1 - doc_id, '{"time": 0, "event": ' || CAST(to_json(text) AS VARCHAR) || ', "source": "' || source || '"}'
FROM documents""",
)
def envelope_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lines_of(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"),
        json_line().alias("raw"),
        F.col("event_type").alias("source_name"),
    )
    docs = table(spark, sf_dir, "documents").select(
        (F.lit(-1) - F.col("doc_id")).alias("seq"),
        F.lit(0).cast("bigint").alias("t"),
        F.col("text").alias("raw"),
        F.col("source").alias("source_name"),
    )
    return envelope.envelope(events.unionByName(docs), F.col("t")).select("seq", "line")


@query(
    "envelope_fields",
    """SELECT epoch_us(ts) // 1000000 AS time, event_type AS type, user_id, event_type AS source FROM events""",
)
def envelope_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = lines_of(spark, sf_dir, "events").select(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"),
        json_line().alias("raw"),
        F.col("event_type").alias("source_name"),
    )
    return envelope.envelope_struct(events, F.col("t")).select(
        "time",
        F.try_variant_get("event", "$.type", "string").alias("type"),
        F.try_variant_get("event", "$.user.id", "bigint").alias("user_id"),
        "source",
    )


def flow_sql(size: int = 7, idle_us: int = 60_000_000) -> str:
    return f"""WITH {LINES_SQL}, {SOURCES_SQL}, {RULES_SQL}, {KEPT_SQL}, {batches_sql("kept", str(size), idle_us)},
keyed AS (SELECT *, coalesce({AGG_KEY_SQL}, 'row' || seq) AS k FROM batched),
grouped AS (
  SELECT source_id, session, chunk, k, count(*) AS n, min(us) AS first_us, max(us) AS last_us,
         min(place) AS slot, arg_min(raw, place) AS first_raw FROM keyed GROUP BY 1, 2, 3, 4)
SELECT source_id, session, chunk, slot, n, target_type, '{{"time": 0, "event": ' ||
  CASE WHEN n = 1 THEN first_raw ELSE left(first_raw, length(first_raw) - 1)
  || ', "is_aggregated": "yes", "first_log_time": ' || {_seconds("first_us")}
  || ', "last_log_time": ' || {_seconds("last_us")}
  || ', "total_logs_aggregated": ' || n || '}}' END || ', "source": "' || source_name || '"}}' AS line
FROM grouped JOIN sources USING (source_id)"""


FLOW_SQL = flow_sql()


def flow(spark: SparkSession, sf_dir: str, size: int = 7, **options) -> LogFlow:
    held = sources(spark, sf_dir).withColumn("batch_size", F.lit(size).cast("bigint"))
    return LogFlow(held, rules(spark), policies(spark), **options)


@query("deliver_lines", FLOW_SQL)
def deliver_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: settings, deny rules, batches, collapse, envelope."""
    out = flow(spark, sf_dir).run(logs(spark, sf_dir), F.lit(0))
    return out.select("source_id", "session", "chunk", "slot", "n", "target_type", "line")


@query(
    "processed_metrics",
    f"""WITH {LINES_SQL}, {RULES_SQL}, {KEPT_SQL}, g AS (
  SELECT source_id, us // 60000000 AS minute, coalesce({AGG_KEY_SQL}, 'row' || seq) AS k, max(us) AS last_us
  FROM kept GROUP BY 1, 2, 3)
SELECT source_id, count(*) AS processed, max(last_us) AS last_us FROM g GROUP BY 1""",
)
def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_minute = flow(spark, sf_dir, scope="minute")
    delivered = by_minute.collapsed(by_minute.lines(logs(spark, sf_dir)))
    return processed_metrics(delivered, "last_us").withColumnRenamed("last_processed", "last_us")
