"""Status, health, display helpers and the lockout detector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_queries.base import query, table, text
from linefold.functions import text as display
from linefold.operators import lockout, reports

ACCOUNTS_SQL = """
accounts AS (SELECT 'u' || c_custkey AS source_id, c_name AS source_name, c_mktsegment AS segment,
  CAST(500 + c_custkey % 50 AS BIGINT) AS listener_port, CASE WHEN c_custkey % 2 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
  CASE WHEN c_custkey % 3 = 0 THEN 'HEC' ELSE 'FOLDER' END AS target_type, c_custkey FROM customer)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources; the events of the user with that number are its lines."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        text("u", key).alias("source_id"),
        F.col("c_name").alias("source_name"),
        F.col("c_mktsegment").alias("segment"),
        (F.lit(500) + key % 50).cast("bigint").alias("listener_port"),
        F.when(key % 2 == 0, "UDP").otherwise("TCP").alias("protocol"),
        F.when(key % 3 == 0, "HEC").otherwise("FOLDER").alias("target_type"),
        key,
    )


def user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        text("u", F.col("user_id")).alias("source_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("recv_ts"),
        "event_type",
    )


@query(
    "backlog",
    """SELECT 'u' || user_id AS source_id, count(*) AS backlog FROM events WHERE event_id % 3 <> 0 GROUP BY 1""",
)
def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = user_lines(spark, sf_dir)
    return reports.backlog(lines, lines.where("seq % 3 = 0"))


@query(
    "status_report",
    f"""WITH {ACCOUNTS_SQL}, m AS (
  SELECT 'u' || user_id AS source_id, count(*) AS processed, max(ts) AS last, count(DISTINCT event_type) AS fields,
    count(*) FILTER (WHERE event_id % 3 <> 0) AS waiting FROM events GROUP BY 1)
SELECT source_id, CASE WHEN length(source_name) > 18 THEN left(source_name, 16) || '..' ELSE source_name END AS name,
  coalesce(waiting, 0) AS backlog, coalesce(processed, 0) AS processed,
  coalesce(strftime(date_trunc('second', last), '%Y-%m-%d %H:%M:%S'), 'Never') AS last_activity,
  concat_ws(' ', '[T:' || fields || ']', CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN '[A]' END) AS marks
FROM accounts LEFT JOIN m USING (source_id)""",
)
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, lines = accounts(spark, sf_dir), user_lines(spark, sf_dir)
    counts = lines.groupBy("source_id").agg(F.count_distinct("event_type").alias("fields"))
    policies = held.where("c_custkey % 2 = 0").select(
        # An unset flag does not count as enabled here.
        "source_id", F.when(F.col("c_custkey") % 3 == 0, True).alias("enabled")
    )
    waiting = reports.backlog(lines, lines.where("seq % 3 = 0"))
    return reports.status_report(held, reports.processed_metrics(lines), counts, policies, waiting)


HEALTH_SQL = f"""WITH {ACCOUNTS_SQL}, w AS (
  SELECT 'u' || user_id AS source_id, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
named AS (SELECT segment || (c_custkey % 10) AS source_name, coalesce(n, 0) AS queue_size, CAST(0 AS BIGINT) AS active_processors,
    listener_port, protocol, target_type, row_number() OVER (PARTITION BY segment || (c_custkey % 10) ORDER BY source_id DESC) AS r
  FROM accounts LEFT JOIN w USING (source_id)),
health AS (SELECT source_name, queue_size, active_processors, listener_port, protocol, target_type FROM named WHERE r = 1)"""


@query("health_sources", HEALTH_SQL + " SELECT * FROM health")
def health_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = user_lines(spark, sf_dir)
    named = accounts(spark, sf_dir).withColumn(
        "source_name", F.concat("segment", (F.col("c_custkey") % 10).cast("string"))
    )
    return reports.health_sources(named, reports.backlog(lines, lines.where("seq % 3 = 0")))


@query(
    "heartbeat",
    HEALTH_SQL
    + """ SELECT CAST(n_nationkey AS BIGINT) AS time, CAST(n_nationkey * 2.5 AS DOUBLE) AS percent, CAST(75.0 * n_nationkey AS DOUBLE) AS second_load,
  (SELECT count(*) FROM health) AS sources, (SELECT sum(queue_size)::BIGINT FROM health) AS waiting, 'Heartbeat' AS source FROM nation""",
)
def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    host = table(spark, sf_dir, "nation").select(
        F.timestamp_seconds(key).alias("ts"),
        (key * 2.5).alias("cpu_percent"),
        F.lit(4).alias("cpu_count"),
        F.array(F.lit(1.0), key * 3.0).alias("load"),
        F.lit(1024).cast("bigint").alias("mem_total"),
        F.lit(512).cast("bigint").alias("mem_used"),
    )
    documents = reports.heartbeat(health_sources(spark, sf_dir), host)
    waiting = F.aggregate(
        F.map_values("event.sources"), F.lit(0).cast("bigint"), lambda total, s: total + s["queue_size"]
    )
    return documents.select(
        "time",
        F.col("event.cpu.percent").alias("percent"),
        F.col("event.cpu.load")[1].alias("second_load"),
        F.size("event.sources").cast("bigint").alias("sources"),
        waiting.alias("waiting"),
        "source",
    )


FIRST_DAY = 1_704_067_200


@query(
    "heartbeat_history",
    f"""WITH moments AS (SELECT {FIRST_DAY} + n_nationkey * 43200 AS sec, n_nationkey AS n FROM nation),
owners AS (SELECT DISTINCT 'u' || user_id AS source_id FROM events),
steps AS (SELECT 'u' || user_id AS source_id, epoch_us(ts) // 1000000 AS s, 1 AS n FROM events
  UNION ALL SELECT 'u' || user_id, epoch_us(ts) // 1000000 + 3600, -1 FROM events WHERE event_id % 3 = 0),
queues AS (SELECT o.source_id, m.sec, m.n, coalesce(sum(s.n), 0) AS waiting FROM owners o CROSS JOIN moments m
  LEFT JOIN steps s ON s.source_id = o.source_id AND s.s < m.sec GROUP BY 1, 2, 3)
SELECT CAST(sec AS BIGINT) AS time, CAST(n * 10 AS BIGINT) AS available, CAST(n / 2 AS DOUBLE) AS memory_percent, CAST(n * 7 AS BIGINT) AS free,
  CAST(n * 1000 AS BIGINT) AS bytes_recv, CAST(n * 3 AS BIGINT) AS packets_sent, CAST(4242 AS BIGINT) AS pid, CAST(n * 11 AS BIGINT) AS process_memory,
  count(*) AS sources, CAST(sum(waiting) AS BIGINT) AS waiting, CAST(max(waiting) AS BIGINT) AS longest FROM queues GROUP BY sec, n""",
)
def heartbeat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heartbeat with what waited at that moment; a third of the lines is delivered an hour after it came."""
    key = F.col("n_nationkey").cast("bigint")
    host = table(spark, sf_dir, "nation").select(
        F.timestamp_seconds(F.lit(FIRST_DAY) + key * 43_200).alias("ts"),
        F.lit(1.0).alias("cpu_percent"),
        F.lit(4).alias("cpu_count"),
        F.array(F.lit(1.0)).alias("load"),
        (key * 20).alias("mem_total"),
        (key * 10).alias("mem_available"),
        (key / 2).alias("mem_percent"),
        (key * 10).alias("mem_used"),
        *[(key * 7).alias(f"disk_{c}") for c in ("total", "used", "free")],
        F.lit(50.0).alias("disk_percent"),
        *[(key * n).alias(c) for c, n in (("bytes_sent", 1), ("bytes_recv", 1000), ("packets_sent", 3), ("packets_recv", 4))],
        F.lit(4242).cast("bigint").alias("pid"),
        (key * 11).alias("process_memory"),
    )
    lines = user_lines(spark, sf_dir)
    delivered = lines.where("seq % 3 = 0").withColumn("delivered_ts", F.col("recv_ts") + F.expr("INTERVAL 1 HOUR"))
    waiting = reports.backlog_at(lines, delivered, host.select(F.col("ts").alias("moment")))
    own = lines.select("source_id").distinct().select(
        "source_id",
        F.col("source_id").alias("source_name"),
        F.lit(514).alias("listener_port"),
        F.lit("UDP").alias("protocol"),
        F.lit("HEC").alias("target_type"),
    )
    documents = reports.heartbeat(reports.health_sources(own, waiting), host)
    queues = F.transform(F.map_values("event.sources"), lambda s: s["queue_size"])
    return documents.select(
        "time",
        F.col("event.memory.available").alias("available"),
        F.col("event.memory.percent").alias("memory_percent"),
        F.col("event.disk.free").alias("free"),
        F.col("event.network.bytes_recv").alias("bytes_recv"),
        F.col("event.network.packets_sent").alias("packets_sent"),
        F.col("event.pid").alias("pid"),
        F.col("event.process_memory").alias("process_memory"),
        F.size("event.sources").cast("bigint").alias("sources"),
        F.aggregate(queues, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("waiting"),
        F.array_max(queues).alias("longest"),
    )


@query(
    "tail_lines",
    """SELECT event_id AS ord, event_type AS line FROM events ORDER BY event_id DESC LIMIT 100""",
)
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("line"))
    return reports.tail(lines)


@query(
    "severity_tag",
    """WITH l AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'WARNING ' WHEN user_id % 3 = 1 THEN 'INFO ' ELSE '' END || upper(event_type) AS line FROM events)
SELECT CASE WHEN contains(line, 'ERROR') THEN 'ERROR' WHEN contains(line, 'WARNING') THEN 'WARNING'
  WHEN contains(line, 'INFO') THEN 'INFO' ELSE 'none' END AS tag, count(*) AS lines FROM l GROUP BY 1""",
)
def severity_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.when(F.col("user_id") % 3 == 0, "WARNING ").when(F.col("user_id") % 3 == 1, "INFO ").otherwise("")
    lines = table(spark, sf_dir, "events").select(F.concat(lead, F.upper("event_type")).alias("line"))
    return reports.severity_counts(lines)


@query(
    "format_bytes",
    """WITH v AS (SELECT l_orderkey AS k, l_linenumber AS line, CAST(l_partkey AS DOUBLE) ** (l_linenumber % 5 + 1) * l_quantity / 8 AS x FROM lineitem)
SELECT k, line, CASE WHEN x < 1024.0 THEN printf('%.2f B', x) WHEN x < 1048576.0 THEN printf('%.2f KB', x / 1024.0)
  WHEN x < 1073741824.0 THEN printf('%.2f MB', x / 1048576.0) WHEN x < 1099511627776.0 THEN printf('%.2f GB', x / 1073741824.0)
  WHEN x < 1125899906842624.0 THEN printf('%.2f TB', x / 1099511627776.0) ELSE printf('%.2f PB', x / 1125899906842624.0) END AS shown FROM v""",
)
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.pow(F.col("l_partkey").cast("double"), F.col("l_linenumber") % 5 + 1) * F.col("l_quantity").cast("double") / 8
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), display.format_bytes(amount).alias("shown")
    )


@query(
    "format_uptime",
    """WITH v AS (SELECT o_orderkey AS k, o_orderkey * 37 % 200000 AS s FROM orders)
SELECT k, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' ELSE '' END || CASE WHEN s >= 3600 THEN (s % 86400 // 3600) || 'h ' ELSE '' END
  || CASE WHEN s >= 60 THEN (s % 3600 // 60) || 'm ' ELSE '' END || (s % 60) || 's' AS shown FROM v""",
)
def format_uptime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), display.format_uptime(F.col("o_orderkey") * 37 % 200000).alias("shown")
    )


@query(
    "format_timestamp",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Never' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM events""",
)
def format_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", display.format_timestamp(ts).alias("shown"))


@query(
    "strip_ansi",
    """SELECT doc_id, md5(text) AS digest, length(text) AS width FROM documents""",
)
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every word is coloured, then the colours are taken out again.
    coloured = F.concat(F.lit("\x1b[1;31m"), F.replace("text", F.lit(" "), F.lit("\x1b[0m \x1b[32m")), F.lit("\x1bM"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(F.encode(display.strip_ansi(coloured), "UTF-8")).alias("digest"),
        display.content_width(coloured).cast("bigint").alias("width"),
    )


LOCKOUT_SQL = """WITH RECURSIVE attempts AS (
  SELECT 'u' || (user_id % 10) AS u, epoch_us(ts) // 60 AS us, event_id AS seq, event_type = 'signup' AS ok
  FROM events),
steps AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY us, seq) AS n FROM attempts),
fold(u, n, us, seq, outcome, c, lim) AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM attempts
  UNION ALL
  SELECT s.u, s.n, s.us, s.seq,
    CASE WHEN f.lim - s.us >= 1000000 THEN 'rejected' WHEN s.ok THEN 'success' WHEN f.c + 1 IN (2, 4) THEN 'warning' ELSE 'failure' END,
    CASE WHEN f.lim - s.us >= 1000000 THEN f.c WHEN s.ok THEN 0 ELSE f.c + 1 END,
    CASE WHEN f.lim - s.us >= 1000000 OR s.ok THEN f.lim WHEN f.c + 1 >= 5 THEN s.us + 600000000 WHEN f.c + 1 >= 3 THEN s.us + 300000000 ELSE f.lim END
  FROM fold f JOIN steps s ON s.u = f.u AND s.n = f.n + 1)
SELECT u AS "user", us, seq, outcome, c AS "count", CASE WHEN lim > us THEN lim END AS locked_until FROM fold WHERE n > 0"""


def login_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as login attempts, sixty times closer together so that locks overlap them."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        text("u", F.col("user_id") % 10).alias("user"),
        F.timestamp_micros(F.floor(us / 60)).alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "signup").alias("ok"),
    )


@query("lockout", LOCKOUT_SQL)
def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lockout.lockout(login_events(spark, sf_dir))
