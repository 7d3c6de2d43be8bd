"""Streaming forms over the same tables, and the sinks, read back."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_queries.base import (
    AGG_KEY_SQL,
    LINES_SQL,
    MESSAGES_SQL,
    SOURCES_SQL,
    batches_sql,
    json_line,
    logs,
    messages,
    policies,
    query,
    sources,
    table,
    text,
)
from entry_queries.lines import FLOW_SQL, flow, flow_sql
from entry_queries.reporting import LOCKOUT_SQL
from linefold.operators import collapse
from linefold.plans import dispatch
from linefold.plans.flow import LogFlow, split_targets
from linefold.session import scratch
from linefold.sinks import batch_files, folder, hec, store
from linefold.sinks.ledger import Ledger
from linefold.sources.messages import arrivals
from linefold.streaming import ingest, state


def in_ranges(rows: DataFrame, order: Column, parts: int = 3) -> list[DataFrame]:
    """Rows in ``parts`` ranges of a number; the cut points are percentiles, so no task sees all rows."""
    shares = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx(order, shares)).first()[0] or []
    edges = [None, *cuts, None]
    ranges = []
    for low, high in zip(edges, edges[1:]):
        above = F.lit(True) if low is None else F.coalesce(order >= low, F.lit(False))
        below = F.lit(True) if high is None else F.coalesce(order < high, F.lit(low is None))
        ranges.append(rows.where(above & below))
    return ranges


def landing(rows: DataFrame, path: str) -> DataFrame:
    """The files under ``path/in`` as a stream of rows of this kind."""
    return rows.sparkSession.readStream.schema(rows.schema).parquet(f"{path}/in")


def run_flow(spark: SparkSession, rows: DataFrame, make_flow, path: str, order: Column | None = None) -> DataFrame:
    """A flow over lines that land in three parts, one trigger each; open tails are delivered at the end."""
    deliver, place = ingest.to_table(f"{path}/out"), f"{path}/checkpoint"
    for part in in_ranges(rows, F.unix_micros("recv_ts") if order is None else order):
        part.write.mode("append").parquet(f"{path}/in")
        running = ingest.start(landing(rows, path), make_flow, deliver, place, time=F.lit(0))
        running.awaitTermination()
    ingest.flush(running, spark, make_flow, deliver, place, time=F.lit(0))
    return spark.read.parquet(f"{path}/out")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events").select(
        text("src", F.col("user_id") % 5).alias("source_id"),
        F.col("ts").cast("timestamp").alias("recv_ts"),
        F.col("event_id").alias("seq"),
        json_line().alias("raw"),
    )


def drain(rows: DataFrame, path: str, timers: bool = False) -> DataFrame:
    """Run a stream over what is there into a table and read the table.

    Operators with processing-time timers always ask for another batch, so a run with them
    takes a single batch instead of going on until nothing is left to do.
    """
    spark = rows.sparkSession
    running = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{path}/checkpoint")
        .option("path", f"{path}/out")
        .trigger(**({"once": True} if timers else {"availableNow": True}))
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("stream_deliver_lines", FLOW_SQL)
def stream_deliver_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow in three triggers: batches stay open between them."""
    path = scratch(spark)
    out = run_flow(spark, logs(spark, sf_dir), lambda session: flow(session, sf_dir), path)
    return out.select("source_id", "session", "chunk", "slot", "n", "target_type", "line")


@query(
    "stream_batches",
    f"""WITH {LINES_SQL}, {batches_sql("lines", "3", 1_800_000_000)}
SELECT source_id, seq, session, chunk, place FROM batched""",
)
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of three, each line on its own, in three triggers."""
    path = scratch(spark)
    small = sources(spark, sf_dir).withColumn("batch_size", F.lit(3).cast("bigint"))
    out = run_flow(spark, logs(spark, sf_dir), lambda session: LogFlow(small, idle_seconds=1800), path)
    return out.select(
        "source_id",
        F.get_json_object("line", "$.event.event_id").cast("bigint").alias("seq"),
        "session",
        "chunk",
        F.col("slot").alias("place"),
    )


@query(
    "stream_frame_lines",
    """WITH whole AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1),
pieces AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line,
  CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM whole)
SELECT CAST(conv_id AS VARCHAR) AS conn_id, line_no, md5(line) AS digest FROM pieces WHERE length(line) > 0""",
)
def stream_frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of connections whose chunks come in three triggers; the end gives up unfinished lines."""
    path = scratch(spark)
    chunks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conn_id"), F.col("turn").alias("seq"), F.encode("text", "UTF-8").alias("payload")
    )
    framing, deliver = ingest.Framing(f"{path}/rest"), ingest.to_table(f"{path}/out")
    for part in in_ranges(chunks, F.col("seq")):
        part.write.mode("append").parquet(f"{path}/in")
        running = (
            landing(chunks, path)
            .writeStream.foreachBatch(lambda rows, epoch: deliver(framing.advance(rows, epoch), epoch))
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    last = running.lastProgress["batchId"]
    deliver(framing.flush(spark, last), -1 - last)
    return spark.read.parquet(f"{path}/out").select("conn_id", "line_no", F.md5("payload").alias("digest"))


@query("stream_lockout", LOCKOUT_SQL)
def stream_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    attempts = (
        stream(spark, sf_dir, "events")
        .select(
            text("u", F.col("user_id") % 10).alias("user"),
            F.timestamp_micros(F.floor(us / 60)).alias("ts"),
            F.col("event_id").alias("seq"),
            (F.col("event_type") == "signup").alias("ok"),
        )
    )
    return drain(state.live_lockout(attempts), scratch(spark))


@query(
    "stream_templates",
    f"""WITH {LINES_SQL} SELECT source_id, arg_min(raw, (us, seq)) AS raw, CAST(4 AS BIGINT) AS fields FROM lines GROUP BY 1""",
)
def stream_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    ingest.learn_templates(stream_logs(spark, sf_dir), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return ingest.known_templates(spark, f"{path}/out").select(
        "source_id", "raw", F.size("fields").cast("bigint").alias("fields")
    )


@query(
    "stream_counts",
    f"""WITH {LINES_SQL} SELECT source_id, count(*) AS processed, max(us) AS last_us FROM lines GROUP BY 1""",
)
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    counts = ingest.running_counts(stream_logs(spark, sf_dir))
    running = (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}"))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    updates = spark.read.parquet(f"{path}/out")
    return updates.groupBy("source_id").agg(
        F.max("processed").alias("processed"), F.unix_micros(F.max("last_processed")).alias("last_us")
    )


@query(
    "stream_windows",
    f"""WITH {LINES_SQL}, keyed AS (SELECT *, {AGG_KEY_SQL} AS k, us // 3600000000 AS h FROM lines),
g AS (SELECT source_id, h, k IS NULL AS alone, coalesce(k, 'row' || seq), count(*) AS n FROM keyed GROUP BY 1, 2, 3, 4)
SELECT source_id, h * 3600 AS window_start, n FROM g WHERE alone OR (h + 1) * 3600000000 <= (SELECT max(us) // 1000 * 1000 - 600000000 FROM keyed WHERE k IS NOT NULL)""",
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly collapse in event time; windows behind the watermark."""
    keyed = collapse.with_collapse_key(stream_logs(spark, sf_dir), policies(spark))
    out = drain(ingest.collapse_windows(keyed, "1 hour"), scratch(spark))
    return out.select("source_id", F.unix_timestamp("window_start").alias("window_start"), "n")


# A day without lines ends a batch here, so a source has few files.
DAY_FLOW_SQL = flow_sql(40, 86_400_000_000)


@query(
    "folder_lines",
    f"""SELECT source_id, session, chunk, line FROM ({DAY_FLOW_SQL}) WHERE target_type = 'FOLDER'""",
)
def folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered files, one per batch, read back."""
    path = scratch(spark)
    day_flow = flow(spark, sf_dir, size=40, idle_seconds=86_400)
    lines, _ = split_targets(day_flow.run(logs(spark, sf_dir), F.lit(0)))
    folder.write_lines(lines, f"{path}/out")
    return folder.read_lines(spark, f"{path}/out").select(
        "source_id",
        F.col("session").cast("bigint").alias("session"),
        F.col("chunk").cast("bigint").alias("chunk"),
        F.col("value").alias("line"),
    )


def settled_sources(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The sources with settings for delivery; they differ by source, some are left to the defaults."""
    number = F.substring("source_id", 4, 1).cast("int")
    return sources(spark, sf_dir).select(
        "*",
        text(f"{path}/files/", F.col("source_id")).alias("folder_path"),
        F.when(number == 2, F.lit(False)).alias("compression_enabled"),
        F.when(number == 0, F.lit(3)).alias("compression_level"),
        F.lit(f"{path}/requests").alias("hec_url"),
        text("token-", F.col("source_id")).alias("hec_token"),
    )


@query(
    "folder_manifest",
    f"""SELECT source_id, session, chunk, count(*) AS count, source_id <> 'src2' AS compressed,
  CASE source_id WHEN 'src0' THEN 3 WHEN 'src4' THEN 9 END AS compression_level,
  source_id || '-' || session || '-' || chunk || '.json' || CASE WHEN source_id <> 'src2' THEN '.gz' ELSE '' END AS name
FROM ({DAY_FLOW_SQL}) WHERE target_type = 'FOLDER' GROUP BY 1, 2, 3""",
)
def folder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per batch file, from the tasks that wrote them."""
    path = scratch(spark)
    lines = flow(spark, sf_dir, size=40, idle_seconds=86_400).run(logs(spark, sf_dir), F.lit(0))
    batch_files.deliver(lines, settled_sources(spark, sf_dir, path), f"{path}/manifest", "2024-01-01-00-00-00", epoch=1)
    entries = batch_files.read_manifest(spark, f"{path}/manifest")
    name = F.regexp_extract("filename", "/2024-01-01-00-00-00-1-([^/]*)$", 1).alias("name")
    return entries.select("source_id", "session", "chunk", "count", "compressed", "compression_level", name)


@query(
    "dispatch_targets",
    f"""SELECT target_type, source_id, session, chunk, count(*) AS events,
  md5(string_agg(line, chr(10) ORDER BY slot) || CASE target_type WHEN 'FOLDER' THEN chr(10) ELSE '' END) AS digest
FROM ({DAY_FLOW_SQL}) GROUP BY 1, 2, 3, 4""",
)
def dispatch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both targets from one evaluation; what lies in files and in request bodies, with manifest and ledger."""
    path = scratch(spark)
    lines = flow(spark, sf_dir, size=40, idle_seconds=86_400).run(logs(spark, sf_dir), F.lit(0))
    make = functools.partial(settled_sources, sf_dir=sf_dir, path=path)
    send = dispatch.to_targets(f"{path}/out", lambda session: make(session), "stamp", poster="linefold.sinks.hec:drop")
    for _ in range(2):  # the second run finds all targets through
        send(lines, 0)
    entries = batch_files.read_manifest(spark, f"{path}/out/manifest")
    named = entries.select("source_id", "session", "chunk", F.col("count").alias("events"), "filename")
    filed = store.with_text(named, "filename").withColumn("target_type", F.lit("FOLDER"))
    posts = hec.batch_bodies(send.held(lines, 0).where("target_type = 'HEC'"), make(spark))
    named = posts.select("request_id", F.concat_ws("/", "hec_url", F.sha2(F.encode("body", "UTF-8"), 256)).alias("filename"))
    bodies = store.with_text(named, "filename")
    posted = Ledger(f"{path}/out/ledger").sent(spark).join(bodies, "request_id").withColumn("target_type", F.lit("HEC"))
    names = ["target_type", "source_id", "session", "chunk", "events", "value"]
    both = filed.select(*names).unionByName(posted.select(*names))
    return both.select(*names[:-1], F.md5(F.encode("value", "UTF-8")).alias("digest"))


@query("stream_silent_sources", FLOW_SQL)
def stream_silent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No line comes behind the last ones of each source; a clock in the stream delivers their batches."""
    path = scratch(spark)
    rows = logs(spark, sf_dir)
    deliver = ingest.to_table(f"{path}/out")
    ticks = spark.createDataFrame([(k, 0) for k in range(4)], "minute long, none long")
    tick = F.timestamp_seconds(F.lit(1_800_000_000) + F.when(F.col("minute") == 3, 90).otherwise(10 * F.col("minute"))).alias("tick")
    empty = spark.createDataFrame([], rows.schema)
    for minute, part in enumerate([*in_ranges(rows, F.unix_micros("recv_ts")), empty]):
        part.write.mode("append").parquet(f"{path}/in")
        ticks.where(F.col("minute") == minute).select(tick).coalesce(1).write.mode("append").parquet(f"{path}/ticks")
        ingest.start(
            landing(rows, path),
            lambda session: flow(session, sf_dir),
            deliver,
            f"{path}/checkpoint",
            time=F.lit(0),
            ticks=spark.readStream.schema("tick timestamp").parquet(f"{path}/ticks"),
        ).awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select("source_id", "session", "chunk", "slot", "n", "target_type", "line")


RECEIVED_SQL = f"""WITH {LINES_SQL}, {SOURCES_SQL}, {MESSAGES_SQL}, heard AS (
  SELECT s.source_id, s.source_name, l.us, l.seq, l.raw FROM messages m JOIN lines l USING (seq)
  JOIN sources s ON s.source_ip = m.source_ip AND s.listener_port = m.port
  WHERE EXISTS (SELECT 1 FROM sources o WHERE o.listener_port = m.port AND o.protocol = m.transport)),
{batches_sql("heard", "7", 60_000_000)}
SELECT source_id, session, chunk, place AS slot, '{{"time": 0, "event": ' || raw || ', "source": "' || source_name || '"}}' AS line
FROM batched"""


def sent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as datagrams and as chunks of TCP connections, each ended by a line feed."""
    ended = F.when(F.col("transport") == "TCP", F.concat("payload", F.lit(b"\n"))).otherwise(F.col("payload"))
    return messages(spark, sf_dir).withColumn("payload", ended)


@query("receive_lines", RECEIVED_SQL)
def receive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages of both transports to delivery lines."""
    taking = LogFlow(sources(spark, sf_dir))
    lines = taking.attribute(arrivals(sent_messages(spark, sf_dir)))
    return taking.run(lines, F.lit(0)).select("source_id", "session", "chunk", "slot", "line")


@query("stream_receive_lines", RECEIVED_SQL)
def stream_receive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in three triggers; unfinished lines and open batches wait between them."""
    path = scratch(spark)
    raw, deliver, place = sent_messages(spark, sf_dir), ingest.to_table(f"{path}/out"), f"{path}/checkpoint"
    taking = LogFlow(sources(spark, sf_dir))
    for part in in_ranges(raw, F.unix_micros("recv_ts")):
        part.write.mode("append").parquet(f"{path}/in")
        running = ingest.receive(landing(raw, path), lambda session: taking, deliver, place, time=F.lit(0))
        running.awaitTermination()
    last = running.lastProgress["batchId"]
    deliver(ingest.Receiver(place).flush(spark, taking, last, F.lit(0)), -1 - last)
    return spark.read.parquet(f"{path}/out").select("source_id", "session", "chunk", "slot", "line")
