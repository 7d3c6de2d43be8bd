"""Restartable ingest: the batch plan inside each micro-batch, and running aggregates."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from linefold.operators import batching, catalog, collapse
from linefold.operators.ordering import floor_div
from linefold.plans.flow import LogFlow
from linefold.session import spread
from linefold.sinks import store
from linefold.sources import messages


LOGS = "source_id STRING, recv_ts TIMESTAMP, seq BIGINT, raw STRING"
OPEN = "source_id STRING, untimed BOOLEAN, session0 BIGINT, chunk0 BIGINT, seen TIMESTAMP"


class Tails:
    """Lines of each source's last batch or minute, kept from one micro-batch to the next.

    A group of lines is delivered once a later line of its source has shown that it is complete, or, where the stream
    has a clock, once the source has been silent for the idle time of the flow: the table of open groups holds the
    clock's time at which each source last had a line. So a trigger's size changes nothing in the result. Lines
    without a time are a group of their own beside the timed ones, as in a batch run. Each epoch reads what the epoch
    before it left and writes its own, so a repeated epoch does the same again. The tail holds a batch (or a minute)
    per source at most; ``flush`` delivers it.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _left(self, spark: SparkSession, name: str, epoch: int, schema: str) -> DataFrame:
        if epoch < 0:
            return spark.createDataFrame([], schema)
        for place in (f"{self.folder}/{name}/settled={epoch}", f"{self.folder}/{name}/epoch={epoch}"):
            if store.complete(spark, place):
                return spark.read.schema(schema).parquet(place)
        raise RuntimeError(f"what epoch {epoch} left of {name} is missing")

    def _keep(self, rows: DataFrame, name: str, epoch: int, label: str = "epoch") -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{label}={epoch}")

    def clock_of(self, spark: SparkSession, epoch: int) -> datetime | None:
        """The clock's time as of an epoch; it never goes back."""
        return self._left(spark, "clock", epoch, "now TIMESTAMP").agg(F.max("now")).first()[0]

    def advance(
        self, flow: LogFlow, rows: DataFrame, epoch: int, time: Column | None, now: datetime | None = None, last: bool = False
    ) -> DataFrame:
        """Delivery lines of the groups that are complete by now; of all that is open, if nothing comes after."""
        if flow.scope == "all":
            raise ValueError("scope 'all' never completes a group in a stream")
        spark, before = rows.sparkSession, epoch if last else epoch - 1
        own = [f.split()[0] for f in LOGS.split(", ")]
        held = self._left(spark, "rows", before, LOGS)
        open_before = self._left(spark, "open", before, OPEN)
        both = rows.select(*own, F.lit(True).alias("_new")).unionByName(held.withColumn("_new", F.lit(False)))
        lines = flow.lines(both).withColumn("_untimed", F.col("recv_ts").isNull())
        if flow.scope == "batch":
            lines = self._renumbered(lines, open_before)
            group = F.struct("session", "chunk")
        else:
            group = F.struct(batching.minute_of(F.col("recv_ts")))
        # One evaluation for what is delivered and what stays.
        place = f"{self.folder}/lines/{'last' if last else 'epoch'}={epoch}"
        lines.withColumn("_group", group).write.mode("overwrite").parquet(place)
        lines = spark.read.parquet(place)
        if last:
            return flow.delivered(lines.drop("_group", "_new", "_untimed"), time)
        earlier = None if before < 0 else self.clock_of(spark, before)
        now = max(filter(None, (now, earlier)), default=None)
        state = self._state(flow, lines, open_before, now)
        marked = lines.join(state, ["source_id", "_untimed"])
        open_ = F.col("_group").eqNullSafe(F.col("_last")) & ~F.col("_due")
        self._keep(marked.where(open_).select(*own), "rows", epoch)
        self._keep(self._next(flow, state, open_before), "open", epoch)
        self._keep(spark.createDataFrame([(now,)], "now TIMESTAMP"), "clock", epoch)
        return flow.delivered(marked.where(~open_).drop("_group", "_last", "_due", "_seen", "_new", "_untimed"), time)

    @staticmethod
    def _state(flow: LogFlow, lines: DataFrame, open_before: DataFrame, now: datetime | None) -> DataFrame:
        """The last group of each source, when a line of it was last seen, and whether it has waited long enough."""
        clock = F.lit(now).cast("timestamp")
        last = lines.groupBy("source_id", "_untimed").agg(F.max("_group").alias("_last"), F.bool_or("_new").alias("_fresh"))
        seen_before = open_before.select("source_id", F.col("untimed").alias("_untimed"), "seen")
        seen = F.when(F.col("_fresh"), clock).otherwise(F.coalesce("seen", clock))
        silent = F.unix_micros(clock) - F.unix_micros(seen) >= flow.idle_seconds * 1_000_000
        return last.join(seen_before, ["source_id", "_untimed"], "left").select(
            "source_id", "_untimed", "_last", seen.alias("_seen"), F.coalesce(silent, F.lit(False)).alias("_due")
        )

    @staticmethod
    def _next(flow: LogFlow, state: DataFrame, open_before: DataFrame) -> DataFrame:
        """What is open after an epoch. A group closed by the clock is followed by a new session."""
        numbers = [F.lit(None).cast("bigint").alias(c) for c in ("session0", "chunk0")]
        if flow.scope == "batch":
            session, chunk, due = F.col("_last.session"), F.col("_last.chunk"), F.col("_due")
            closed = F.when(F.col("_untimed"), session).otherwise(session + 1)
            first = F.when(F.col("_untimed"), chunk + 1).otherwise(0)
            numbers = [F.when(due, closed).otherwise(session).alias("session0"), F.when(due, first).otherwise(chunk).cast("bigint").alias("chunk0")]
        now_open = state.select("source_id", F.col("_untimed").alias("untimed"), *numbers, F.col("_seen").alias("seen"))
        # Sources without an open line and without a new one keep their numbers.
        return now_open.unionByName(open_before.join(now_open, ["source_id", "untimed"], "left_anti").select(*now_open.columns))

    @staticmethod
    def _renumbered(lines: DataFrame, open_before: DataFrame) -> DataFrame:
        """Numbers that go on from what is open: held lines come first, so the first session is the open one."""
        names = lines.columns
        numbers = open_before.select("source_id", F.col("untimed").alias("_untimed"), "session0", "chunk0")
        first = (F.col("session") == 0) | F.col("_untimed")
        chunk = F.col("chunk") + F.when(first, F.coalesce("chunk0", F.lit(0))).otherwise(0)
        session = F.col("session") + F.when(F.col("_untimed"), 0).otherwise(F.coalesce("session0", F.lit(0)))
        moved = lines.join(numbers, ["source_id", "_untimed"], "left")
        return moved.withColumns({"chunk": chunk, "session": session}).select(*names)

    def flush(self, spark: SparkSession, flow: LogFlow, epoch: int, time: Column | None = None) -> DataFrame:
        """Delivery lines of everything that the epoch left open. ``settled`` ends it."""
        return self.advance(flow, spark.createDataFrame([], LOGS), epoch, time, last=True)

    def settled(self, spark: SparkSession, flow: LogFlow, epoch: int) -> None:
        """Nothing is open any more; sources go on with a new session."""
        left = self._left(spark, "open", epoch, OPEN)
        if flow.scope == "batch":
            untimed = F.col("untimed")
            session = F.when(untimed, F.col("session0")).otherwise(F.col("session0") + 1)
            chunk = F.when(untimed, F.col("chunk0") + 1).otherwise(0).cast("bigint")
            left = left.select("source_id", "untimed", session.alias("session0"), chunk.alias("chunk0"), "seen")
        self._keep(left, "open", epoch, "settled")
        self._keep(spark.createDataFrame([], LOGS), "rows", epoch, "settled")

    def is_settled(self, spark: SparkSession, epoch: int) -> bool:
        return store.complete(spark, f"{self.folder}/rows/settled={epoch}")


REST = (
    "conn_id STRING, seq BIGINT, payload BINARY, recv_ts TIMESTAMP, transport STRING, port INT, source_ip STRING, "
    "_offset BIGINT, base BIGINT"
)


class Framing:
    """TCP lines over micro-batches: the unfinished line of each connection waits in a table.

    Chunks of one connection must arrive in order of ``seq`` from trigger to trigger; inside a trigger any order is
    fine. One row per open connection stays, with the unfinished part of its line, where its last chunk came from and
    the number of lines before. A line ends by a line feed, a chunk that closes the connection, a silence between two
    chunks or, where the stream has a clock, one that lasts. Lines are those of ``messages.frame_lines`` over all
    chunks; chunks without the columns of their origin are framed alike.
    """

    def __init__(self, folder: str, idle_seconds: int = messages.IDLE_SECONDS, most_bytes: int = messages.MOST_BYTES):
        self.folder, self.idle_seconds, self.most_bytes = folder.rstrip("/"), idle_seconds, most_bytes

    def _left(self, spark: SparkSession, epoch: int) -> DataFrame:
        if epoch < 0:
            return spark.createDataFrame([], REST)
        return spark.read.schema(REST).parquet(f"{self.folder}/epoch={epoch}")

    def advance(self, chunks: DataFrame, epoch: int, now: datetime | None = None) -> DataFrame:
        """``conn_id, line_no, part, ..., payload`` of the lines that are over by this epoch."""
        spark = chunks.sparkSession
        held = self._left(spark, epoch - 1)
        own = [f.split()[0] for f in REST.split(", ")][:7]
        absent = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in REST.split(", ")[:7] if f.split()[0] not in chunks.columns}
        both = chunks.withColumns(absent).select(*own, F.lit(0).cast("bigint").alias("_offset"))
        both = both.unionByName(held.drop("base"))
        framed = dict(ts="recv_ts", idle_seconds=self.idle_seconds)
        counted = messages.count_ends(both, "conn_id", "seq", "payload", **framed, block_rows=65_536)
        ends = counted.blocks.groupBy("conn_id").agg(F.sum("_own").cast("bigint").alias("_ends"))
        last = both.groupBy("conn_id").agg(F.max_by(F.struct(*[c for c in own if c != "payload"], F.col("payload").isNull().alias("closed")), "seq").alias("_last"))
        state = ends.join(last, "conn_id").join(held.select("conn_id", "base"), "conn_id", "left")
        state = state.withColumn("base", F.coalesce("base", F.lit(0)))
        lines = messages.frame_lines(both, **framed, keep=messages.ORIGIN, most_bytes=self.most_bytes)
        newest = F.max("part").over(Window.partitionBy("conn_id", "line_no"))
        # One evaluation for what is over and what stays.
        place = f"{self.folder}-lines/epoch={epoch}"
        lines.withColumn("_newest", newest).join(state, "conn_id").write.mode("overwrite").parquet(place)
        lines = spark.read.parquet(place)
        unfinished = (F.col("line_no") == F.col("_ends")) & (F.col("part") == F.col("_newest"))
        silent = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("_last.recv_ts") >= self.idle_seconds * 1_000_000
        due = F.coalesce(silent, F.lit(False))
        over = ~unfinished | due
        rest = lines.where(unfinished & ~due).select("conn_id", "payload", (F.col("part") * self.most_bytes).alias("_offset"))
        kept = state.where(~F.col("_last.closed")).join(rest, "conn_id", "left")
        kept = kept.select(
            "conn_id",
            F.col("_last.seq").alias("seq"),
            F.coalesce("payload", F.lit(b"")).alias("payload"),
            # A line that the clock has ended can't be ended by the same silence again.
            F.when(~due, F.col("_last.recv_ts")).alias("recv_ts"),
            *[F.col(f"_last.{c}").alias(c) for c in messages.ORIGIN[1:]],
            F.coalesce("_offset", F.lit(0)).cast("bigint").alias("_offset"),
            (F.col("base") + F.col("_ends") + due.cast("int")).alias("base"),
        )
        kept.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")
        number = (F.col("base") + F.col("line_no")).alias("line_no")
        return lines.where(over).select("conn_id", number, "part", "last_seq", "place", *messages.ORIGIN, "payload")

    def flush(self, spark: SparkSession, epoch: int) -> DataFrame:
        """The unfinished lines, for the end of the connections."""
        rest = self._left(spark, epoch).where(F.length("payload") > 0)
        part = floor_div(F.col("_offset"), self.most_bytes).alias("part")
        place = F.lit(messages.UNENDED).alias("place")
        return rest.select("conn_id", F.col("base").alias("line_no"), part, F.col("seq").alias("last_seq"), place, *messages.ORIGIN, "payload")


def clock(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of ``tick TIMESTAMP`` that goes on while nothing else comes."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(F.col("timestamp").alias("tick"))


def start(
    logs: DataFrame,
    make_flow: Callable[[SparkSession], LogFlow],
    deliver: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    time: Column | None = None,
    ticks: DataFrame | None = None,
) -> StreamingQuery:
    """Run a flow on every micro-batch and hand the delivery lines to ``deliver``.

    ``make_flow`` is asked at each micro-batch, so changed registries take effect with the next one. Batches stay open
    across micro-batches in tables beside the checkpoint; what was read is delivered or kept there before the offset
    moves. With ``ticks``, a stream of times such as ``clock`` gives, a batch is also delivered once its source has
    had no line for the idle time, though no later line comes; the ticks are part of the offsets, so a repeated
    epoch sees the same time. ``availableNow`` drains what is there and stops; ``flush`` then delivers what is open.
    """
    tails = Tails(f"{checkpoint}-tails")
    own = [f.split()[0] for f in LOGS.split(", ")]
    rows = logs.select(*own)
    if ticks is not None:
        empty = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in LOGS.split(", ")]
        rows = rows.withColumn("_tick", F.lit(None).cast("timestamp")).unionByName(ticks.select(*empty, F.col("tick").alias("_tick")))

    def each(rows: DataFrame, epoch: int) -> None:
        now = None
        if ticks is not None:
            now = rows.agg(F.max("_tick")).first()[0]
            rows = rows.where("_tick is null").drop("_tick")
        # What lands in a trigger is often a part of a time range, in few and uneven files.
        deliver(tails.advance(make_flow(rows.sparkSession), spread(rows), epoch, time, now), epoch)

    return _begin(rows.writeStream.foreachBatch(each), checkpoint, trigger)


def flush(
    query: StreamingQuery,
    spark: SparkSession,
    make_flow: Callable[[SparkSession], LogFlow],
    deliver: Callable[[DataFrame, int], None],
    checkpoint: str,
    time: Column | None = None,
) -> None:
    """Deliver what an ended query left open, as an epoch of negative number."""
    if query.lastProgress is None:
        return
    epoch, tails = query.lastProgress["batchId"], Tails(f"{checkpoint}-tails")
    if tails.is_settled(spark, epoch):
        return
    flow = make_flow(spark)
    deliver(tails.flush(spark, flow, epoch, time), -1 - epoch)
    tails.settled(spark, flow, epoch)


class Receiver:
    """Raw messages of both transports to delivery lines: framing, attribution, batches."""

    def __init__(self, checkpoint: str, most_bytes: int = messages.MOST_BYTES):
        self.framing = Framing(f"{checkpoint}-rests", most_bytes=most_bytes)
        self.tails = Tails(f"{checkpoint}-tails")

    def advance(self, flow: LogFlow, raw: DataFrame, epoch: int, time: Column | None, now: datetime | None = None) -> DataFrame:
        framed = self.framing.advance(raw.where(F.col("transport") == "TCP"), epoch, now)
        lines = messages.datagram_arrivals(raw).unionByName(messages.framed_arrivals(framed))
        return self.tails.advance(flow, flow.attribute(lines), epoch, time, now)

    def flush(self, spark: SparkSession, flow: LogFlow, epoch: int, time: Column | None = None) -> DataFrame:
        """Delivery lines of unfinished lines and open batches; nothing may come after."""
        rest = messages.framed_arrivals(self.framing.flush(spark, epoch))
        return self.tails.advance(flow, flow.attribute(rest), epoch, time, last=True)


def receive(
    raw: DataFrame,
    make_flow: Callable[[SparkSession], LogFlow],
    deliver: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    time: Column | None = None,
    ticks: DataFrame | None = None,
) -> StreamingQuery:
    """As ``start``, from a stream of raw messages (``messages.RAW_SCHEMA``); ticks also end silent TCP lines."""
    receiver = Receiver(checkpoint)
    names = {f.split()[0]: f.split()[1] for f in messages.RAW_SCHEMA.split(", ")}
    rows = raw.select(*names)
    if ticks is not None:
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in names.items()]
        rows = rows.withColumn("_tick", F.lit(None).cast("timestamp")).unionByName(ticks.select(*empty, F.col("tick").alias("_tick")))

    def each(rows: DataFrame, epoch: int) -> None:
        now = None
        if ticks is not None:
            now = rows.agg(F.max("_tick")).first()[0]
            rows = rows.where("_tick is null").drop("_tick")
        deliver(receiver.advance(make_flow(rows.sparkSession), rows, epoch, time, now), epoch)

    return _begin(rows.writeStream.foreachBatch(each), checkpoint, trigger)


def _begin(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    options = trigger or {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**options).start()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """Delivery lines as a Parquet table, one part per epoch."""

    def deliver(lines: DataFrame, epoch: int) -> None:
        lines.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return deliver


def learn_templates(
    logs: DataFrame, path: str, checkpoint: str, mode: str = "compat", trigger: dict | None = None
) -> StreamingQuery:
    """Templates of sources seen for the first time, appended to a table."""

    def each(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        target = f"{path}/epoch={epoch}"
        known = known_templates(spark, path, before=epoch)
        found = catalog.learn_templates(rows, mode) if known is None else catalog.new_templates(rows, known, mode)
        found.write.mode("overwrite").parquet(target)

    return _begin(logs.writeStream.foreachBatch(each), checkpoint, trigger)


def known_templates(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Learned templates, or null while there are none."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        # No folder yet, or one without a file; any other error is one.
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return table if before is None else table.where(F.col("epoch") < before)


def running_counts(lines: DataFrame) -> DataFrame:
    """Lines and last time per source, for update mode."""
    return lines.groupBy("source_id").agg(
        F.count("*").alias("processed"), F.max("recv_ts").alias("last_processed")
    )


def collapse_windows(
    keyed: DataFrame, width: str = "1 minute", delay: str = "10 minutes", ts: str = "recv_ts"
) -> DataFrame:
    """Event-time collapse: one row per source, window and key once the watermark passes.

    ``keyed`` comes from ``with_collapse_key``; a row without a key passes at once.
    """
    us = F.unix_micros(F.col(ts))
    grouped = (
        keyed.where(F.col("agg_key").isNotNull())
        .withWatermark(ts, delay)
        .groupBy("source_id", F.window(ts, width), "agg_key")
        .agg(
            F.count("*").alias("n"),
            F.min_by("raw", F.struct(us, F.col("seq"))).alias("raw"),
            F.min(us).alias("first_us"),
            F.max(us).alias("last_us"),
        )
    ).select(
        "source_id",
        F.col("window.start").alias("window_start"),
        "n",
        collapse.render("raw", F.col("n"), F.col("first_us"), F.col("last_us")).alias("raw"),
    )
    alone = keyed.where(F.col("agg_key").isNull()).select(
        "source_id", F.window(ts, width).start.alias("window_start"), F.lit(1).cast("bigint").alias("n"), "raw"
    )
    return grouped.unionByName(alone)
