"""Landed raw messages: datagrams and TCP chunks to decoded lines."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linefold.operators.ordering import floor_div, micros

RAW_SCHEMA = (
    "recv_ts TIMESTAMP, transport STRING, port INT, source_ip STRING, "
    "conn_id STRING, seq LONG, payload BINARY"
)
# Fixed value: a connection without data for this long is closed.
IDLE_SECONDS = 30
# Fixed value: more than the bytes of the largest message, so than the places of its line feeds.
UNENDED = 65_536
#: Longer lines come in parts of about this size.
MOST_BYTES = 1 << 20


def stream_messages(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Landed messages as a stream; ``maxFilesPerTrigger`` and the like go into ``options``."""
    return spark.readStream.format(format).options(**options).schema(RAW_SCHEMA).load(path)


def decode(payload: Column) -> Column:
    """UTF-8, or the whole message as Latin-1 if it is not valid UTF-8."""
    text = payload.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(payload, "ISO-8859-1"))


def datagrams(raw: DataFrame) -> DataFrame:
    """UDP messages: one datagram is one line, line breaks and blanks included."""
    return (
        raw.where(F.col("transport") == "UDP")
        .withColumn("raw", decode(F.col("payload")))
        .drop("payload", "conn_id")
    )


class Counted(NamedTuple):
    """Chunks with the number of line ends before them, and the line ends of each block of chunks."""

    rows: DataFrame
    blocks: DataFrame


def count_ends(
    chunks: DataFrame, conn: str, seq: str, payload: str, ts: str | None, idle_seconds: int, block_rows: int
) -> Counted:
    """Ends of lines by connection: line feeds, silences and closings, carried over blocks of ``seq``."""
    # Latin-1 maps bytes to characters one to one, so text functions work on bytes.
    text = F.decode(F.coalesce(F.col(payload), F.lit(b"")), "ISO-8859-1")
    us = micros(F.col(ts)) if ts else F.lit(0).cast("bigint")
    rows = chunks.select("*", text.alias("_text"), us.alias("_us"), floor_div(F.col(seq), block_rows).alias("_block"))
    rows = rows.withColumn("_breaks", F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))))
    idle_us = idle_seconds * 1_000_000
    inside = Window.partitionBy(conn, "_block").orderBy(seq)
    silent = F.coalesce(F.col("_us") - F.lag("_us").over(inside) >= idle_us, F.lit(False)) | F.col(payload).isNull()
    rows = rows.withColumn("_silent", silent).withColumn("_first", F.row_number().over(inside) == 1)
    rows = rows.withColumn("_ends", F.col("_breaks") + F.col("_silent").cast("int"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_inner", F.sum("_ends").over(upto) - F.col("_breaks"))
    blocks = rows.groupBy(conn, "_block").agg(
        F.sum("_ends").alias("_ends"),
        F.min_by("_us", seq).alias("_first_us"),
        F.max_by("_us", seq).alias("_last_us"),
        F.min_by(F.col(payload).isNull(), seq).alias("_closed_first"),
    )
    by_block = Window.partitionBy(conn).orderBy("_block")
    silent_start = F.coalesce(F.col("_first_us") - F.lag("_last_us").over(by_block) >= idle_us, F.lit(False))
    # A closing ends the line already.
    starts = (silent_start & ~F.col("_closed_first")).cast("int")
    blocks = blocks.select(
        conn, "_block", (starts == 1).alias("_starts"), (F.col("_ends") + starts).alias("_own"), F.col("_ends").alias("_inside")
    )
    total = F.sum("_own").over(by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return Counted(rows, blocks.select(conn, "_block", "_starts", "_own", (total - F.col("_inside")).alias("_earlier")))


def frame_lines(
    chunks: DataFrame,
    conn: str = "conn_id",
    seq: str = "seq",
    payload: str = "payload",
    ts: str | None = None,
    idle_seconds: int = IDLE_SECONDS,
    block_rows: int = 65_536,
    keep: Sequence[str] = (),
    most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Lines of TCP connections from their byte chunks.

    Returns ``conn, line_no, part, first_seq, last_seq, place, payload`` with empty lines
    dropped; ``line_no`` counts lines, empty ones included, from 0. ``last_seq`` is the chunk
    that ends the line and ``place`` its line feed there, from 1, or 0 where the chunk ends
    it by coming after a silence or by closing; a line that nothing ends has its last chunk
    and ``UNENDED``. The columns ``keep`` are those of this chunk.

    Chunks are cut at line feeds on their own. Only the pieces of one line are brought
    together, never a whole connection: the number of line ends before a chunk, carried over
    blocks of ``seq``, tells which line its first piece continues. With ``ts``, a silence of
    ``idle_seconds`` ends a line as well. A chunk without a payload says that the connection
    is closed, which ends its line. A line of more than ``most_bytes`` comes in parts, each
    with the pieces that start in one such stretch, so that no line is held as a whole. A
    column ``_offset`` tells how many bytes of its line came before a chunk's first piece.
    """
    counted = count_ends(chunks, conn, seq, payload, ts, idle_seconds, block_rows)
    offset = F.col("_offset") if "_offset" in chunks.columns else F.lit(0).cast("bigint")
    meta = F.struct(F.col(seq).alias("_seq"), F.lit(UNENDED).alias("_place"), *keep)
    ends_before = F.col("_silent") | (F.col("_first") & F.col("_starts"))
    of_chunk = F.split("_text", "\n", -1)
    pieces = counted.rows.join(counted.blocks, [conn, "_block"]).select(
        F.col(conn),
        F.col(seq),
        (F.col("_earlier") + F.col("_inner")).cast("bigint").alias("_line"),
        meta.alias("_meta"),
        offset.alias("_offset"),
        # A chunk that ends the line before it starts with an empty piece of that line.
        F.posexplode(F.when(ends_before, F.array_prepend(of_chunk, "")).otherwise(of_chunk)).alias("_pos", "_piece"),
        ends_before.cast("int").alias("_shift"),
        "_breaks",
    ).withColumn("_at", F.col("_pos") - F.col("_shift"))
    ended = F.col("_at") < F.col("_breaks")
    pieces = pieces.where((F.length("_piece") > 0) | ended).select(
        conn,
        seq,
        (F.col("_line") + F.col("_at")).alias("line_no"),
        F.when(ended, F.col("_meta").withField("_place", F.col("_at") + 1)).otherwise(F.col("_meta")).alias("_meta"),
        F.when(F.col("_at") == 0, F.col("_offset")).otherwise(0).alias("_offset"),
        "_piece",
        ((F.col("_at") > 0) & ended).alias("_whole"),
    )
    # Pieces strictly inside a chunk are whole lines and need no grouping.
    inner = pieces.where(F.col("_whole") & (F.length("_piece") > 0)).select(
        conn, "line_no", F.lit(0).cast("bigint").alias("part"), F.col(seq).alias("first_seq"), "_meta", F.col("_piece").alias("_text")
    )
    of_line = Window.partitionBy(conn, "line_no").orderBy(seq)
    before = F.sum(F.length("_piece")).over(of_line.rowsBetween(Window.unboundedPreceding, -1))
    held = F.max("_offset").over(of_line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = (F.coalesce(before, F.lit(0)) + held).cast("bigint")
    edges = pieces.where(~F.col("_whole")).withColumn("_start", start)
    joined = (
        edges.withColumn("part", floor_div(F.col("_start"), most_bytes))
        .groupBy(conn, "line_no", "part")
        .agg(
            F.min(seq).alias("first_seq"),
            F.max_by("_meta", seq).alias("_meta"),
            F.array_sort(F.collect_list(F.struct(F.col(seq), F.col("_piece")))).alias("_pieces"),
        )
        .select(
            conn,
            "line_no",
            "part",
            "first_seq",
            "_meta",
            F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("_text"),
        )
        .where(F.length("_text") > 0)
    )
    return inner.unionByName(joined).select(
        conn,
        "line_no",
        "part",
        "first_seq",
        F.col("_meta._seq").alias("last_seq"),
        F.col("_meta._place").alias("place"),
        *[F.col(f"_meta.{c}").alias(c) for c in keep],
        F.encode("_text", "ISO-8859-1").alias(payload),
    )


ORIGIN = ("recv_ts", "transport", "port", "source_ip")


def arrival(seq: Column, place: Column) -> Column:
    """Order of arrival of lines: by message, then by the place of their line feed in it."""
    return seq * (UNENDED + 1) + F.least(place, F.lit(UNENDED))


def framed_arrivals(lines: DataFrame) -> DataFrame:
    """Framed lines with where they came from, as decoded lines in order of arrival."""
    seq = arrival(F.col("last_seq"), F.col("place")).cast("bigint").alias("seq")
    return lines.select(*ORIGIN, seq, decode(F.col("payload")).alias("raw"))


def datagram_arrivals(raw: DataFrame) -> DataFrame:
    seq = arrival(F.col("seq"), F.lit(0)).cast("bigint").alias("seq")
    return datagrams(raw).select(*ORIGIN, seq, "raw")


def arrivals(raw: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Messages of both transports to lines ``recv_ts, transport, port, source_ip, seq, raw``.

    A line has the time and address of the message that ends it; ``seq`` orders lines of one
    message. A connection's unfinished line is given as it is; ``streaming.ingest`` keeps it.
    """
    tcp = raw.where(F.col("transport") == "TCP")
    lines = frame_lines(tcp, ts="recv_ts", keep=ORIGIN, most_bytes=most_bytes)
    return datagram_arrivals(raw).unionByName(framed_arrivals(lines))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and the order inside it."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"),
    )
    return lines
