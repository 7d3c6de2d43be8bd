"""Delivery batches: size-bounded runs of kept lines, closed early by an idle gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefold.operators.ordering import floor_div, micros, sessions_and_ranks, time_cell

# Default batch sizes by target and the idle flush interval.
HEC_BATCH_SIZE = 500
FOLDER_BATCH_SIZE = 5000
IDLE_SECONDS = 60


def default_batch_size(target_type: Column) -> Column:
    return F.when(target_type == "HEC", HEC_BATCH_SIZE).otherwise(FOLDER_BATCH_SIZE)


def assign_batches(
    df: DataFrame,
    batch_size: Column | int,
    idle_seconds: int = IDLE_SECONDS,
    source: str = "source_id",
    ts: str = "recv_ts",
    seq: str = "seq",
) -> DataFrame:
    """Add ``session``, ``chunk`` and ``place``; a batch is ``(source, session, chunk)``.

    ``place`` counts from 1 inside the batch in arrival order. Lines without a time are
    batched apart, as session -1.
    """
    size = F.lit(batch_size) if isinstance(batch_size, int) else batch_size
    numbered = sessions_and_ranks(df, idle_seconds * 1_000_000, source, ts, seq)
    row = F.col("session_row")
    return numbered.select(
        *df.columns,
        "session",
        F.floor(row / size).cast("bigint").alias("chunk"),
        (row % size + 1).cast("bigint").alias("place"),
    )


def batch_sizes(batched: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows per batch."""
    return batched.groupBy(source, "session", "chunk").agg(F.count("*").alias("rows"))


def idle_gaps(
    df: DataFrame,
    idle_seconds: int = IDLE_SECONDS,
    source: str = "source_id",
    ts: str = "recv_ts",
) -> DataFrame:
    """Every gap of at least ``idle_seconds`` between consecutive rows of a source.

    Such a gap always lies between two cells of that width, so only the edges of the cells
    are compared.
    """
    width = idle_seconds * 1_000_000
    us = micros(F.col(ts))
    edges = df.groupBy(source, time_cell(F.col(ts), width).alias("_cell")).agg(
        F.min(us).alias("_lo"), F.max(us).alias("_hi")
    )
    ordered = Window.partitionBy(source).orderBy("_cell")
    return (
        edges.withColumn("last_us", F.lag("_hi").over(ordered))
        .withColumn("gap_us", F.col("_lo") - F.col("last_us"))
        .where(F.col("gap_us") >= width)
        .select(source, "last_us", F.col("_lo").alias("next_us"), "gap_us")
    )


def minute_of(ts: Column) -> Column:
    return floor_div(micros(ts), 60_000_000)
