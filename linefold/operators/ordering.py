"""Ordering and running totals that never put a whole source into one task.

Rows are numbered inside small cells, the cells are summed up, and the sums are carried
forward over the (few) cells of a group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
#: One row in CUT_RATE is looked at for cut points, and a second is cut at every CUT_EVERY-th of them.
CUT_RATE, CUT_EVERY = 4_096, 16
MOST_BROADCAST_CUTS = 100_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_div(value: Column, width: int) -> Column:
    """Whole division that rounds down for negative values too."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def time_cell(ts: Column, idle_us: int) -> Column:
    return floor_div(micros(ts), idle_us)


def sessions_and_ranks(
    df: DataFrame,
    idle_us: int,
    source: str = "source_id",
    ts: str = "recv_ts",
    seq: str = "seq",
) -> DataFrame:
    """Add ``session`` and ``session_row`` (both from 0) per source in ``(ts, seq)`` order.

    A session ends where the next row is ``idle_us`` or more later. Cells are as wide as
    the idle interval, so a session can only end between two cells: the least and greatest
    time and the row count of each cell are enough to find every session and the number of
    rows before each cell. Cells are cut by second, and seconds with a flood of rows once
    more (see ``hot_cuts``); rows are numbered inside these parts alone, whatever the size
    of the input. Rows without a time are session -1 of their source; rows without a number
    come first in their time.
    """
    us = micros(F.col(ts))
    rows = df.withColumn("_cell", time_cell(F.col(ts), idle_us)).withColumn("_part", floor_div(us, SECOND))
    rows = add_slices(rows, hot_cuts(df, source, ts, seq), source, us, seq)
    keys = [source, "_cell", "_part", "_slice"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    by_part = Window.partitionBy(source, "_cell").orderBy("_part", "_slice").rowsBetween(Window.unboundedPreceding, 0)
    inner = (F.sum("_n").over(by_part) - F.col("_n")).alias("_inner")
    parts = counts.select(*keys, inner)
    cells = _carry_sessions(counts, idle_us, source)
    same_cell = F.col("p." + source).eqNullSafe(F.col("c." + source)) & F.col("p._cell").eqNullSafe(F.col("c._cell"))
    placed = parts.alias("p").join(cells.alias("c"), same_cell).select(
        *[F.col(f"p.{k}").alias(f"_k{i}") for i, k in enumerate(keys)],
        "c._session",
        (F.col("c._before") + F.col("p._inner")).alias("_base"),
    )
    in_part = Window.partitionBy(*keys).orderBy(us, F.col(seq))
    numbered = rows.withColumn("_row", F.row_number().over(in_part) - 1)
    same_part = functools.reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    )
    return numbered.join(placed, same_part).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.col("_session").alias("session"),
        (F.col("_base") + F.col("_row")).alias("session_row"),
    )


def hot_cuts(
    df: DataFrame, source: str = "source_id", ts: str = "recv_ts", seq: str = "seq", width: int = SECOND
) -> DataFrame | None:
    """``source, _part, _cuts``: cut points ``(us, seq)`` of spans with many rows, None if there are none.

    Spans are as wide as ``width``, a second unless given. One row in CUT_RATE is picked by a hash of its place, so
    the cuts are the same whenever they are made. Spans (or untimed rows) of which ``2 * CUT_EVERY`` or more are picked get a cut at every ``CUT_EVERY``-th, which leaves
    slices of about ``CUT_RATE * CUT_EVERY`` rows, even where all rows share one time.
    """
    us = micros(F.col(ts))
    places = df.select(F.col(source), us.alias("_us"), F.col(seq).cast("bigint").alias("_seq"))
    picked = places.where(F.pmod(F.xxhash64(source, "_us", "_seq"), F.lit(CUT_RATE)) == 0)
    held = picked.groupBy(source, floor_div(F.col("_us"), width).alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct("_us", "_seq"))).alias("_all")
    )
    every = F.filter("_all", lambda _, i: (i > 0) & (i % CUT_EVERY == 0))
    cuts = held.where(F.size("_all") >= 2 * CUT_EVERY).select(source, "_part", F.array_distinct(every).alias("_cuts"))
    size = cuts.agg(F.sum(F.size("_cuts"))).first()[0]
    if not size:
        return None
    return F.broadcast(cuts) if size <= MOST_BROADCAST_CUTS else cuts


def add_slices(rows: DataFrame, cuts: DataFrame | None, source: str, us: Column, seq: str) -> DataFrame:
    """Add ``_slice``, the number of cut points of the row's second that are not behind the row."""
    if cuts is None:
        return rows.withColumn("_slice", F.lit(0))
    c = cuts.select(F.col(source).alias("_cs"), F.col("_part").alias("_cp"), "_cuts")
    same = F.col(source).eqNullSafe(F.col("_cs")) & F.col("_part").eqNullSafe(F.col("_cp"))
    here = F.struct(us.alias("_us"), F.col(seq).cast("bigint").alias("_seq"))
    slice_ = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= here)), F.lit(0))
    return rows.join(c, same, "left").withColumn("_slice", slice_).drop("_cs", "_cp", "_cuts")


def _carry_sessions(counts: DataFrame, idle_us: int, source: str) -> DataFrame:
    """Session number and rows-before per (source, cell).

    The windows run over cells, of which a source has at most one per idle interval.
    """
    cells = counts.groupBy(source, "_cell").agg(
        F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    untimed = F.col("_cell").isNull()
    ordered = Window.partitionBy(source, untimed).orderBy("_cell")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.coalesce((F.col("_lo") - F.lag("_hi").over(ordered) >= idle_us).cast("bigint"), F.lit(0))
    total = F.sum("_n").over(so_far) - F.col("_n")
    opened = F.max(F.when(F.col("_opens") == 1, F.col("_total")).otherwise(F.lit(0))).over(so_far)
    return cells.select(source, "_cell", "_n", opens.alias("_opens"), total.alias("_total")).select(
        source,
        "_cell",
        F.when(untimed, F.lit(-1)).otherwise(F.sum("_opens").over(so_far)).cast("bigint").alias("_session"),
        (F.col("_total") - opened).alias("_before"),
    )
