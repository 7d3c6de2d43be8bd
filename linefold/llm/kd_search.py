"""Exact top-k by inner product from KD-trees, one per shard of rows.

Vectors are dealt round robin into shards of about `SHARD_ROWS` rows. Each shard is cut by medians along its widest
axis down to leaves of `LEAF_ROWS` rows, and every node keeps the tight bounding box of its rows and their least id;
a shard is one file in the shared folder. Queries are dealt into blocks, one file each. A block is searched in a
run of shards, best box first: the inner product of a query with any row of a box is at most that with the corner
that suits the query's signs, and a node is opened only while this bound can beat the query's k-th score so far (or
tie it with a smaller id). Queries of a block advance in step, so that bounds and leaf scores are matrix products.

The k-th score is carried from shard to shard inside a run, and from the first run of each block to all its others,
so that later runs start with a bound near the final one and mostly give few rows. At most k rows of each query and
run are shuffled. Every query is compared with every shard, as an exact search without clusters in the data must:
work grows with queries times rows, and no task holds more than one block and one shard.

Scores are exact integers: sums below 2**53 by floating-point products, others by Python integers, kept within 64
bits (a larger sum counts as the greatest or least 64-bit integer). Vectors that are null or hold null or non-finite
components take no part, nor do rows with a null id. A row is no candidate of a query of the same id; where an id is
repeated, each of its rows is a candidate of others, and the id asks once for each distinct vector. Vectors of
different lengths are not compared. Ties go to the smaller id. Fewer candidates than k give fewer rows; an empty
table gives none. Only the id and the vector are read, whatever other columns are called.
"""

from __future__ import annotations

import functools
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefold.llm.common import local_path, scratch, write_bytes, written

SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8_192, 256, 512
#: Shards that one task searches one after the other with the same block.
RUN_SHARDS = 8
#: Tasks of the second round; above it, a task takes several cells one after the other.
MOST_TASKS = 100_000
EXACT = 2**53

LONG = np.iinfo(np.int64)
_FOUND = "block long, place long, query_id long, vec_id long, score long"


class Tree:
    """Rows in leaf order with the nodes over them; children of node i are 2 i + 1 and 2 i + 2."""

    def __init__(self, ids, rows, cuts, low, high, least):
        self.ids, self.cuts, self.least = ids, cuts, least
        self.rows, self.low, self.high = (x.astype(np.float64) for x in (rows, low, high))
        self.inner = len(cuts) // 2
        self.empty = cuts[:, 0] == cuts[:, 1]

    @classmethod
    def grown(cls, ids: np.ndarray, rows: np.ndarray) -> Tree:
        depth = max(0, math.ceil(math.log2(max(1, len(ids)) / LEAF_ROWS)))
        order = np.arange(len(ids))
        cuts = [(0, len(ids))]
        for level in range(depth):
            for a, b in cuts[(1 << level) - 1 :]:
                part = rows[order[a:b]]
                if b - a > 1 and part.shape[1]:
                    axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
                    # Equal values keep the order of the ids, so copies fall into leaves by id.
                    order[a:b] = order[a:b][np.lexsort((ids[order[a:b]], part[:, axis]))]
                cuts += [(a, (a + b) // 2), ((a + b) // 2, b)]
        ids, rows = ids[order], rows[order]
        held = [rows[a:b] if b > a else np.zeros((1, rows.shape[1])) for a, b in cuts]
        low, high = np.array([p.min(axis=0) for p in held]), np.array([p.max(axis=0) for p in held])
        least = np.array([ids[a:b].min() if b > a else LONG.max for a, b in cuts])
        return cls(ids, rows, np.array(cuts), low, high, least)

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: getattr(self, n) for n in ("ids", "rows", "cuts", "low", "high", "least")}

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product a query can have inside each node's box."""
        with np.errstate(over="ignore", invalid="ignore"):
            made = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        size = np.abs(queries).max(initial=0) * max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))
        if size * queries.shape[1] >= EXACT:
            # Rounding may have made them too small.
            made = np.where(np.isnan(made), np.inf, made + np.abs(made) * 1e-9 + size * 1e-9)
        made[:, self.empty] = -np.inf
        return made


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as 64-bit integers."""
    size = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if size < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    out = [[sum(int(a) * b for a, b in zip(q, row)) for row in whole] for q in queries]
    return np.array([[min(max(s, LONG.min), LONG.max) for s in line] for line in out], dtype=np.int64)


class Best:
    """The k best rows so far of each query of a block, best first; free places have the least score."""

    def __init__(self, own: np.ndarray, k: int, least: np.ndarray):
        self.own, self.least = own, least
        self.scores = np.full((len(own), k), LONG.min)
        self.ids = np.full((len(own), k), LONG.max)

    def bar(self) -> tuple[np.ndarray, np.ndarray]:
        """The score a new row must reach, and the id it must be below at that score."""
        kth, at = self.scores[:, -1], self.ids[:, -1]
        return np.maximum(kth, self.least), np.where(kth >= self.least, at, LONG.max)

    def add(self, asking: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        kth, at = (b[asking] for b in self.bar())
        own = ids == self.own[asking][:, None]
        better = ~own & ((scores > kth[:, None]) | ((scores == kth[:, None]) & (ids <= at[:, None])))
        some = better.any(axis=1)
        if not some.any():
            return
        asking, better = asking[some], better[some]
        scores = np.concatenate([self.scores[asking], np.where(better, scores[some], LONG.min)], axis=1)
        ids = np.concatenate([self.ids[asking], np.where(better, ids[some], LONG.max)], axis=1)
        order = np.lexsort((ids, ~scores))[:, : self.scores.shape[1]]
        self.scores[asking] = np.take_along_axis(scores, order, axis=1)
        self.ids[asking] = np.take_along_axis(ids, order, axis=1)


def traverse(tree: Tree, queries: np.ndarray, best: Best) -> int:
    """Best-first search of a shard for a block of queries; gives the number of leaf visits."""
    bounds, visits = tree.bounds(queries), 0
    waiting = np.full(bounds.shape, -np.inf)
    waiting[:, 0] = bounds[:, 0]
    active = np.arange(len(queries))
    while len(active):
        node = waiting[active].argmax(axis=1)
        value = waiting[active, node]
        bar, below = (b[active] for b in best.bar())
        goes = (value > bar) | ((value >= bar.astype(np.float64)) & (tree.least[node] <= below) & (value > -np.inf))
        active, node = active[goes], node[goes]
        waiting[active, node] = -np.inf
        opens = node < tree.inner
        for child in (1, 2):
            below_it = 2 * node[opens] + child
            waiting[active[opens], below_it] = bounds[active[opens], below_it]
        leaf, asking = node[~opens], active[~opens]
        visits += len(leaf)
        order = np.argsort(leaf, kind="stable")
        leaf, asking = leaf[order], asking[order]
        heads = np.flatnonzero(np.diff(leaf, prepend=-1))
        for a, b in zip(heads, np.append(heads[1:], len(leaf))):
            first, end = tree.cuts[leaf[a]]
            some = asking[a:b]
            ids = np.broadcast_to(tree.ids[first:end], (len(some), end - first))
            best.add(some, products(queries[some], tree.rows[first:end]), ids)
    return visits


def _save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    out, short = io.BytesIO(), {}
    for name, values in arrays.items():
        small = values.dtype == np.float64 and np.abs(values).max(initial=0) < 2**15
        short[name] = values.astype(np.int16) if small else values
    np.savez(out, **short)
    write_bytes(uri, out.getvalue())


def _load(uri: str) -> dict[str, np.ndarray]:
    path = local_path(uri)
    if path is not None:
        with np.load(path) as held:
            return dict(held)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_file(inner) as file, np.load(io.BytesIO(file.read())) as held:
        return dict(held)


def _filed(rows: DataFrame, parts: int, folder: str, tree: bool) -> list[str]:
    """Rows dealt round robin into files; their names, of which there is one for each part.

    A file has a fresh name in each attempt of a task, and only the attempt that succeeded gives its name.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            vectors.append(np.floor(64.0 * flat).reshape(len(batch), -1) if len(batch) else np.empty((0, 0)))
        if not sum(map(len, ids)):
            return
        keys, values = np.concatenate(ids).astype(np.int64), np.concatenate([v for v in vectors if len(v)])
        name = f"{folder}/{uuid.uuid4().hex}.npz"
        _save(name, Tree.grown(keys, values).arrays() if tree else {"ids": keys, "rows": values})
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return sorted(r.name for r in rows.repartition(parts).mapInArrow(save, "name string").collect())


def _searched(cells: DataFrame, k: int) -> DataFrame:
    """The best rows of each cell: a block of queries, the shards of a run, and scores to reach, by place in the block."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell in frame.itertuples():
                held = _load(cell.queries)
                own, queries = held["ids"], held["rows"].astype(np.float64)
                bar = np.full(len(own), LONG.min)
                if cell.places is not None:
                    bar[np.asarray(cell.places, dtype=np.int64)] = cell.least
                best = Best(own, k, bar)
                for name in cell.shards:
                    traverse(Tree(**_load(name)), queries, best)
                full = best.ids < LONG.max
                at = np.repeat(np.arange(len(own)), full.sum(axis=1))
                columns = [np.full(len(at), cell.block), at, own[at], best.ids[full], best.scores[full]]
                yield pd.DataFrame(dict(zip(("block", "place", "query_id", "vec_id", "score"), columns)))

    return cells.mapInPandas(search, _FOUND)


def search(vectors: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest inner product for every row where `query` holds.

    Components are turned into floor(64 x) first.
    """
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    double = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), double.alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and v is not null").where(~bad)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).collect()
    found = [_of_size(rows.where(F.size("v") == s.dim), s.n, s.asks, k) for s in sizes if s.asks]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = [f.select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k) for f in found]
    return functools.reduce(DataFrame.unionByName, ranked).select("query_id", "rank", "vec_id", "score")


def _of_size(rows: DataFrame, n: int, asks: int, k: int) -> DataFrame:
    """What a search among vectors of one length finds: k rows or more of each query."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, "kd")
    # One name per file comes to the driver, not per row.
    shards = _filed(rows.select("id", "v"), math.ceil(n / SHARD_ROWS), folder, tree=True)
    blocks = _filed(rows.where("asks").select("id", "v").distinct(), math.ceil(asks / BLOCK_ROWS), folder, tree=False)
    runs = [shards[a : a + RUN_SHARDS] for a in range(0, len(shards), RUN_SHARDS)]
    # Blocks start at different runs, so that no shard is read by all at once.
    numbered = spark.createDataFrame([(i, name, i % len(runs)) for i, name in enumerate(blocks)], "block long, queries string, home long")
    runs_table = spark.createDataFrame(list(enumerate(runs)), "run long, shards array<string>")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("places", "least")]
    at_home = numbered.join(runs_table, F.col("home") == F.col("run")).select("block", "queries", "shards", *none)
    first = written(_searched(at_home.repartition(len(blocks)), k), "first")
    if len(runs) == 1:
        return first
    kth = first.groupBy("block", "place").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    lists = kth.groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("bars"))  # a block's rows at most
    lists = lists.select("block", F.col("bars.place").alias("places"), F.col("bars.score").alias("least"))
    # Names of blocks and runs, not rows: the stated queries meet all rows in blocks.
    others = numbered.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1)).cast("array<long>")))
    others = others.where("run <> home").join(runs_table, "run").join(lists, "block", "left")
    cells = others.select("block", "queries", "shards", "places", "least")
    return first.unionByName(_searched(cells.repartition(min(len(blocks) * (len(runs) - 1), MOST_TASKS)), k))
