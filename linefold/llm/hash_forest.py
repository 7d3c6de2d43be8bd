"""Approximate nearest neighbours by cosine from forests of hash prefixes.

Vectors are dealt round robin into shards of about SHARD_ROWS rows, one file each, with a forest of its own.
Each of TREES trees gives a vector a string of SYMBOLS symbols: the vector, less the mean of all unit vectors,
is turned by random rotations, and a symbol names the axis and sign of its largest coordinate. A tree is the
sorted array of its strings. A query descends in every tree to the strings that share its longest prefix, then
all trees ascend together, one symbol at a time, until REACH of the shard's vectors are reached; at the root all
of them are, so no query is left without neighbours and nothing is cut off. Candidates are scored with the original vectors in double precision.

Shards are of one size however many rows there are, so the part of the rows that is looked at, and the recall,
don't fall as the table grows. Queries are dealt into blocks, one file each; a task takes a block through RUN_SHARDS
shards and gives k + 1 neighbours a query. Work grows with queries times rows, by the share that the forests reach.

Equal vectors are one entry with its smallest ids, so a vector that a third of all rows share costs no more
than another; near copies are spread over all shards.

Vectors that are null, zero, of another length than most (ties: the shortest), or that hold null or non-finite
components take no part, nor do rows with a null id; a row is no neighbour of a query of its id. Ties go to the
smaller id. Fewer candidates than wanted give fewer rows; an empty table gives none. Only the id and the vector
are read.
"""

from __future__ import annotations

import functools
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linefold.llm.common import local_path, scratch, write_bytes, written

TREES, SYMBOLS = 40, 4
#: Rows of a shard, of a block of queries, and shards that one task takes a block through.
SHARD_ROWS, BLOCK_ROWS, RUN_SHARDS = 16_384, 256, 4
#: Vectors of a shard that an ascent has to reach.
REACH = 2_048
#: Tasks of the search; above it, a task takes several cells one after the other.
MOST_TASKS = 100_000
#: Copies gathered in a task before they are handed on.
HELD = 65_536
SEED = 23


@functools.lru_cache(maxsize=256)
def _rotations(dim: int, tree: int) -> list[np.ndarray]:
    draw = np.random.default_rng([SEED, tree])
    return [np.linalg.qr(draw.normal(size=(dim, dim)))[0] for _ in range(SYMBOLS)]


def strings(unit: np.ndarray, mean: np.ndarray, tree: int) -> np.ndarray:
    """The symbols of a tree for rows of unit vectors, 16 bits each, the first in the highest place."""
    x, out = unit - mean, np.zeros(len(unit), dtype=np.uint64)
    for rotation in _rotations(unit.shape[1], tree):
        turned = x @ rotation
        axis = np.abs(turned).argmax(axis=1)
        symbol = 2 * axis + (turned[np.arange(len(x)), axis] > 0)
        out = (out << np.uint64(16)) | symbol.astype(np.uint64)
    return out


def _matrix(values: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of tiny or huge components stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def entries(vectors: DataFrame, key: str, vector: str, query: Column, keep: int) -> tuple[DataFrame, str]:
    """Distinct vectors with a number, their `keep` smallest ids, and whether a query has them; the float type."""
    kind = vectors.schema[vector].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and v is not null").where(~bad & F.exists("v", lambda c: c != 0))
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    rows = rows.where(F.size("v") == (usual.dim if usual else 0))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies within a task become one row with their smallest ids."""
        ids: dict[bytes, list[int]] = {}
        asks: dict[bytes, bool] = {}

        def given() -> pd.DataFrame:
            out = [(b, sorted(set(held))[:keep], asks[b]) for b, held in ids.items()]
            return pd.DataFrame(out, columns=["v", "ids", "asks"])

        for frame in frames:
            for i, v, q in zip(frame["id"], frame["v"], frame["asks"]):
                # Adding zero turns -0.0 into 0.0.
                b = (np.asarray(v, dtype=dtype) + np.zeros(1, dtype=dtype)).tobytes()
                held = ids.setdefault(b, [])
                held.append(i)
                if len(held) > 4 * keep:
                    ids[b] = sorted(set(held))[:keep]
                asks[b] = asks.get(b, False) or bool(q)
            if len(ids) > HELD:
                yield given()
                ids.clear()
                asks.clear()
        yield given()

    copies = rows.mapInPandas(local, "v binary, ids array<long>, asks boolean")
    # At most `keep` ids of each HELD vectors of a task meet here.
    one = copies.groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.max("asks").alias("asks"))
    one = one.withColumn("ids", F.slice(F.array_sort(F.array_distinct("ids")), 1, keep))
    return written(one.withColumn("node", F.monotonically_increasing_id()), "entries"), dtype


def _save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
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


class Forest:
    """The vectors of a shard and, for each tree, their places in the order of its strings."""

    def __init__(self, nodes, least, raw, codes, order):
        self.nodes, self.least, self.raw, self.codes, self.order = nodes, least, raw, codes, order
        self.unit = _unit(raw.astype(np.float64))

    @classmethod
    def grown(cls, nodes: np.ndarray, least: np.ndarray, raw: np.ndarray, mean: np.ndarray, trees: int) -> Forest:
        unit, codes, order = _unit(raw.astype(np.float64)), [], []
        for tree in range(trees):
            code = strings(unit, mean, tree)
            at = np.argsort(code, kind="stable")
            codes.append(code[at])
            order.append(at.astype(np.uint32))
        return cls(nodes, least, raw, np.array(codes), np.array(order))

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: getattr(self, n) for n in ("nodes", "least", "raw", "codes", "order")}

    def reached(self, codes: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query (a row of strings, one for each tree) the rows its ascent ends with."""
        low, high = [], []
        for shared in range(SYMBOLS + 1):
            # Strings with the same first symbols stand together in the sorted array.
            if shared == 0:
                low.append(np.zeros(codes.shape, dtype=np.int64))
                high.append(np.full(codes.shape, len(self.nodes)))
                continue
            shift = np.uint64(16 * (SYMBOLS - shared))
            first = codes >> shift << shift
            last = first | ((np.uint64(1) << shift) - np.uint64(1))
            trees = range(codes.shape[1])
            low.append(np.stack([np.searchsorted(self.codes[t], first[:, t]) for t in trees], axis=1))
            high.append(np.stack([np.searchsorted(self.codes[t], last[:, t], side="right") for t in trees], axis=1))
        seen = np.zeros(len(self.nodes), dtype=bool)
        for q in range(len(codes)):
            for shared in range(SYMBOLS, -1, -1):
                a, b = low[shared][q], high[shared][q]
                # The sum over the trees counts a row once for each tree that reaches it.
                if shared and (b - a).sum() < wanted:
                    continue
                seen[:] = False
                for t in range(len(a) if shared else 1):
                    seen[self.order[t, a[t] : b[t]]] = True
                rows = np.flatnonzero(seen)
                if len(rows) >= wanted or shared == 0:
                    yield rows
                    break

    def nearest(self, queries: np.ndarray, codes: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query: scores, least ids and entries of its k nearest rows reached, nearest first."""
        wanted = max(k, REACH)
        for q, rows in zip(queries, self.reached(codes, wanted)):
            rough = self.unit[rows] @ q
            if len(rows) > k:
                # Products of a matrix may differ from sums in the last digits.
                bar = np.partition(rough, len(rows) - k)[len(rows) - k]
                rows = rows[rough >= bar - 1e-9]
            exact = (q * self.unit[rows]).sum(axis=1)
            best = np.lexsort((self.least[rows], -exact))[:k]
            yield exact[best], self.least[rows[best]], self.nodes[rows[best]]


_FOUND = "asker long, node long, score double, least long"


def _filed(rows: DataFrame, parts: int, make) -> list[str]:
    """Entries dealt round robin into files of the arrays that `make` gives; their names, one for each part.

    A file has a fresh name in each attempt of a task, and only the attempt that succeeded gives its name.
    """
    folder = scratch(rows.sparkSession, "forest")

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [frame for frame in frames if len(frame)]
        if held:
            name = f"{folder}/{uuid.uuid4().hex}.npz"
            _save(name, make(pd.concat(held)))
            yield pd.DataFrame({"name": [name]})

    return sorted(r.name for r in rows.repartition(parts).mapInPandas(save, "name string").collect())


def search(
    vectors: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "embedding", trees: int = TREES
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where `query` holds."""
    spark = vectors.sparkSession
    rows, dtype = entries(vectors, key, vector, query, k + 1)
    n, asks = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    if not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                part = _unit(_matrix(frame.v, dtype)).sum(axis=0)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [total.tobytes()]})

    parts = rows.select("v").mapInPandas(sums, "part binary").collect()  # one row per task
    mean = sum(np.frombuffer(p.part) for p in parts) / n

    def forest(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        raw = np.frombuffer(b"".join(frame.v), dtype=dtype).reshape(len(frame), -1)
        return Forest.grown(frame.node.to_numpy(), frame.least.to_numpy(), raw, mean, trees).arrays()

    def asked(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        unit = _unit(_matrix(frame.v, dtype))
        return {"nodes": frame.node.to_numpy(), "unit": unit, "codes": np.stack([strings(unit, mean, t) for t in range(trees)], axis=1)}

    # One name per file comes to the driver, not per row.
    shards = _filed(rows.select("node", "v", F.col("ids")[0].alias("least")), math.ceil(n / SHARD_ROWS), forest)
    blocks = _filed(rows.where("asks").select("node", "v"), math.ceil(asks / BLOCK_ROWS), asked)

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k + 1 nearest of each query of a block in the shards of a run."""
        for frame in frames:
            for block, run in zip(frame["block"], frame["shards"]):
                held = _load(block)
                best = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(held["nodes"])
                for name in run:
                    for i, new in enumerate(Forest(**_load(name)).nearest(held["unit"], held["codes"], k + 1)):
                        score, least, node = (np.concatenate(pair) for pair in zip(best[i], new))
                        at = np.lexsort((least, -score))[: k + 1]
                        best[i] = score[at], least[at], node[at]
                score, least, node = (np.concatenate(c) for c in zip(*best))
                asker = np.repeat(held["nodes"], [len(b[0]) for b in best])
                yield pd.DataFrame({"asker": asker, "node": node, "score": score, "least": least})

    runs = [shards[a : a + RUN_SHARDS] for a in range(0, len(shards), RUN_SHARDS)]
    # Names of blocks and runs, not rows: the stated queries meet all rows in blocks.
    cells = spark.createDataFrame([(b,) for b in blocks], "block string")
    cells = cells.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1)).cast("array<long>")))
    cells = cells.join(spark.createDataFrame(list(enumerate(runs)), "run long, shards array<string>"), "run")
    found = written(cells.repartition(min(len(blocks) * len(runs), MOST_TASKS)).mapInPandas(through, _FOUND), "found")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "least")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)

    # The k + 1 first ids of the k + 1 first entries, for each asking entry.
    ids = rows.select("node", F.explode("ids").alias("vec_id"))
    pairs = best.join(ids, "node").groupBy("asker").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")).alias("all"))
    result = written(pairs.select("asker", F.slice(F.array_sort(F.array_distinct("all")), 1, k + 1).alias("all")), "neighbours")

    # Every asking row takes its entry's neighbours, without its own id.
    values = vectors.where(F.coalesce(query, F.lit(False))).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("value"))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok = [v is not None and i == i for i, v in zip(frame["query_id"], frame["value"])]
            frame = frame[ok]
            v = [(np.array(v, dtype=dtype) + np.zeros(1, dtype=dtype)).tobytes() for v in frame["value"]]
            yield pd.DataFrame({"query_id": frame["query_id"].astype("int64"), "v": v})

    asking = values.where("query_id is not null and value is not null").mapInPandas(packed, "query_id long, v binary").distinct()
    mine = asking.join(rows.where("asks").select("v", "node"), "v").select("query_id", F.col("node").alias("asker"))
    lists = mine.join(result, "asker").select(
        "query_id", F.slice(F.filter("all", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("all")
    )
    ranked = lists.select("query_id", F.posexplode("all").alias("rank", "pair"))
    return ranked.select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("pair.vec_id").alias("vec_id"), (-F.col("pair.far")).alias("score")
    )
