"""Language-model scores from a probabilistic suffix tree over the bytes of normalised texts.

A text is its lower-cased words, one blank between them and a line feed at the end; the tree predicts each
byte from the bytes before it, back to the start of the text (read as line feeds). Contexts have up to DEPTH
bytes. A context is a candidate if training has it MIN_COUNT times, however large the corpus; it is retained
if its next-byte distribution diverges from that of its longest proper suffix by more than its size of counts
warrants (the likelihood gained, less half the logarithm of its count per next byte), or if it is the suffix
of one that is retained. Distributions are smoothed towards those of the suffix, with as much weight as there
are different next bytes; the root is smoothed evenly. A byte is scored in the state of the longest retained
suffix of what stands before it.

Texts are gathered in blocks of about BLOCK_BYTES, written once. Each block sends its distinct words and its
distinct byte windows (those of the same nearest bytes together) with their counts, dealt by hash over BUCKETS tables, or one per BLOCKS_A_BUCKET blocks
where that is more, so frequent ones are added up before the shuffle and no table grows with a frequent word
or with the corpus. Tables answer each block with the counts of its words in the whole training corpus. The
counts of windows are added by order in Spark, and the tree is one table per length: probabilities go from
short to long contexts by joins, what is retained from long to short. Blocks get the value of each of their
windows as they get the counts of their words. Nothing of the tree is on the driver. `grow` makes the same
tree in memory, for small corpora.

A null or empty text is its end alone. Rows with a null id are training rows. Without training rows both
scores come from even distributions. Repeated ids are scored row by row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.llm.common import discard, hash_words, mix, scratch, word_bytes, written

DEPTH, MIN_COUNT = 6, 50
BLOCK_BYTES, BUCKETS, BLOCKS_A_BUCKET, STEP_BYTES = 8 << 20, 64, 2, 1 << 20
#: Bits of a window that don't say where it goes: its byte and the farthest byte of its context.
NEAR_BITS = 16
END = 10
NULL_KEY = np.iinfo(np.int64).min

_BLOCKS = "block long, bytes long, ids binary, held binary, sizes binary, body binary"
_PACKED = "kind string, bucket int, block long, keys binary, counts binary, total long, distinct long"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=dtype)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, as steps."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and how often each stands there (or the sum of its weights)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    if weights is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(weights, starts) if len(starts) else weights


def blocks(docs: DataFrame, key: str, text: str, held: str) -> DataFrame:
    """Rows of neighbouring documents: ids, flags, sizes and bodies back to back, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, kept, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            ids, flags, bodies = zip(*kept)
            row = [
                (part << 32) + number,
                size,
                np.array([NULL_KEY if i is None else i for i in ids], dtype=np.int64).tobytes(),
                np.array(flags, dtype=np.bool_).tobytes(),
                np.array([len(b) for b in bodies], dtype=np.int64).tobytes(),
                _pack(np.frombuffer(b"".join(bodies), dtype=np.uint8)),
            ]
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
            names = [c.split()[0] for c in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            for i, t, h in zip(batch.column(0), batch.column(1), batch.column(2)):
                body = word_bytes(t.as_py(), lower=True) + b"\n"
                kept.append((i.as_py(), bool(h.as_py()), body))
                size += len(body)
                if size >= BLOCK_BYTES:
                    yield block()
                    number, kept, size = number + 1, [], 0
        if kept:
            yield block()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("body"), F.col(held).alias("held"))
    return written(rows.mapInArrow(run, _BLOCKS), "blocks")


@dataclass
class Block:
    """The arrays of one block."""

    ids: np.ndarray
    held: np.ndarray
    sizes: np.ndarray
    stream: np.ndarray

    @classmethod
    def of(cls, ids: bytes, held: bytes, sizes: bytes, body: bytes) -> Block:
        arrays = [np.frombuffer(d, dtype=t) for d, t in ((ids, np.int64), (held, np.bool_), (sizes, np.int64))]
        return cls(*arrays, _unpack(body, np.uint8))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of words of each document."""
        hashes, counts = [], []
        for docs, span in self.steps():
            body, ends = self.stream[span].tobytes(), np.cumsum(self.sizes[docs])
            made = hash_words([body[b - n : b - 1] for b, n in zip(ends.tolist(), self.sizes[docs].tolist())])
            hashes.append(made[0])
            counts.append(made[1])
        return np.concatenate(hashes), np.concatenate(counts)

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words, documents' numbers of words, distinct words by bucket, where each bucket starts."""
        words, counts = self.words()
        keys, _ = counted(words)
        return words, counts, *dealt(keys, keys % np.uint64(buckets), buckets)

    def distinct_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows of all texts in ascending order, and how often training texts have each."""
        found = []
        for docs, span in self.steps():
            made = windows(self.stream[span], self.sizes[docs])
            keys, _ = counted(made)
            seen, n = counted(made[np.repeat(~self.held[docs], self.sizes[docs])])
            trained = np.zeros(len(keys), dtype=np.int64)
            trained[np.searchsorted(keys, seen)] = n
            found.append((keys, trained))
        return counted(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

    def steps(self) -> Iterator[tuple[slice, slice]]:
        """Runs of documents of about STEP_BYTES, and where they stand in the stream."""
        ends, a = np.cumsum(self.sizes), 0
        while a < len(ends):
            start = ends[a] - self.sizes[a]
            b = max(a + 1, int(np.searchsorted(ends, start + STEP_BYTES, side="right")))
            yield slice(a, b), slice(start, ends[b - 1])
            a = b


def before(stream: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The byte k places before each byte of its document; line feeds before its start."""
    out = np.full(len(stream), END, dtype=np.uint8)
    out[k:] = stream[:-k] if k < len(stream) else out[k:]
    starts = np.cumsum(sizes) - sizes
    for j in range(k):
        at = starts[sizes > j] + j
        out[at] = END
    return out


def windows(stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each byte: the DEPTH bytes before it, the nearest in the highest place, and the byte itself lowest."""
    out = stream.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        out |= before(stream, sizes, k).astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
    return out


def dealt(keys: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys by bucket, in the given order inside each, and where each bucket starts."""
    order = np.argsort(bucket, kind="stable")
    return keys[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _window_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the nearest bytes, so that windows that share them stay together and pack well."""
    return (mix(keys >> np.uint64(NEAR_BITS)) >> np.uint64(8)) % np.uint64(buckets)


def _gather(table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What each block sends: its distinct words and windows by bucket, with their counts in training texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                block = Block.of(row.ids, row.held, row.sizes, row.body)
                rows = []
                words, counts, keys, cuts = block.distinct(buckets)
                seen, n = counted(words[np.repeat(~block.held, counts)])
                trained = np.zeros(len(keys), dtype=np.uint32)
                by_key = np.argsort(keys)
                trained[by_key[np.searchsorted(keys, seen, sorter=by_key)]] = n
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if i < j:
                        rows.append(("words", b, row.block, _pack_keys(keys[i:j]), _pack(trained[i:j])))
                grams, n = block.distinct_windows()
                order, cuts = dealt(np.arange(len(grams)), _window_bucket(grams, buckets), buckets)
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if i < j:
                        at = order[i:j]
                        rows.append(("windows", b, row.block, _pack_keys(grams[at]), _pack(n[at].astype(np.uint32))))
                out = pd.DataFrame(rows, columns=["kind", "bucket", "block", "keys", "counts"])
                yield out.assign(total=0, distinct=0)

    return table.select("block", "ids", "held", "sizes", "body").mapInPandas(run, _PACKED)


def _asks(table: DataFrame, buckets: int) -> DataFrame:
    """The distinct windows of each block by bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                grams, _ = Block.of(row.ids, row.held, row.sizes, row.body).distinct_windows()
                grams, cuts = dealt(grams, _window_bucket(grams, buckets), buckets)
                rows = [(b, row.block, _pack_keys(grams[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
                yield pd.DataFrame(rows, columns=["bucket", "block", "keys"])

    return table.select("block", "ids", "held", "sizes", "body").mapInPandas(run, "bucket int, block long, keys binary")


def _add_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One bucket of all blocks: answers to blocks for words, sums for windows."""
    kind, bucket = key
    keys = [_unpack_keys(k) for k in frame["keys"]]
    counts = [_unpack(c, np.uint32).astype(np.int64) for c in frame["counts"]]
    all_keys, sums = counted(np.concatenate(keys), np.concatenate(counts))
    if kind == "windows":
        rows = [("windows", bucket, 0, _pack_keys(all_keys), _pack(sums), 0, 0)]
    else:
        rows = [("totals", bucket, 0, b"", b"", int(sums.sum()), int((sums > 0).sum()))]
        for block, k in zip(frame["block"], keys):
            rows.append(("words", bucket, block, b"", _pack(sums[np.searchsorted(all_keys, k)]), 0, 0))
    return pd.DataFrame(rows, columns=["kind", "bucket", "block", "keys", "counts", "total", "distinct"])


@dataclass
class Tree:
    """Retained contexts: a row each, the root first."""

    symbol: np.ndarray  # byte -> column; 0 for bytes that training never saw
    child: np.ndarray  # state, column of the next byte back -> longer state, or 0
    log10: np.ndarray  # state, column of the next byte -> log10 probability

    def score(self, stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each document."""
        state = np.zeros(len(stream), dtype=np.int32)
        active = np.arange(len(stream), dtype=np.int32)
        for k in range(1, DEPTH + 1):
            back = self.symbol[before(stream, sizes, k)[active]]
            longer = self.child[state[active], back]
            found = longer > 0
            active = active[found]
            state[active] = longer[found]
        each = self.log10[state, self.symbol[stream]].astype(np.float64)
        return np.add.reduceat(each, np.cumsum(sizes) - sizes)


def _mask(k: int) -> int:
    """Of a window: its byte and the k bytes before that."""
    return (((1 << (8 * k)) - 1) << (8 * (DEPTH + 1 - k))) | 0xFF


def _shorter(column: str, k: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(_mask(k)))


class Scratch:
    """Tables by name, each deleted once it is not needed any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = scratch(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        discard(self.spark, *[self.paths.pop(n) for n in names if n in self.paths])


def _orders(windows_: DataFrame, tables: Scratch) -> list[DataFrame]:
    """How often training has each window, by length of the context from 0; zero for those of other texts alone."""

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b, k, c in zip(frame["bucket"], frame["keys"], frame["counts"]):
                yield pd.DataFrame({"bucket": np.int32(b), "window": _unpack_keys(k).view(np.int64), "n": _unpack(c, np.int64)})

    rows = windows_.select("bucket", "keys", "counts").mapInPandas(spread, "bucket int, window long, n long")
    orders = [tables.written(rows, f"order{DEPTH}")]  # a window is in one bucket, so it is whole
    for k in range(DEPTH - 1, -1, -1):
        level = orders[-1].groupBy(_shorter("window", k).alias("window")).agg(F.sum("n").alias("n"))
        orders.append(tables.written(level, f"order{k}"))
    return orders[::-1]


def _candidates(order: DataFrame) -> DataFrame:
    """Rows of contexts that training has MIN_COUNT times, with size and different next bytes of the context."""
    rows = order.select("window", "n", F.col("window").bitwiseAND(F.lit(~0xFF)).alias("context"))
    often = rows.groupBy("context").agg(F.sum("n").alias("size"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds"))
    return rows.join(often.where(F.col("size") >= MIN_COUNT), "context")


def _values(orders: list[DataFrame], tables: Scratch) -> DataFrame:
    """bucket, window, value: log10 of the probability of every window's byte in the tree."""
    total = orders[0].agg(F.sum("n")).first()[0] or 0
    p = [orders[0].select("window", ((F.col("n") + 0.5) / (total + 0.5 * 257)).alias("p"))]
    gains = [None]
    for k in range(1, DEPTH + 1):
        above = p[-1].select(F.col("window").alias("short"), F.col("p").alias("above"))
        cells = _candidates(orders[k]).withColumn("short", _shorter("window", k - 1)).join(above, "short")
        # Smoothed towards the suffix.
        smooth = (F.col("n") + F.col("kinds") * F.col("above")) / (F.col("size") + F.col("kinds"))
        cells = tables.written(cells.select("window", "context", "n", "size", "kinds", "above", smooth.alias("p")), f"cells{k}")
        p.append(cells.select("window", "context", "p"))
        gain = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("size") / F.col("above"))))
        by_context = cells.groupBy("context", "size", "kinds").agg(gain.alias("gain"))
        worth = F.col("gain") > 0.5 * F.col("kinds") * F.log(F.greatest("size", F.lit(2)))
        gains.append(by_context.where(worth).select("context"))
    keep = [None] * DEPTH + [tables.written(gains[DEPTH], f"kept{DEPTH}")]
    for k in range(DEPTH - 1, 0, -1):
        # A suffix of what is retained is retained.
        suffixes = keep[k + 1].select(F.col("context").bitwiseAND(F.lit(_mask(k) & ~0xFF)).alias("context"))
        keep[k] = tables.written(gains[k].union(suffixes).distinct(), f"kept{k}")
    value = p[0].select("window", F.log10("p").alias("value"))
    for k in range(1, DEPTH + 1):
        above = value.select(F.col("window").alias("short"), F.col("value").alias("above"))
        state = p[k].join(keep[k], "context", "left_semi").select("window", F.log10("p").alias("own"))
        every = orders[k].withColumn("short", _shorter("window", k - 1)).join(above, "short").join(state, "window", "left")
        held = ["bucket"] if k == DEPTH else []
        value = tables.written(every.select(*held, "window", F.coalesce("own", "above").alias("value")), f"values{k}")
        tables.drop(f"values{k - 1}", f"order{k - 1}", f"cells{k}", f"kept{k}")
    tables.drop(f"order{DEPTH}")
    return value


def _answer(key: tuple, asks: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """One bucket: answers to blocks with the values of their windows."""
    order = np.argsort(values["window"].to_numpy())
    known, value = values["window"].to_numpy()[order].view(np.uint64), values["value"].to_numpy()[order].astype(np.float32)
    rows = []
    for block, k in zip(asks["block"], asks["keys"]):
        rows.append(("windows", key[0], block, b"", _pack(value[np.searchsorted(known, _unpack_keys(k))]), 0, 0))
    return pd.DataFrame(rows, columns=["kind", "bucket", "block", "keys", "counts", "total", "distinct"])


def _levels(windows_: DataFrame) -> tuple[list[pd.DataFrame], int]:
    """Counts of candidate contexts with each next byte, by length from 0, and the number of training bytes."""
    orders = [o.where("n > 0") for o in _orders(windows_, Scratch(windows_.sparkSession))]
    total = orders[0].agg(F.sum("n")).first()[0] or 0
    return [orders[0].toPandas(), *[_candidates(o).select("window", "n").toPandas() for o in orders[1:]]], int(total)


def grow(levels: list[pd.DataFrame], total: int) -> Tree:
    """The tree from counts of candidate contexts."""
    root = levels[0]
    seen = np.sort(root.window.to_numpy(np.int64) & 0xFF).astype(int)
    symbol = np.zeros(256, dtype=np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    first = np.zeros(width)
    first[symbol[root.window.to_numpy(np.int64) & 0xFF]] = root.n
    p = [((first + 0.5) / (total + 0.5 * 257))[None, :].astype(np.float32)]
    contexts, parents, gains = [np.array([0])], [np.array([-1])], [np.array([0.0])]
    for k in range(1, DEPTH + 1):
        window, n = levels[k].window.to_numpy(np.int64), levels[k].n.to_numpy(np.float64)
        names, row = np.unique(window >> 8, return_inverse=True)
        mask = ((1 << (8 * (k - 1))) - 1) << (8 * (DEPTH - k + 1))
        above = np.searchsorted(contexts[-1], names & mask)
        column = symbol[window & 0xFF]
        kinds, size = np.bincount(row, minlength=len(names)), np.bincount(row, weights=n, minlength=len(names))
        # Smoothed towards the suffix; only the counted cells are above that.
        new = p[-1][above] if len(names) else np.empty((0, width), dtype=np.float32)
        gain = np.bincount(row, weights=n * np.log(n / size[row] / new[row, column]), minlength=len(names))
        new *= (kinds / (size + kinds))[:, None].astype(np.float32)
        new[row, column] += n / (size + kinds)[row]
        contexts.append(names)
        parents.append(above)
        gains.append(gain - 0.5 * kinds * np.log(np.maximum(size, 2)))
        p.append(new)
    keep = [g > 0 for g in gains]
    keep[0][:] = True
    for k in range(DEPTH, 0, -1):
        keep[k - 1][parents[k][keep[k]]] = True
    number, at = [], 0
    for k in keep:
        number.append(np.where(k, at + np.cumsum(k) - 1, 0))
        at += int(k.sum())
    child = np.zeros((at, width), dtype=np.int32)
    for k in range(1, DEPTH + 1):
        on = keep[k]
        back = (contexts[k][on] >> (8 * (DEPTH - k))) & 0xFF
        child[number[k - 1][parents[k][on]], symbol[back]] = number[k][on]
    child[:, 0] = 0
    log10 = np.concatenate([np.log10(x[k]) for x, k in zip(p, keep)])
    return Tree(symbol, child, log10)


def score(docs: DataFrame, held: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows where the boolean column `held` is false; `base_score` is that of single tokens.
    """
    table = blocks(docs, key, text, held)
    buckets = max(BUCKETS, -(-table.count() // BLOCKS_A_BUCKET))
    tables = Scratch(docs.sparkSession)
    added = _gather(table, buckets).groupBy("kind", "bucket").applyInPandas(_add_up, _PACKED)
    both = tables.written(added, "sums")
    sums = tables.written(both.where("kind <> 'windows'"), "words")
    orders = _orders(both.where("kind = 'windows'"), tables)
    del added, both
    tables.drop("sums")
    values = _values(orders, tables)
    asks = _asks(table, buckets)
    found = asks.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInPandas(_answer, _PACKED)
    totals = sums.where("kind = 'totals'").agg(F.sum("total"), F.sum("distinct")).first()

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"n": [int((~np.frombuffer(h, dtype=np.bool_)).sum()) for h in frame.held]})

    trained = table.select("held").mapInPandas(ends, "n long").agg(F.sum("n")).first()[0] or 0
    n_train = (totals[0] or 0) + trained
    n_kinds = (totals[1] or 0) + (trained > 0)

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        answers: dict[str, dict] = {"words": {}, "windows": {}}
        for kind, bucket, packed in zip(right["kind"], right["bucket"], right["counts"]):
            answers[kind][bucket] = _unpack(packed, np.int64 if kind == "words" else np.float32)
        told = {k: np.concatenate([a[b] for b in sorted(a)]) if a else np.empty(0, dtype=np.int64) for k, a in answers.items()}
        for row in left.itertuples(index=False):
            block = Block.of(row.ids, row.held, row.sizes, row.body)
            words, counts, keys, _ = block.distinct(buckets)
            c = told["words"]
            by_key = np.argsort(keys)
            in_order = c[by_key]
            keys = keys[by_key]
            tokens = in_order[np.searchsorted(keys, words)] if len(words) else np.empty(0, dtype=np.int64)
            log = lambda v: np.log10((v + 0.5) / (n_train + 0.5 * (n_kinds + 1)))
            which = np.repeat(np.arange(len(counts)), counts)
            sums_ = np.bincount(which, weights=log(tokens), minlength=len(counts))
            known = np.concatenate([[0], np.cumsum(tokens > 0)])
            stop = np.cumsum(counts)
            start = stop - counts
            grams, _ = block.distinct_windows()
            order, _ = dealt(np.arange(len(grams)), _window_bucket(grams, buckets), buckets)
            value = np.empty(len(grams), dtype=np.float32)
            value[order] = told["windows"]
            scores = []
            for docs, span in block.steps():
                made = windows(block.stream[span], block.sizes[docs])
                order = np.argsort(made)
                each = np.empty(len(made))
                each[order] = value[np.searchsorted(grams, made[order])]
                scores.append(np.add.reduceat(each, np.cumsum(block.sizes[docs]) - block.sizes[docs]))
            ids = pd.Series(block.ids).astype("Int64")
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": ids.mask(ids == NULL_KEY),
                        "held_out": block.held,
                        "n_tokens": counts + 1,
                        "n_known": known[stop] - known[start] + int(trained > 0),
                        "train_tokens": n_train,
                        "base_score": sums_ + log(trained),
                        "score": np.concatenate(scores),
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in _SCORES.split(", ")])

    replies = sums.where("kind = 'words'").unionByName(found).select("kind", "block", "bucket", "counts")
    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(one, _SCORES)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
