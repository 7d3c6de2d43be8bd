"""Best-fit packing of documents into sequences by bin completion with branch and bound.

Only documents longer than a sequence are cut: into whole sequences from their end, so that the first
piece holds the rest. Pieces of one length are alike, so the plan is made over counts by length, at most
`capacity` numbers however large the corpus: it says which lengths share a sequence and how often. Each
piece then finds its place from its rank among the pieces of its length; ranks are prefix sums over
partitions, so no length (a group of copies, say) meets in one task.

Planning: best-fit decreasing gives the first incumbent. Bin completion takes the largest length left and
enumerates the fillings around it, least waste first and larger lengths first, with no step that leads nowhere: sums
that the smaller lengths can reach are known as bit sets. A filling is dominated, and left out, if one length still
there could stand for some of its documents and fits in their room and its waste. A filling is used as
often as the counts allow; a branch ends when its waste leaves no sequence to save. Branches are taken up in order
of their departures from the first filling. The search ends at the lower bound (the best of the total and of those
that count which lengths can't share) or after a number of nodes; every incumbent is a whole packing.

A null text is an empty document: one piece that holds the end id. Rows with equal ids get pieces of
their own. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linefold.llm.common import digest, slices, written
from linefold.llm.encoder import encoder

CAPACITY = 1024
#: Fillings tried at a node, fillings looked at for them, and nodes of the search.
BRANCHES, LOOKS, NODES = 3, 64, 6_000

Plan = list[tuple[tuple[int, ...], int]]  # lengths in one sequence, how many such sequences


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of the pieces of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: equal open sequences are kept together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = min(capacity // length, left)
                groups, items = {(): left // each}, (length,) * each
                left -= groups[()] * each
                room = capacity
            else:
                items, groups = (length,), open_.pop(room)
            rest = open_.setdefault(room - sum(items), {})
            for held, n in groups.items():
                used = min(n, left) if held else n
                if held and used < n:
                    open_.setdefault(room, {})[held] = n - used
                if used:
                    rest[held + items] = rest.get(held + items, 0) + used
                    if held:
                        left -= used
    return [(items, n) for groups in open_.values() for items, n in groups.items() if n]


def bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for every threshold, lengths that can't share one, and what the rest can't fill."""
    best = 0
    for least in range(capacity // 2 + 1):
        alone = sum(n for k, n in counts.items() if k > capacity - least)
        half = [(k, n) for k, n in counts.items() if capacity < 2 * k and k <= capacity - least]
        small = sum(k * n for k, n in counts.items() if least <= k and 2 * k <= capacity)
        room = sum(n * (capacity - k) for k, n in half)
        best = max(best, alone + sum(n for _, n in half) - min(0, (room - small) // capacity))
    return best


def dominated(items: tuple[int, ...], waste: int, there: int) -> bool:
    """Whether one length of the bit set `there` can stand for some of the items: in their room and the waste."""
    span = (1 << (waste + 1)) - 1
    for size in range(1, min(len(items), 5) + 1):
        for some in itertools.combinations(items, size):
            # A length in place of itself changes nothing.
            total = sum(some) + (size == 1)
            if there >> total & (span if size > 1 else span >> 1):
                return True
    return False


def fillings(counts: list[int], lengths: list[int], room: int, wanted: int) -> list[tuple[int, ...]]:
    """The first undominated ways to fill `room`, least waste first, then larger lengths first."""
    at = [i for i, n in enumerate(counts) if n and lengths[i] <= room]
    full = (1 << (room + 1)) - 1
    # reach[j]: sums of the lengths from the j-th on.
    reach = [1] * (len(at) + 1)
    for j in range(len(at) - 1, -1, -1):
        bits, length, left, step = reach[j + 1], lengths[at[j]], min(counts[at[j]], room // lengths[at[j]]), 1
        while left:
            used = min(step, left)
            bits |= bits << (used * length) & full
            left -= used
            step *= 2
        reach[j] = bits
    there = sum(1 << lengths[i] for i in at)

    def ways(start: int, space: int, held: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Fillings of exactly `space`, each step of which can be completed."""
        if not space:
            yield held
            return
        for j in range(start, len(at)):
            if not reach[j] >> space & 1:
                return
            length = lengths[at[j]]
            for n in range(min(counts[at[j]], space // length), 0, -1):
                if reach[j + 1] >> (space - n * length) & 1:
                    yield from ways(j + 1, space - n * length, held + (length,) * n)

    found, first, looks = [], None, LOOKS
    for waste in range(room + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        for way in ways(0, room - waste, ()):
            first = way if first is None else first
            looks -= 1
            used, free = Counter(way), there
            for length in used:
                if used[length] == counts[lengths.index(length)]:
                    free &= ~(1 << length)
            if not dominated(way, waste, free):
                found.append(way)
            if len(found) == wanted or looks <= 0:
                return found or [first]
    return found or [first]


def complete(counts: dict[int, int], capacity: int, branches: int = BRANCHES, nodes: int = NODES) -> Plan:
    """The fewest sequences found for the pieces counted by length."""
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return []
    total = sum(k * v for k, v in counts.items())
    least = bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    lengths = sorted(counts, reverse=True)
    place = {length: i for i, length in enumerate(lengths)}
    # Each entry: departures, order, counts left, last step of the plan with those before it, waste.
    heap, order = [(0, 0, [counts[k] for k in lengths], None, 0)], itertools.count(1)
    while heap and best_n > least and nodes > 0:
        departures, _, left, plan, waste = heapq.heappop(heap)
        start = 0
        while nodes > 0:
            start = next((i for i in range(start, len(left)) if left[i]), None)
            if start is None:
                best = []
                while plan:
                    best.append(plan[0])
                    plan = plan[1]
                best_n = sum(n for _, n in best)
                break
            nodes -= 1
            left[start] -= 1
            ways = fillings(left, lengths, capacity - lengths[start], branches)
            left[start] += 1
            options = []
            for way in ways:
                items = (lengths[start], *way)
                need = Counter(items)
                n = min(left[place[k]] // c for k, c in need.items())
                lost = waste + n * (capacity - sum(items))
                if lost <= (best_n - 1) * capacity - total:  # else no plan below saves a sequence
                    options.append((n, need, items, lost))
            for n, need, items, lost in options[1:]:
                after = list(left)
                for k, c in need.items():
                    after[place[k]] -= n * c
                heapq.heappush(heap, (departures + 1, next(order), after, ((items, n), plan), lost))
            if not options:
                break
            n, need, items, waste = options[0]
            for k, c in need.items():
                left[place[k]] -= n * c
            plan = ((items, n), plan)
    return best


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(sizes):
                rows, out = batch.slice(a, b - a), []
                for doc, ids in zip(rows.column(0).to_pylist(), coder.encode(rows.column(1).to_pylist())):
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                    for i, (s, n) in enumerate(cut(len(ids), capacity)):
                        piece = ids[s : s + n]
                        out.append((doc, i, s, n, digest(piece)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(found: DataFrame, capacity: int) -> DataFrame:
    """Pieces with sequence_id and offset. `found` must be a written table with a column `length`."""
    parted = written(
        found.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    by_part = parted.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_part = written(by_part, "counts")
    # At most `capacity` rows.
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = complete(counts, capacity)

    # Where the k-th piece of a length goes: runs of ranks, each over neighbouring sequences.
    starts, sequences, offsets, taken, sequence = [], [], [], Counter(), 0
    for items, n in plan:
        offset = 0
        for length in items:
            starts.append((length << 44) + taken[length])
            sequences.append(sequence)
            offsets.append(offset)
            taken[length] += n
            offset += length
        sequence += n
    order = np.argsort(np.array(starts, dtype=np.int64))
    runs = [np.array(x, dtype=np.int64)[order] for x in (starts, sequences, offsets)]

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("part", "length").orderBy("row")
    ranked = (
        parted.withColumn("local", F.row_number().over(local) - 1)
        .join(bases, ["part", "length"])
        .withColumn("rank", F.col("base") + F.col("local"))
        .drop("part", "row", "base", "local")
    )
    columns = [c for c in found.columns]

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            key = (frame.length.to_numpy(np.int64) << 44) + frame["rank"].to_numpy(np.int64)
            at = np.searchsorted(runs[0], key, side="right") - 1
            out = frame[columns].copy()
            out["sequence_id"] = runs[1][at] + (key - runs[0][at])
            out["offset"] = runs[2][at]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return ranked.select(*columns, "rank").mapInPandas(assign, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return place(pieces(docs, tokenizer, end_id, capacity, key, text), capacity)
