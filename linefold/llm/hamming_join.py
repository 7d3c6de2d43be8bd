"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature is CHUNKS x ROWS minima cut to 16 bits; its distance counts symbols that differ. By the
pigeonhole principle two signatures at a distance below 2 * CHUNKS have a chunk with one error at most,
so every chunk is indexed once per symbol left out: all pairs under that distance share a key, and pairs
well beyond mostly none. At a similarity of 0.8 a pair shares no key with a probability of 3e-6.

Documents with equal shingle sets are one node from the start, so copies cost nothing further. Members of
a key are not paired with each other: each node is first held against the least of its keys' centres (a key's
centre is its least node), then, for what is not yet together, against the other centres, then against a node
of each key's own drawing; links are confirmed on full sets, and components are formed after each round. What is left are keys of three or more with several components. A member
of no or a smaller component is then held against the big component's members as one block after another, set
by set, and yields one link per block at most. Pairs outside big components are tried in blocks too, under their
first shared key only, and only if their distances to a common centre allow a link (one minus the similarity
is a metric) and so do the items that one of the two has alone; members without such a pair leave the block before
sets are read. So no link is lost, and a group of thousands of near copies costs about a link per copy.

Keys, links and components stay in tables in the shared folder; nothing of theirs goes to the driver but
counts. Hot groups meet only in partial aggregates, joins that Spark may split, and blocks.

A null or empty text has no shingles and is linked with nothing. A row with a null id takes no part either;
it has no component and is kept. Rows that repeat an id count as one document if their texts give the same
set. Only the id and the text are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linefold.llm.common import add_columns, hash_words, mix, slices, word_bytes, written

CHUNKS, ROWS = 12, 6
SYMBOLS = CHUNKS * ROWS
#: A similarity of 0.8 leaves fewer equal symbols than this with a probability of 1e-7.
LEAST_EQUAL = 40
#: Members of a key compared with each other in one block of the last round.
BLOCK = 512
#: A component of so many members is met by others as a whole, in parts of PART members.
BIG, PART = 64, 256
#: Size of the bitmap that tells which texts are read again: 8 MB.
BITS = 1 << 26

_FACTORS = np.random.default_rng(11).integers(1, 2**62, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DROPPED = np.array([[i for i in range(ROWS) if i != d] for d in range(ROWS)])


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text: runs of `width` words, or all words if fewer."""
    words, counts = hash_words([word_bytes(t, lower=True) for t in texts])
    sets, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        size = min(width, n)
        if not size:
            sets.append(np.empty(0, dtype=np.uint64))
            continue
        key = np.full(n - size + 1, size, dtype=np.uint64)
        for k in range(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + w[k : n - size + 1 + k])
        sets.append(np.unique(key))
    return sets


def signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """Of all sets of a batch at once; None for an empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    values = np.concatenate(full)
    starts = np.cumsum([0, *(len(s) for s in full[:-1])])
    out = np.empty((len(full), SYMBOLS), dtype=np.uint16)
    for j in range(SYMBOLS):
        least = np.minimum.reduceat(values * _FACTORS[j], starts)
        out[:, j] = mix(least) & np.uint64(0xFFFF)
    rows = iter(out)
    return [next(rows).tobytes() if len(s) else None for s in sets]


def _digest(values: np.ndarray) -> int:
    return int(np.sum(mix(values + np.uint64(1)), dtype=np.uint64).astype(np.int64))


def describe(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """id, n_shingles, two digests of the set, signature."""

    def make():
        def compute(texts: list[str | None]) -> list[list]:
            sets = shingle_sets(texts, width)
            one = [_digest(s) for s in sets]
            two = [int(np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).astype(np.int64)) for s in sets]
            return [[len(s) for s in sets], one, two, signatures(sets)]

        return compute

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return add_columns(source, "body", {"n": "long", "d1": "long", "d2": "long", "sig": "binary"}, make).drop("body")


def chunk_keys(nodes: DataFrame) -> DataFrame:
    """node, slot (chunk and symbol left out), key: every way to read a chunk with one symbol unread."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 4096):
                part = frame.iloc[a : a + 4096]
                sig = np.frombuffer(b"".join(part.sig), dtype=np.uint16).reshape(-1, CHUNKS, ROWS).astype(np.uint64)
                for c in range(CHUNKS):
                    for d in range(ROWS):
                        slot = c * ROWS + d
                        key = np.full(len(part), slot + 1, dtype=np.uint64)
                        for r in _DROPPED[d]:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c, r])
                        yield pd.DataFrame(
                            {"key": key.view(np.int64), "node": part.node.to_numpy(), "slot": np.int32(slot)}
                        )

    return nodes.where("n > 0").select("node", "sig").mapInPandas(run, "key long, node long, slot int")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose set sizes and signatures allow a link, with those of their sizes."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                left = np.frombuffer(b"".join(frame.sig_a), dtype=np.uint16).reshape(-1, SYMBOLS)
                right = np.frombuffer(b"".join(frame.sig_b), dtype=np.uint16).reshape(-1, SYMBOLS)
                yield frame[["a", "b"]][(left == right).sum(axis=1) >= LEAST_EQUAL]

    sized = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long")


def full_sets(wanted: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """node and items (its whole set) of the nodes asked for, from the texts.

    A bitmap of fixed size over hashed ids lets other texts go where they are read; it errs only towards
    keeping one, and the join that follows is exact.
    """
    slot = F.pmod(F.xxhash64("lo"), F.lit(BITS))
    # At most BITS / 32768 rows of 4 KB.
    filled = (
        wanted.groupBy(F.bitmap_bucket_number(slot + 1).alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
        .collect()
    )
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for row in filled:
        bits[(row.part - 1) * 4096 : row.part * 4096] = np.frombuffer(row.bits, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                made = shingle_sets(part.column(1).to_pylist(), width)
                arrays = [
                    part.column(0),
                    pa.array([_digest(s) for s in made], pa.int64()),
                    pa.array([s.tobytes() for s in made], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["lo", "d1", "items"])

    bodies = docs.select(F.col(key).cast("long").alias("lo"), F.col(text).cast("string").alias("body"))
    read = bodies.where("lo is not null").withColumn("slot", slot).mapInArrow(sets, "lo long, d1 long, items binary")
    # A repeated id may stand for other texts too, and repeated rows for the same.
    found = wanted.join(read, ["lo", "d1"]).groupBy("node").agg(F.first("items").alias("items"))
    return written(found, "sets")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Pairs with the similarity of their full sets and whether it reaches the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(wanted.join(nodes.select("node", "lo", "d1"), "node"), "wanted")
    found = full_sets(wanted, docs, key, text, width)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a, b, x, y in zip(frame.a, frame.b, frame.x, frame.y):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                rows.append((a, b, both / either, 100 * both >= percent * either))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity", "linked"])

    one = found.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = found.select(F.col("node").alias("b"), F.col("items").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return joined.mapInPandas(compare, "a long, b long, similarity double, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node of the links a, b.

    Each round hangs every component on its least neighbour and relabels the links that are left.
    """
    left = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(labels.withColumn("label", F.col("node")), "labels")
    while not left.isEmpty():
        hooks = left.groupBy(F.greatest("a", "b").alias("old")).agg(F.min(F.least("a", "b")).alias("new"))
        hooks = written(hooks, "hooks")

        def moved(frame: DataFrame, column: str, hooks: DataFrame = hooks) -> DataFrame:
            by = hooks.select(F.col("old").alias(column), "new")
            return frame.join(by, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")

        labels = written(moved(labels, "label"), "labels")
        left = written(moved(moved(left, "a"), "b").where("a <> b").distinct(), "links")
    return labels


def _left_over(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys of three or more that still belong to several components, with their labels."""
    named = keyed.where("members > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named, "named")
    open_ = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("node", F.xxhash64("node", "key")).alias("centre"))
    open_ = written(open_.where("low <> high").select("key", "centre"), "open")
    return named.drop("centre").join(open_, "key")


def _met(
    marked: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int
) -> DataFrame:
    """Links a, b between members of big components and what shares a key with them and isn't in them.

    Each such node is held against all members of the component that are under open keys, part by part and
    set by set, and gives one link per part at most; so the rows grow with the nodes, not with the pairs.
    """
    big = marked.where("size is not null")
    groups = big.select("key", F.col("label").alias("big"), F.col("size").alias("big_size")).distinct()
    smaller = "label <> big and (coalesce(size, 0) < big_size or size = big_size and label < big)"
    asks = marked.select("key", "node", "label", "size").join(groups, "key").where(smaller)
    asks = asks.select("node", "big", "big_size").distinct()
    parts = F.ceil(F.col("big_size") / PART).cast("int")
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("asks", F.lit(True))
    held = big.select("node", F.col("label").alias("big"), F.col("size").alias("big_size")).distinct()
    held = held.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("asks", F.lit(False))
    both = written(held.unionByName(asks).drop("big_size"), "met")
    wanted = both.select("node").distinct().join(nodes.select("node", "lo", "d1"), "node")
    found = full_sets(written(wanted, "wanted"), docs, key, text, width)
    dealt = both.join(found, "node").repartition("big", "part").sortWithinPartitions("big", "part", "asks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, names, sets, index = None, [], [], None
        for frame in frames:
            out = []
            for big_, part, node, ask, raw in zip(frame.big, frame.part, frame.node, frame.asks, frame["items"]):
                if (big_, part) != now:
                    now, names, sets, index = (big_, part), [], [], None
                items = np.frombuffer(raw, dtype=np.uint64)
                if not ask:
                    names.append(node)
                    sets.append(items)
                    continue
                if not names:
                    continue
                if index is None:
                    # The members' items in one array, and where each member begins.
                    sizes = np.array([len(x) for x in sets])
                    index = np.concatenate(sets), np.cumsum(sizes) - sizes, sizes
                pool, starts, sizes = index
                at = np.minimum(np.searchsorted(items, pool), len(items) - 1)
                common = np.add.reduceat((items[at] == pool).astype(np.int64), starts)
                linked = np.flatnonzero(100 * common >= percent * (sizes + len(items) - common))
                if len(linked):
                    out.append((node, names[linked[0]]))
            yield pd.DataFrame(out, columns=["a", "b"])

    return dealt.select("big", "part", "node", "asks", "items").mapInPandas(run, "a long, b long")


def _alone(rows: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """How many items of each of these nodes no other of them has."""
    wanted = rows.select("node").distinct().join(nodes.select("node", "lo", "d1"), "node")
    found = full_sets(written(wanted, "wanted"), docs, key, text, width)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node, items in zip(frame.node, frame["items"]):
                yield pd.DataFrame({"item": np.frombuffer(items, dtype=np.int64), "node": node})

    items = found.mapInPandas(spread, "item long, node long")
    one = items.groupBy("item").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node")).where("nodes = 1")
    return written(one.groupBy("node").agg(F.count(F.lit(1)).alias("alone")), "alone")


_PLACE = ["key", "i", "j"]


def _by_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one block after another, from rows in their order."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(held):
            continue
        same = (held[_PLACE] == held[_PLACE].iloc[-1]).all(axis=1).to_numpy()
        done, held = held[~same], held[same]
        for _, group in done.groupby(_PLACE, sort=False):
            yield group
    if held is not None and len(held):
        yield held


def _candidates(frame: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For the rows of a block: the row, and the rows after or across it that it may be linked with."""
    own, label, n, alone = (frame[c].to_numpy() for c in ("own", "label", "n", "alone"))
    node, near, far = (frame[c].to_numpy() for c in ("node", "near", "far"))
    i, j, slot = int(frame.i.iloc[0]), int(frame.j.iloc[0]), int(frame.slot.iloc[0])
    sig = np.frombuffer(b"".join(frame.sig), dtype=np.uint16).reshape(-1, SYMBOLS)
    for x in range(len(frame)):
        ok = (label != label[x]) & (own == j) & ((own[x] == i) if i != j else (node > node[x]))
        # What one set has alone it shares with none.
        both = np.minimum(n - alone, n[x] - alone[x])
        ok &= 100 * both >= percent * (n + n[x] - both)
        # Not known (nan) never excludes; 1e-9 is for rounding.
        most = 1 - percent / 100 + 1e-9
        ok &= ~(np.abs(near - near[x]) > most) & ~(np.abs(far - far[x]) > most)
        at = np.flatnonzero(ok)
        if len(at):
            equal = sig[at] == sig[x]
            at, equal = at[keep := equal.sum(axis=1) >= LEAST_EQUAL], equal[keep]
            by_chunk = equal.reshape(-1, CHUNKS, ROWS)
            first = np.argmax(by_chunk.sum(axis=2) >= ROWS - 1, axis=1)
            unread = np.argmin(by_chunk[np.arange(len(at)), first], axis=1)
            at = at[first * ROWS + unread == slot]
            if len(at):
                yield x, at


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Members of keys, by block, that have a candidate across components there."""
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    spread = (
        rows.withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .select(*_PLACE, "own", "node", "label", "slot", "n", "alone", "sig", "near", "far")
    )
    dealt = spread.repartition(*_PLACE).sortWithinPartitions(*_PLACE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_block(frames):
            open_ = np.zeros(len(group), dtype=bool)
            for x, at in _candidates(group, percent):
                open_[x] = open_[at] = True
            if open_.any():
                yield group[open_]

    return dealt.mapInPandas(run, dealt.schema)


def _links_across(
    across: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int
) -> DataFrame:
    """Links a, b between candidates, found on full sets inside each block.

    Sets go to the blocks, not to pairs, and a block gives no link that its others imply; so the rows that are made
    grow with the members, though many of a group may be candidates of each other.
    """
    wanted = across.select("node").distinct().join(nodes.select("node", "lo", "d1"), "node")
    found = full_sets(written(wanted, "wanted"), docs, key, text, width)
    dealt = across.join(found, "node").repartition(*_PLACE).sortWithinPartitions(*_PLACE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_block(frames):
            node, sets = group.node.to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in group["items"]]
            team, out = np.arange(len(group)), []
            for x, at in _candidates(group, percent):
                for y in at.tolist():
                    if team[x] == team[y]:
                        continue
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        team[team == team[y]] = team[x]
                        out.append((min(node[x], node[y]), max(node[x], node[y])))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return dealt.mapInPandas(run, "a long, b long")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    described = written(describe(docs, key, text, width), "described")
    with_id = described.where("doc_id is not null and n > 0")
    nodes = with_id.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("lo"), F.first("sig").alias("sig"))
    nodes = written(nodes.withColumn("row", F.monotonically_increasing_id()), "sets")
    # A set is named by its least id, so that a component's least node is its id; by a number where ids repeat.
    named_by_id = nodes.groupBy("lo").count().where("count > 1").isEmpty()
    nodes = nodes.withColumn("node", F.col("lo") if named_by_id else F.col("row")).drop("row")

    keys = chunk_keys(nodes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("centre"))
    shared = written(shared.where("members > 1"), "shared")
    keyed = written(keys.join(shared, "key"), "keyed")

    def tried(pairs: DataFrame) -> DataFrame:
        found = written(likely(pairs.distinct(), nodes, percent), "likely")
        return written(confirm(found, nodes, docs, key, text, width, percent), "tried")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends are not yet in one component."""
        for end in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
        return pairs.where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b")

    # Each node is tried with the least of its centres first; what that puts together needs no other.
    centres = keyed.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    centres = written(centres.distinct(), "centres")
    near = tried(centres.groupBy("a").agg(F.min("b").alias("b")))
    labels = components(near.where("linked"))
    near = near.unionByName(tried(apart(centres.join(near.select("a", "b"), ["a", "b"], "left_anti"), labels)))
    links = near.where("linked").select("a", "b")
    labels = components(links)

    rows = written(_left_over(keyed, labels), "rows")
    if not rows.isEmpty():
        pairs = rows.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"), "label")
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        pairs = pairs.join(other, "b", "left").where("label <> coalesce(label_b, b)").select("a", "b").distinct()
        before = near.select(F.col("b").alias("a"), F.col("a").alias("b")).union(near.select("a", "b"))
        far = tried(pairs.join(before, ["a", "b"], "left_anti"))
        links = links.union(far.where("linked").select("a", "b"))
        labels = components(links)

        rows = written(_left_over(keyed.withColumn("first", F.col("centre")), labels), "rows")
        big = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= BIG)
        marked = written(rows.join(big, "label", "left"), "marked")
        met = written(_met(marked, nodes, docs, key, text, width, percent), "links")
        links = links.union(met)
        # Every pair with a member of a big component is settled.
        rows = marked.where("size is null")
        if not rows.isEmpty():
            def distance(tried_: DataFrame, centre: str, name: str) -> DataFrame:
                return tried_.select(F.col("a").alias("node"), F.col("b").alias(centre), (1 - F.col("similarity")).alias(name))

            rows = rows.join(distance(near, "first", "near"), ["node", "first"], "left")
            rows = rows.withColumn("near", F.when(F.col("node") == F.col("first"), 0.0).otherwise(F.col("near")))
            rows = rows.join(distance(far, "centre", "far"), ["node", "centre"], "left")
            rows = rows.withColumn("far", F.when(F.col("node") == F.col("centre"), 0.0).otherwise(F.col("far")))
            rows = written(rows.join(nodes.select("node", "n", "sig"), "node"), "rows")
            alone = _alone(rows, nodes, docs, key, text, width)
            rows = rows.join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
            across = written(_across(rows, percent), "across")
            links = links.union(written(_links_across(across, nodes, docs, key, text, width, percent), "links"))
        labels = components(links)

    named = nodes.select("node", "lo", "d1", "d2", "n").join(labels, "node", "left")
    named = named.withColumn("component_id", F.coalesce("label", "node"))
    if not named_by_id:
        named = written(named, "named")
        least = named.groupBy("component_id").agg(F.min("lo").alias("least"))
        named = named.join(least, "component_id").withColumn("component_id", F.col("least"))
    named = named.select("d1", "d2", "n", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        described.select("doc_id", "n", "d1", "d2")
        .join(named, ["d1", "d2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
