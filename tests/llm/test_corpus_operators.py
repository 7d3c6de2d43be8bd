"""Operators over whole tables: near duplicates, neighbours, packing, files, scores, the pipeline."""

import collections
import itertools
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from linefold.llm import hamming_join, hash_forest, packing, suffix_tree, token_files
from linefold.llm.common import bucket_of, scratch

BPE = P.path("byte_bpe_50k.json")


def clusters(texts, width):
    """Size and smallest id of the component of every text, pair by pair."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies():
    """Groups of copies with growing edits, so that links form chains."""
    draw, texts = np.random.default_rng(4), {}
    for group in range(12):
        words = [f"g{group}w{k}" for k in range(60)]
        for copy in range(12):
            own = list(words)
            for at in draw.integers(0, 60, copy // 2):
                own[at] = f"c{copy}x{at}"
            texts[100 + group * 20 + copy] = " ".join(own)
    return texts


@pytest.mark.parametrize("width, big", [(2, 3), (5, 64)])
def test_near_duplicates(spark, corpus, width, big, monkeypatch):
    monkeypatch.setattr(hamming_join, "BLOCK", 4)
    monkeypatch.setattr(hamming_join, "BIG", big)
    monkeypatch.setattr(hamming_join, "PART", 4)
    texts = {10_000 + i: t for i, t, _ in corpus} | near_copies() | {1: "one", 2: "One", 3: None, 4: "", 5: "one two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hamming_join.cluster(docs, width=width).collect()}
    assert got == clusters(texts, width)


def test_near_duplicate_rows(odd_rows, no_rows):
    rows = hamming_join.cluster(odd_rows, width=2).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept and by[1].component_id == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert hamming_join.cluster(no_rows).count() == 0


def test_signatures_share_a_key():
    """Any two signatures with a chunk that differs in one symbol at most meet under a key."""
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 16, hamming_join.SYMBOLS)
    for _ in range(50):
        b = a.copy()
        at = draw.choice(hamming_join.SYMBOLS, 2 * hamming_join.CHUNKS - 1, replace=False)
        b[at] += 1
        wrong = (a != b).reshape(hamming_join.CHUNKS, hamming_join.ROWS).sum(axis=1)
        assert wrong.min() <= 1


def vectors(spark, n=700, dim=16):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(20, dim))
    rows = [(i, (centres[i % 20] + 0.5 * draw.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(150)]  # a vector that many rows share
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def nearest(rows, k, step):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in zip(ids, x):
        if i % step == 0:
            s = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours(spark):
    rows, table = vectors(spark)
    want = nearest(rows, 5, 10)
    got = collections.defaultdict(list)
    for r in hash_forest.search(table, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    assert [i for i, _ in got[0]] == list(range(700, 705)) and got[0][0][1] == pytest.approx(1.0)


def test_neighbour_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None])]
    rows += [(6, [1.0, 1.0]), (None, [1.0, 0.5]), (7, [1.0, 0.0, 0.0]), (8, [1e-30, 1e-30])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = hash_forest.search(table, F.col("vec_id").isin(0, 2, 3, 4), 5).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 6), (0, 3, 8)]
    assert hash_forest.search(table.limit(0), F.lit(True), 5).count() == 0


def test_one_tree_gives_as_many_as_wanted(spark, monkeypatch):
    _, table = vectors(spark, n=300)
    monkeypatch.setattr(hash_forest, "REACH", 1)
    got = hash_forest.search(table, F.col("vec_id") % 50 == 0, 5, trees=1).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {5}


def test_small_shards_are_searched_whole(spark, monkeypatch):
    """Shards, runs and blocks of few rows: the exact neighbours, ties to the smaller id."""
    rows, _ = vectors(spark, n=400)
    rows += [(10_000 + i, [2.0 * float(x) for x in rows[-1][1]]) for i in range(40)]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for name, size in (("SHARD_ROWS", 50), ("BLOCK_ROWS", 3), ("RUN_SHARDS", 2)):
        monkeypatch.setattr(hash_forest, name, size)
    want = nearest([(i, np.asarray(v, dtype=float)) for i, v in rows], 5, 10)
    got = collections.defaultdict(list)
    for r in hash_forest.search(table, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
        assert all(i == j for (i, s), (j, t), nxt in zip(got[q], want[q], want[q][1:]) if abs(t - nxt[1]) > 1e-9)


def test_ascent_in_step():
    """The rows reached share a prefix of one length with the query in some tree; a symbol more reaches too few."""
    draw = np.random.default_rng(2)
    raw = draw.normal(size=(3_000, 8))
    forest = hash_forest.Forest.grown(np.arange(3_000), np.arange(3_000), raw, np.zeros(8), 5)
    codes = np.stack([hash_forest.strings(hash_forest._unit(raw), np.zeros(8), t) for t in range(5)], axis=1)
    for wanted in (1, 20, 400, 3_000):
        for q, rows in enumerate(forest.reached(codes[:8], wanted)):
            for shared in range(hash_forest.SYMBOLS, -1, -1):
                same = [
                    r for r in range(3_000)
                    if shared == 0 or any(int(codes[r, t]) >> 16 * (4 - shared) == int(codes[q, t]) >> 16 * (4 - shared) for t in range(5))
                ]
                if len(same) >= wanted:
                    break
            assert rows.tolist() == same


@pytest.mark.parametrize("n", [0, 1, 7, 500, 20_000])
def test_completion(n):
    draw = np.random.default_rng(n)
    lengths = np.minimum(draw.lognormal(5.5, 1.0, n).astype(int) + 1, 1024)
    counts = collections.Counter(lengths.tolist())
    plan, used = packing.complete(counts, 1024), collections.Counter()
    for items, times in plan:
        assert sum(items) <= 1024 and times > 0
        for i in items:
            used[i] += times
    assert used == counts
    bins = sum(t for _, t in plan)
    assert bins <= sum(t for _, t in packing.best_fit(counts, 1024))
    assert bins <= -(-int(lengths.sum()) // 1024) + 2


def test_completion_beats_best_fit():
    """Best fit takes four sequences for these, three are enough."""
    counts = {6: 1, 5: 3, 4: 2, 2: 1, 1: 1}
    assert sum(n for _, n in packing.complete(counts, 10)) == -(-sum(k * v for k, v in counts.items()) // 10)


def fewest(lengths, capacity):
    """Fewest sequences by trying every place for every piece."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            left = list(rooms)
            left.remove(r)
            put(i + 1, [*left, r - lengths[i]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def test_completion_by_exhaustive_search():
    draw = np.random.default_rng(12)
    for _ in range(150):
        lengths = draw.integers(1, 21, int(draw.integers(1, 11))).tolist()
        counts, want = collections.Counter(lengths), fewest(lengths, 20)
        assert packing.bound(counts, 20) <= want
        assert sum(n for _, n in packing.complete(counts, 20)) == want


def test_fillings_by_definition():
    """The least waste there is, no filling twice, none of more items than there are, none that is dominated."""
    draw = np.random.default_rng(13)
    for _ in range(100):
        lengths = sorted(draw.choice(np.arange(1, 15), 5, replace=False).tolist(), reverse=True)
        counts, room = draw.integers(0, 3, 5).tolist(), int(draw.integers(0, 25))
        every = {}
        for some in itertools.product(*(range(n + 1) for n in counts)):
            total = sum(n * k for n, k in zip(some, lengths))
            if total <= room:
                every[tuple(k for n, k in zip(some, lengths) for _ in range(n))] = room - total
        got = packing.fillings(counts, lengths, room, 100)
        assert len(set(got)) == len(got) and got and set(got) <= set(every)
        wastes = [every[w] for w in got]
        assert wastes == sorted(wastes) and wastes[0] == min(every.values())
    assert packing.dominated((3, 4), 0, 1 << 7) and not packing.dominated((3, 4), 0, 1 << 8)
    assert packing.dominated((3,), 2, 1 << 5) and not packing.dominated((3,), 0, 1 << 3)


def test_packing_rows(odd_rows, no_rows):
    library = Tokenizer.from_file(BPE)
    rows = packing.pack(odd_rows, BPE, end_id=2, capacity=256).collect()
    want = collections.Counter()
    for r in odd_rows.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 256)):
            want[r.doc_id, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(no_rows, BPE, end_id=2).count() == 0


def test_token_files(spark, odd_rows, no_rows):
    library = Tokenizer.from_file(BPE)
    files = token_files.write(odd_rows, scratch(spark, "tokens"), BPE, end_id=0)
    rows = token_files.read_digests(spark, files).orderBy("start").collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")
    at = 0
    for got, r in zip(rows, sorted(odd_rows.collect(), key=key), strict=True):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert (got.doc_id, got.start, got.n_tokens) == (r.doc_id, at, len(ids))
        assert got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    none = token_files.write(no_rows, scratch(spark, "tokens"), BPE, end_id=0)
    assert token_files.read_digests(spark, none).count() == 0


def direct_score(tree, body):
    """One byte after another: the longest retained suffix of what stands before it."""
    total, data = 0.0, b"\n" * suffix_tree.DEPTH + body
    for i in range(suffix_tree.DEPTH, len(data)):
        state = 0
        for k in range(1, suffix_tree.DEPTH + 1):
            longer = tree.child[state, tree.symbol[data[i - k]]]
            if not longer:
                break
            state = longer
        total += float(tree.log10[state, tree.symbol[data[i]]])
    return total


def test_scores(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string").repartition(2)
    rows = suffix_tree.score(docs.withColumn("held", bucket_of("doc_id", 5) == 1), "held").collect()
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t, _ in corpus}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = collections.Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, kinds = sum(counts.values()), len(counts)
    assert len(rows) == len(corpus)
    for r in rows:
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id in held, len(tokens[r.doc_id]), n)
        assert r.n_known == sum(w in counts for w in tokens[r.doc_id])
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score < 0


def test_tree_by_definition(spark):
    """Probabilities sum to one in every state; scores equal a walk byte by byte."""
    texts = ["the cat and the dog and the cow and the pig " * 30, "a man a plan a canal " * 40]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held boolean")
    table = suffix_tree.blocks(docs, "doc_id", "text", "held")
    sums = suffix_tree._gather(table).groupBy("kind", "bucket").applyInPandas(suffix_tree._add_up, suffix_tree._PACKED)
    tree = suffix_tree.grow(*suffix_tree._levels(sums.where("kind = 'windows'")))
    assert len(tree.log10) > 5
    seen = 10.0 ** tree.log10[:, 1:].astype(float)
    unseen = 257 - seen.shape[1]
    totals = seen.sum(axis=1) + unseen * 10.0 ** tree.log10[:, 0].astype(float)
    assert np.allclose(totals, 1, atol=1e-4)
    for body in (b"the cow and a plan\n", b"\n", b"zzz qq\n"):
        got = tree.score(np.frombuffer(body, np.uint8), np.array([len(body)]))[0]
        assert got == pytest.approx(direct_score(tree, body), abs=1e-4)


def test_scores_equal_the_tree_in_memory(spark, corpus):
    """The tables of contexts score as `grow` does."""
    rows = [(i, t, zlib.crc32(str(i).encode()) % 5 == 1) for i, t, _ in corpus]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    got = {r.doc_id: r for r in suffix_tree.score(docs, "held").collect()}
    table = suffix_tree.blocks(docs, "doc_id", "text", "held")
    sums = suffix_tree._gather(table).groupBy("kind", "bucket").applyInPandas(suffix_tree._add_up, suffix_tree._PACKED)
    tree = suffix_tree.grow(*suffix_tree._levels(sums.where("kind = 'windows'")))
    for i, t, _ in rows:
        body = b" ".join(t.encode().lower().split()) + b"\n"
        want = tree.score(np.frombuffer(body, np.uint8), np.array([len(body)]))[0]
        assert got[i].score == pytest.approx(want, rel=1e-4, abs=1e-3)


def test_rare_contexts_are_kept_in_a_large_corpus(spark):
    """Sixty times in 12 MB: over MIN_COUNT, less than 1e-5 of all bytes."""
    rows = [(i, "the cat sat on the mat " * 20_000, False) for i in range(26)]
    rows += [(100 + i, "qzjxkv", False) for i in range(60)] + [(200, "qzjxkv", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(2)
    got = suffix_tree.score(docs, "held").where("held_out").first()
    # One byte of many training texts' first, then five and the end that are nearly certain.
    assert got.score > -3 and got.score > got.base_score


def test_score_rows(odd_rows, no_rows):
    rows = suffix_tree.score(odd_rows.withColumn("held", F.col("doc_id") == 4), "held").collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    everything = suffix_tree.score(odd_rows.withColumn("held", F.lit(True)), "held").collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in everything} == {(0, 0, 0.0)}
    assert suffix_tree.score(no_rows.withColumn("held", F.lit(False)), "held").count() == 0


def test_pipeline_stages(spark, odd_rows, no_rows):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_rows, "").count() == 0, name
        rows = stage(spark, odd_rows, "")
        if name != "packing":
            assert rows.columns == odd_rows.columns
        rows.collect()
    left = corpus_pipeline.drop_near_duplicates(spark, odd_rows, "").collect()
    assert sum((r.text or "").startswith("one two") for r in left) == 1 and len(left) == 8


def test_pipeline(spark):
    """Against the stages' own rules, on the smallest tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    kept = {p.doc_id for p in pieces}
    texts = {r.doc_id: r.text for r in docs.collect()}
    judged = corpus_pipeline.apply_quality_rules(spark, corpus_pipeline.identify_language(spark, docs, ""), "")
    good = {r.doc_id: r.text for r in judged.collect()}
    assert kept == {i for i, (_, c) in clusters(good, 5).items() if i == c} and kept < set(texts)


def test_windows_that_share_their_nearest_bytes_are_sent_together():
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("aeioustrn"), 6)) for _ in range(3000)]
    bodies = [" ".join(rng.choice(names, 200)).encode() + b"\n" for _ in range(200)]
    sizes = np.array([len(b) for b in bodies])
    stream = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    grams, _ = suffix_tree.Block(np.arange(200), np.zeros(200, dtype=bool), sizes, stream).distinct_windows()
    bucket = suffix_tree._window_bucket(grams, 64)
    assert len(np.unique(np.stack([grams >> np.uint64(16), bucket]), axis=1)[0]) == len(np.unique(grams >> np.uint64(16)))
    held = np.bincount(bucket.astype(int), minlength=64)
    assert held.max() < 2 * held.mean()
    sent, cuts = suffix_tree.dealt(grams, bucket, 64)
    packed = [suffix_tree._pack_keys(sent[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
    assert all((suffix_tree._unpack_keys(p) == sent[i:j]).all() for p, i, j in zip(packed, cuts[:-1], cuts[1:]))
    assert sum(len(p) for p in packed) < 3 * len(grams)


def test_candidates_of_a_group_without_links_are_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(240):
        words = list(base)
        for at in rng.choice(300, 20, replace=False):
            words[at] = f"x{at}y{rng.integers(3)}"
        texts.append(" ".join(words))
    texts.append(texts[100] + " more")
    tried, confirm = [], hamming_join.confirm

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(hamming_join, "confirm", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = hamming_join.cluster(docs, width=2, percent=80).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == clusters(dict(enumerate(texts)), 2)
    assert sum(tried) < 50 * len(texts)
