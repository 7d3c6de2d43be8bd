"""Conversation repair, periodic runs and exact search against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linefold.llm import conversation_repair as repair
from linefold.llm import kd_search, periodic_runs
from linefold.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


# -- conversations -----------------------------------------------------------------------


def best_edits(rows):
    """The least (cost, audit, turns) over all edits, by search over (turn, initials so far) with no table."""
    bound = sum(4 for _ in rows) + 1
    best = [(bound, "Z", None)]

    def go(i, made, cost, audit, turns):
        if cost > best[0][0] or not re.fullmatch(r"s?(ua)*u?", made):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", made):
            best[0] = min(best[0], (cost, audit, turns), key=lambda b: b[:2])
        if len(made) < len(rows) + 3:
            for new in ("user", "assistant"):
                go(i, made + new[0], cost + 3, audit + "I", (*turns, (new, "")))
        if i == len(rows):
            return
        role, text, forced, cut = rows[i]
        go(i + 1, made, cost + 4, audit + "D", turns)
        if not forced:
            if role[:1]:
                go(i + 1, made + role[0], cost + 3 * cut, audit + "K", (*turns, (role, text)))
            for new in ("user", "assistant"):
                go(i + 1, made + new[0], cost + 3 + 3 * cut, audit + "R", (*turns, (new, text)))

    go(0, "", 0, "", ())
    return best[0]


def turns_of(rows):
    turns = repair.Turns()
    for role, _, forced, cut in rows:
        turns.add(repair.CODES.get(role[:1], 0), forced, cut)
    return turns


def drawn(draw, n):
    roles = ["user", "assistant", "system", "tool", "u", " "]
    return [(draw.choice(roles[: draw.choice([2, 3, 6])]), f"t{i}", draw.random() < 0.2, draw.random() < 0.3) for i in range(n)]


def test_audits_against_all_edits():
    draw = random.Random(3)
    for _ in range(150):
        rows = drawn(draw, draw.randint(0, 4))
        cost, audit, turns = best_edits(rows)
        made = turns_of(rows)
        assert repair.aligned(made) == (cost, audit) == repair.folded(made)
        assert tuple(t[1:] for t in repair.edited(audit, iter([r[:2] for r in rows]))) == turns


def test_long_conversations_are_folded_alike():
    draw = random.Random(4)
    for n in [5, 9, 14, 40, 200]:
        for _ in range(40 if n < 100 else 3):
            made = turns_of(drawn(draw, n))
            assert repair.aligned(made) == repair.folded(made)


def plain_rows(talks):
    """Damage, faults and repaired text of (conv_id, turn, role, text), with plain loops."""
    space = lambda v: " " if v is None else v
    held = collections.defaultdict(list)
    for conv, turn, role, text in talks:
        held[conv]
        code = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        held[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers = {r[0] for r in rows} - {None}
        faults, seen = [], set()
        for _, role, text in rows:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        plain = [(r, t, f in ("blank", "duplicate"), f == "truncated") for (_, r, t), f in zip(rows, faults)]
        count = collections.Counter(faults)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, plain)
    return out


def check_repairs(rows, want):
    assert collections.Counter(r.conv_id for r in rows) == collections.Counter(want.keys())
    for r in rows:
        *counts, plain = want[r.conv_id]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal] == counts
        cost, audit = repair.folded(turns_of(plain))
        if len(plain) < 5:
            assert best_edits(plain)[:2] == (cost, audit)
        made = [f"{role}:{text}" for _, role, text in repair.edited(audit, iter([p[:2] for p in plain]))]
        assert (r.cost, r.audit) == (cost, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(made).encode()).hexdigest()


def test_registered_repair(spark):
    talks = [tuple(r.values()) for r in pq.read_table(f"{SF_DIR}/conversations.parquet").to_pylist()]
    check_repairs(QUERIES["op11_conversation_repair"](spark, SF_DIR).collect(), plain_rows(talks))


@pytest.fixture(scope="module")
def odd_talks(spark):
    long = "word " * 20_000 + "end."
    rows = [
        (1, 0, "user", "A question?", 0), (1, 1, "assistant", "An answer.", 0), (1, 1, "assistant", "An answer.", 0),
        (1, 1, "assistant", "Another", 0), (2, None, None, None, 0), (2, None, "user", "Hi.", 0), (2, 5, "", "Empty role.", 0),
        (3, None, "user", "Only nulls.", 0), (None, 0, "user", "No id.", 0), (None, None, "assistant", "Nor a turn.", 0),
        (4, 0, "system", long, 0), (4, 1, "user", "é中😀", 0), (4, 9, "tool", " \t\n", 0), (5, 7, "uh", "x!\n", 0),
        (5, 7, "assistant", "b.", 0), (5, 7, "assistant", "a.", 0),
    ]
    rows += [(6, i, "user" if i % 3 else "assistant", f"text {i}" + "." * (i % 7 > 0), 0) for i in range(1500)]
    rows += [(i, 0, "user", "Alone?", 0) for i in range(10, 60)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost long")


def test_repair_of_odd_rows(spark, odd_talks):
    talks = [tuple(r)[:4] for r in odd_talks.collect()]
    check_repairs(repair.repair(repair.damaged(odd_talks), odd_talks).collect(), plain_rows(talks))
    none = odd_talks.limit(0)
    assert repair.repair(repair.damaged(none), none).count() == 0
    by_name = odd_talks.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert repair.repair(by_name).count() == odd_talks.select("conv_id").distinct().count()


def test_repaired_turns(odd_talks):
    rows = collections.defaultdict(list)
    for r in repair.repaired(odd_talks).orderBy("conv_id", "place").collect():
        rows[r.conv_id].append(r)
    for turns in rows.values():
        assert [t.place for t in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))
        assert all(t.text == "" for t in turns if t.edit == "I")


# -- periodic runs -----------------------------------------------------------------------


def runs_by_period(w):
    """Every period on its own: maximal stretches that keep it, less those of a multiple of a smaller period."""
    kept = []
    for q in range(1, len(w) // 4 + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)]
        i = 0
        for equal, part in itertools.groupby(same):
            size = len(list(part))
            start, length = i, size + q
            i += size
            if equal and length >= max(6, 4 * q):
                if not any(a <= start and start + length <= a + n and q % p == 0 for a, n, p in kept):
                    kept.append((start, length, q))
    return sorted(kept, key=lambda r: (r[0], r[2]))


def collapse_words(w, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(word for i, word in enumerate(w) if i not in gone)


def test_runs_against_every_period():
    draw = random.Random(5)
    for _ in range(1200):
        w = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 70))]
        if draw.random() < 0.6 and len(w) > 8:
            a = draw.randrange(len(w))
            p = 1 + (len(w) - a) // draw.randint(3, 10)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        row = b" ".join(b"w%d" % x for x in w)
        want = runs_by_period(w)
        assert periodic_runs.runs(w) == want
        assert periodic_runs.find([b"x y z", b"", row, row + b" q"])[2] == want
    assert periodic_runs.runs([1] * 30_000) == [(0, 30_000, 1)]


def check_runs(rows, texts):
    assert len(rows) == len(texts)
    for r, (_, text) in zip(rows, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = runs_by_period(words) if len(words) < 3000 else periodic_runs.runs(words)
        best = min(found, key=lambda f: (-f[1], f[0], f[2]), default=None)
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse_words(words, found).encode()).hexdigest()


def planted_text(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def test_registered_runs(spark, corpus):
    made = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()}
    texts = [(i, planted_text(i, t)) for i, t, _ in corpus]
    check_runs([made[i] for i, _ in texts], texts)
    assert sum(r.n_runs > 0 for r in made.values()) > len(made) // 20


def test_runs_of_odd_rows(odd_rows, no_rows):
    more = odd_rows.withColumn("n_runs", F.lit("clash")).withColumn("start", F.lit(1))
    rows = periodic_runs.judge(periodic_runs.planted(more)).collect()
    before = [(r.doc_id, planted_text(r.doc_id, r.text)) for r in more.collect()]
    check_runs(rows, before)
    assert periodic_runs.judge(periodic_runs.planted(no_rows)).count() == 0
    short = periodic_runs.collapse(odd_rows.where("doc_id = 5")).first().collapsed
    assert short == "one two three four five six seven eight nine ten eleven twelve"


# -- exact search ------------------------------------------------------------------------


def nearest(rows, asks, k):
    """{(id, vector)}: best (score, id) of all rows but those of the query's id, in Python integers."""
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    out = {}
    for i, v in whole:
        if asks(i):
            scores = [(sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(v) == len(w)]
            out[i, tuple(v)] = [(s, j) for s, j in sorted(scores, key=lambda s: (-s[0], s[1]))[:k]]
    return out


def check_search(found, want):
    held = collections.defaultdict(list)
    for r in found:
        held[r.query_id].append((r["rank"], r.score, r.vec_id))
    by_id = collections.defaultdict(list)
    for (i, _), best in want.items():
        by_id[i] += [(rank, score, j) for rank, (score, j) in enumerate(best, 1)]
    assert {i: sorted(v) for i, v in held.items()} == {i: sorted(v) for i, v in by_id.items() if v}


def test_search_against_all_pairs(spark, monkeypatch):
    """Several shards, blocks and runs; clusters, and one vector that a third of the rows share."""
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 150)
    monkeypatch.setattr(kd_search, "LEAF_ROWS", 8)
    monkeypatch.setattr(kd_search, "BLOCK_ROWS", 16)
    monkeypatch.setattr(kd_search, "RUN_SHARDS", 2)
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(6, 5))
    rows = [(int(i), (centres[i % 6] + 0.1 * draw.normal(size=5)).tolist()) for i in range(600)]
    rows += [(600 + i, [0.5, 0.25, 2.0, -1.0, 0.0]) for i in range(300)]
    order = draw.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<double>").repartition(7)
    found = kd_search.search(df, F.col("vec_id") % 20 == 0, k=7).collect()
    check_search(found, nearest(rows, lambda i: i % 20 == 0, 7))


def test_registered_search(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF_DIR}/embeddings.parquet").to_pylist()]
    check_search(QUERIES["op13_kd_search"](spark, SF_DIR).collect(), nearest(rows, lambda i: i % 20 == 0, 20))


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, -2.0]), (20, [1e30, 1.0]), (40, [-1e30, 0.5]), (3, [0.0, 0.0]), (3, [0.0, 0.0]), (60, [0.1]), (61, [5.0]), (80, [])]
    bad = [(100, None), (120, [nan, 1.0]), (140, [None, 1.0]), (160, [inf, 1.0]), (None, [1.0, 1.0]), (5, None)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, score int")
    want = nearest(good, lambda i: i % 20 == 0, 3)
    low, high = -(2**63), 2**63 - 1
    want = {q: [(min(max(s, low), high), j) for s, j in best] for q, best in want.items()}
    check_search(kd_search.search(df, F.col("vec_id") % 20 == 0, k=3).collect(), want)
    assert kd_search.search(df.limit(0), F.col("vec_id") % 20 == 0, k=3).count() == 0


def test_trees_prune(spark):
    """Far clusters are not opened."""
    draw = np.random.default_rng(7)
    rows = np.floor(64 * np.concatenate([draw.normal(size=(400, 3)) + c for c in ([50, 0, 0], [-50, 0, 0])]))
    tree = kd_search.Tree.grown(np.arange(800), rows)
    best = kd_search.Best(np.array([-1]), 3, np.array([np.iinfo(np.int64).min]))
    visits = kd_search.traverse(tree, np.array([[64.0, 0.0, 0.0]]), best)
    assert visits < np.sum(~tree.empty) / 3 and best.ids[0].tolist() == np.argsort(-rows[:, 0], kind="stable")[:3].tolist()
