"""Periodic runs of words in each text, from a suffix automaton whose link tree is a link-cut tree.

A run is a stretch of words with smallest period q and at least `LEAST_LENGTH` words and `EXPONENT` periods that no
neighbouring word extends. Words are appended one by one. A state's last occurrence is the end of its latest
copy so far, and an appended word gives that end to all states on the path from its new state to the root. Link-cut
access walks this path as few segments, each of one colour, the last occurrence of its states before. The deepest
state of a segment coloured j is the longest common suffix of what ends at j and at the new word i; where it is as
long as the distance i - j, the two copies touch and form a square of that period, whose start is the first word of
the earlier copy, as the suffix can't grow. A run shows its own period so at its last word, and at that word only
it can't be extended to the right, so every run is found once.

Before that, words that can't be in a run are left out: with four periods or more, each run of three words inside a
run stands there three times, so the automaton sees only stretches in which every three words occur three times or
more in the text. This leaves out no run. An appended word costs O(log n), whatever the text repeats. Words are compared by
a 64-bit hash.

Nulls and texts without words have no runs: counts are 0, the longest run is null, hashes are those of the empty
string. Texts of any length are read whole; the automaton of one text stays in memory, about a kilobyte for each of
its words that repeat. Repeated rows are judged one by one, so equal texts give equal results; among longest runs
the first start, then the smallest period is reported. Nothing is shuffled; other columns pass, and columns of the
names made here are replaced. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linefold.llm.common import add_columns, hash_words, mix, word_bytes

EXPONENT, LEAST_LENGTH = 4, 6

COLUMNS = {
    "n_runs": "long",
    "start": "long",
    "length": "long",
    "period": "long",
    "exponent_milli": "long",
    "runs_sha256": "string",
    "collapsed_sha256": "string",
}
SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def runs(words: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers."""
    n = len(words)
    # States; 0 stands for none and 1 is the root.
    step: list[dict[int, int]] = [{}, {}]
    link, size = [0, 0], [0, 0]
    # The link tree as splay trees over root paths: children, parents (also of whole paths), colour at the top.
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def splay(x: int) -> None:
        """x becomes the top of its path and takes over its colour."""
        top = 0
        while True:
            p = up[x]
            if left[p] == x:
                g = up[p]
                if left[g] == p:  # twice to the right
                    b, c, top = right[p], right[x], g
                    left[g], left[p] = b, c
                    if b:
                        up[b] = g
                    if c:
                        up[c] = p
                    right[p], right[x], a = g, p, up[g]
                    up[g], up[p], up[x] = p, x, a
                elif right[g] == p:
                    b, c, top = left[x], right[x], g
                    right[g], left[p] = b, c
                    if b:
                        up[b] = g
                    if c:
                        up[c] = p
                    left[x], right[x], a = g, p, up[g]
                    up[g] = up[p] = x
                    up[x] = a
                else:
                    c = right[x]
                    left[p] = c
                    if c:
                        up[c] = p
                    right[x], up[x], up[p] = p, g, x
                    colour[x] = colour[p]
                    return
            elif right[p] == x:
                g = up[p]
                if right[g] == p:  # twice to the left
                    b, c, top = left[p], left[x], g
                    right[g], right[p] = b, c
                    if b:
                        up[b] = g
                    if c:
                        up[c] = p
                    left[p], left[x], a = g, p, up[g]
                    up[g], up[p], up[x] = p, x, a
                elif left[g] == p:
                    b, c, top = left[x], right[x], g
                    right[p], left[g] = b, c
                    if b:
                        up[b] = p
                    if c:
                        up[c] = g
                    left[x], right[x], a = p, g, up[g]
                    up[g] = up[p] = x
                    up[x] = a
                else:
                    c = left[x]
                    right[p] = c
                    if c:
                        up[c] = p
                    left[x], up[x], up[p] = p, g, x
                    colour[x] = colour[p]
                    return
            else:
                if top:
                    colour[x] = colour[top]
                return
            if left[a] == g:
                left[a] = x
            elif right[a] == g:
                right[a] = x

    found = []
    last = 1
    for i, word in enumerate(words):
        new = len(size)
        step.append({})
        size.append(i + 1)
        left.append(0)
        right.append(0)
        colour.append(i)
        p = last
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if not p:
            parent = 1
        else:
            parent = step[p][word]
            if size[p] + 1 < size[parent]:
                # A copy of the state for its shorter words: it stands right above it, on the same path.
                old, parent = parent, new + 1
                step.append(dict(step[old]))
                size.append(size[p] + 1)
                link += [parent, link[old]]
                link[old] = parent
                while p and step[p].get(word) == old:
                    step[p][word] = parent
                    p = link[p]
                splay(old)
                above = left[old]
                left.append(above)
                right.append(0)
                colour.append(-1)
                up += [parent, old]
                left[old] = parent
                if above:
                    up[above] = parent
        if len(link) == new:
            link.append(parent)
            up.append(parent)
        # Access: segments from the new state to the root, deepest state first; all take the colour i.
        below, v = new, parent
        while v:
            splay(v)
            before = colour[v]
            common, period = size[v], i - before
            if common >= (EXPONENT - 1) * period and common + period >= LEAST_LENGTH:
                if i + 1 == n or words[i + 1] != words[i + 1 - period]:
                    found.append((i - common - period + 1, common + period, period))
            lower = right[v]
            if lower:
                colour[lower] = before
            right[v] = below
            below, v = v, up[v]
        colour[below] = i
        last = new
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches of all texts in which every three words occur three times or more in their text."""
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    if len(words) < LEAST_LENGTH:
        return []
    keys = mix(mix(mix(words[:-2] + text[:-2]) ^ words[1:-1]) ^ words[2:])
    inside = text[:-2] == text[2:]
    order = np.argsort(keys)
    sorted_keys, sorted_text = keys[order], text[:-2][order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = (sorted_keys[1:] == sorted_keys[:-1]) & (sorted_text[1:] == sorted_text[:-1])
    heads = np.flatnonzero(~same[:-1])
    sizes = np.diff(np.append(heads, len(keys)))
    often = np.empty(len(keys), dtype=bool)
    often[order] = np.repeat(sizes >= EXPONENT - 1, sizes)
    often &= inside
    edges = np.flatnonzero(np.diff(np.concatenate([[0], often, [0]])))
    firsts, ends = edges[::2], edges[1::2] + 2
    long = ends - firsts >= LEAST_LENGTH
    return list(zip(firsts[long].tolist(), ends[long].tolist()))


def find(rows: Sequence[bytes]) -> list[list[tuple[int, int, int]]]:
    """The runs of each row of words joined by single spaces, by start, then period."""
    hashes, counts = hash_words(rows)
    begins = np.cumsum(counts) - counts
    found: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    for a, b in stretches(hashes, counts):
        row = int(np.searchsorted(begins, a, side="right")) - 1
        while not counts[row]:
            row -= 1
        numbers: dict[int, int] = {}
        seen = [numbers.setdefault(h, len(numbers)) for h in hashes[a:b].tolist()]
        found[row] += [(s + a - int(begins[row]), length, q) for s, length, q in runs(seen)]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(row: bytes, spans: Sequence[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by single spaces."""
    if not spans:
        return row
    words = row.split(b" ")
    keep = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in spans:
        keep[start + period] += 1
        keep[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0))


def measure(texts: Sequence[str | None]) -> list[list]:
    """The columns above for a batch of texts."""
    rows = [word_bytes(t, lower=False) for t in texts]
    out: list[list] = [[] for _ in COLUMNS]
    for row, spans in zip(rows, find(rows)):
        best = max(spans, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in spans)
        values = [len(spans), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None]
        values += [hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(row, spans)).hexdigest()]
        for column, value in zip(out, values):
            column.append(value)
    return out


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns above."""
    return add_columns(docs, text, COLUMNS, lambda: measure)


def collapse(docs: DataFrame, text: str = "text", name: str = "collapsed") -> DataFrame:
    """docs with the texts without the repetitions of their runs, words joined by single spaces."""

    def shorten(texts: Sequence[str | None]) -> list[list[str]]:
        rows = [word_bytes(t, lower=False) for t in texts]
        return [[collapsed(row, spans).decode() for row, spans in zip(rows, find(rows))]]

    return add_columns(docs, text, {name: "string"}, lambda: shorten)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose texts end periodically where a hash of the id says so, for measuring how well runs are found.

    With h the crc32 of the id as text and g = h // 10, a text of n words whose h is a multiple of 10 goes on from
    word a = g % n by repeating the p = 1 + (n - a) // (3 + g % 8) words that stand there. Such a text becomes its
    words joined by single spaces. A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(held: Column) -> Column:
        n, g = F.size(held), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        body = F.slice(held, a + 1, p)
        times = F.array_repeat(body, F.ceil((n - a) / p).cast("int"))
        return F.array_join(F.slice(F.concat(F.slice(held, F.lit(1), a), F.flatten(times)), F.lit(1), n), " ")

    chosen = F.when(h % 10 == 0, words)
    made = F.transform(F.array(chosen), lambda held: F.when(F.size(held) > 0, repeated(held)))[0]
    return docs.withColumn(text, F.coalesce(made, F.col(text)))
