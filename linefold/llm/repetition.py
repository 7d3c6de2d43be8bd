"""Repetition rules from suffix arrays over the words of each text.

A batch of texts is ranked at once: words first, then prefixes of 2, 4, 8 ... words, where only suffixes
that still share their prefix with another of the same text are sorted again, inside the slots of their
group. Longest common prefixes of neighbours come from the same ranks, halving the step. Intervals of the
array whose common prefix is at least `min_words` are repeated substrings; each suffix's longest repeated
prefix is the greater of its two neighbours' values, and the union of those spans is what repeats cover.

A text is rejected when the base rules fail it, when repeats of `min_words` or more cover more than
`max_covered` of its words, or when its longest repeat exceeds `max_longest` words. Texts that are null,
empty or without words have zero counts and fail the base rules. Words are compared by a 64-bit hash.
Nothing is shuffled; other columns pass, and columns of the names made here are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from linefold.llm.common import add_columns, hash_words, word_bytes

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "covered_words": "long",
    "longest_repeat": "long",
    "n_repeats": "long",
}


@dataclass(frozen=True)
class Limits:
    min_words: int = 8
    max_covered: float = 0.4
    max_longest: int = 100


@dataclass
class SuffixArray:
    """Suffixes of all texts, text by text; lcp[k] is shared by the suffixes in slots k - 1 and k."""

    order: np.ndarray
    lcp: np.ndarray
    ends: np.ndarray  # where the text of each word ends


def suffix_array(words: np.ndarray, counts: np.ndarray) -> SuffixArray:
    n = len(words)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    by_word = np.argsort(words, kind="stable")
    # Stable by text after by word: the order is (text, word, place).
    order = by_word[np.argsort(text[by_word], kind="stable")]
    new = np.ones(n, dtype=bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, length = [rank], 1
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    while len(active):
        ahead = active + length
        inside = ahead < ends[active]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        group = rank[active]
        sort = np.argsort(group * (n + 1) + second + 1, kind="stable")
        active, group, second = active[sort], group[sort], second[sort]
        first = np.ones(len(active), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        begins = np.maximum.accumulate(np.where(first, np.arange(len(active)), 0))
        slots = group + np.arange(len(active)) - begins
        order[slots] = active
        split = first.copy()
        split[1:] |= second[1:] != second[:-1]
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(split, slots, 0))
        ranks.append(rank)
        length *= 2
        heads = np.flatnonzero(split)
        sizes = np.diff(np.append(heads, len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
    lcp = np.zeros(n + 1, dtype=np.int64)
    if n > 1:
        pairs = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
        p, q = order[pairs], order[pairs + 1]
        shared = np.zeros(len(pairs), dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            a, b = p + shared, q + shared
            inside = (a < ends[p]) & (b < ends[q])
            same = inside & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
            shared += same * (1 << level)
        lcp[pairs + 1] = shared
    return SuffixArray(order, lcp, ends)


def maximal_repeats(words: list, min_words: int) -> list[tuple[int, list[int]]]:
    """(length, starts) of every repeated run of words that can't grow to either side, for one text."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    symbols = np.array([ids[w] for w in words], dtype=np.uint64)
    array = suffix_array(symbols, np.array([len(words)]))
    found, stack = [], []  # open intervals: shared length, first slot
    for k in range(1, len(words) + 1):
        value, start = int(array.lcp[k]) if k < len(words) else 0, k - 1
        while stack and stack[-1][0] > value:
            length, start = stack.pop()
            starts = sorted(array.order[start:k].tolist())
            before = {words[s - 1] if s else None for s in starts}
            if length >= min_words and (len(before) > 1 or None in before):
                found.append((length, starts))
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, start))
    return sorted(found, key=lambda f: (-f[0], f[1]))


def measure(texts: list[str | None], limits: Limits = Limits()) -> list[np.ndarray | list]:
    """The columns above for a batch of texts."""
    texts = [t or "" for t in texts]
    words, counts = hash_words([word_bytes(t, lower=False) for t in texts])
    starts = np.cumsum(counts) - counts
    array = suffix_array(words, counts)
    n = len(words)
    longest = np.zeros(n, dtype=np.int64)
    longest[array.order] = np.maximum(array.lcp[:-1], array.lcp[1:]) if n else 0
    which = np.repeat(np.arange(len(texts)), counts)

    def covered(least: int, span: np.ndarray) -> np.ndarray:
        """Words of each text inside the union of spans of suffixes that repeat `least` words or more."""
        edge = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(longest >= least)
        edge[: n] += np.bincount(at, minlength=n)[:n]
        edge -= np.bincount(at + span[at], minlength=n + 1)
        return np.bincount(which[np.cumsum(edge)[:n] > 0], minlength=len(texts))

    repeat_words = covered(3, np.full(n, 3, dtype=np.int64))
    covered_words = covered(limits.min_words, longest)
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, which, longest)
    deep = array.lcp >= limits.min_words
    opens = np.flatnonzero(deep[1:] & ~deep[:-1])
    repeats = np.bincount(which[array.order[opens]], minlength=len(texts)) if n else np.zeros(len(texts), dtype=np.int64)

    chars = [len(t) - sum(t.count(c) for c in SPACES) for t in texts]
    symbols = [sum(t.count(c) for c in SYMBOLS) for t in texts]
    duplicates = []
    for t in texts:
        lines = [line for line in t.split("\n") if line.strip(SPACES)]
        duplicates.append(len(lines) - len(set(lines)))
    failed = (counts < 50) | (100 * repeat_words > 50 * counts)
    kept = ~failed & (covered_words <= limits.max_covered * counts) & (most <= limits.max_longest)
    return [counts, chars, symbols, duplicates, repeat_words, failed, kept, covered_words, most, repeats]


def judge(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """docs with the columns above."""
    return add_columns(docs, text, COLUMNS, lambda: lambda texts: measure(texts, limits))
