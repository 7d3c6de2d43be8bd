"""Byte-level BPE as a reduction over a tree: halves are encoded on their own and joined.

Encoding a match of the split pattern: its bytes are halved down to single bytes; two neighbours are
joined by encoding a window of tokens around their border anew, growing it until the tokens outside are
stable. That is decided pair by pair: tokens x, y next to each other are stable if merging their bytes
gives x, y again. Merges inside a run of tokens happen in the same order whether or not more bytes stand
beside it, so the first merge over a border would also happen with the two tokens alone; a sequence whose
neighbouring pairs are all stable is therefore the encoding of its bytes, and joining is associative.

Decoding concatenates the bytes of both halves up the same tree.

A null text counts as empty: no ids, no bytes. Texts of any length work; a match of n bytes takes about
n log n steps. Stores of words, joins and windows are bounded. Other columns pass.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import regex
from pyspark.sql import DataFrame

from linefold.llm.common import add_columns
from linefold.llm.encoder import led_words

#: Entries kept in each store of a worker.
STORE_WORDS = 300_000
STORE_JOINS = 500_000

COLUMNS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

_WORKER: dict[tuple[str, str], TreeBPE] = {}


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # White space as Unicode defines it, so that control characters are not part of it.
        pattern = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(pattern)
        self.width = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
        self.pairs: dict[tuple[int, int], bool] = {}
        self.trees: dict[bytes, tuple[int, ...]] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> TreeBPE:
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The least-rank pair, leftmost first, until no pair has a rank; for windows of few tokens."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            least, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def stable(self, x: int, y: int) -> bool:
        known = self.pairs.get((x, y))
        if known is None:
            if len(self.pairs) >= STORE_JOINS:
                self.pairs.clear()
            known = self.pairs[x, y] = self.merge(self.bytes[x] + self.bytes[y]) == (x, y)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours from their own encodings."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = b"".join(self.bytes[i] for i in left[len(left) - a :] + right[:b])
            middle = self.merge(window)
            left_ok = a == len(left) or self.stable(left[len(left) - a - 1], middle[0])
            right_ok = b == len(right) or self.stable(middle[-1], right[b])
            if left_ok and right_ok:
                return left[: len(left) - a] + middle + right[b:]
            if not left_ok:
                a = min(len(left), 2 * a)
            if not right_ok:
                b = min(len(right), 2 * b)

    def tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= 1:
            return (self.single[data[0]],) if data else ()
        known = self.trees.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= 16:
                if len(self.trees) >= STORE_JOINS:
                    self.trees.clear()
                self.trees[data] = known
        return known

    def match(self, data: bytes) -> tuple[int, ...]:
        """ids of one match of the split pattern; a match that is a token is that token."""
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.tree(data)

    def pieces(self, text: str) -> bytes:
        ids = [i for m in self.split.findall(text) for i in self.match(m.encode())]
        return np.array(ids, dtype=self.width).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """ids of a text. Single blanks end a match, so words are looked up in the worker's store."""
        words = led_words(text or "")
        if words is None:
            return np.frombuffer(self.pieces(text), dtype=self.width)
        out, store = [], self.words
        for word in words:
            known = store.get(word)
            if known is None:
                if len(store) >= STORE_WORDS:
                    store.clear()
                known = store[word] = self.pieces(word if word[:1] == "\n" else " " + word)
            out.append(known)
        # The line feed put ahead of the text is one id.
        return np.frombuffer(b"".join(out), dtype=self.width)[1:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def coder(path: str, pattern: str) -> TreeBPE:
    """The coder of this worker; a worker serves many tasks with it."""
    if (path, pattern) not in _WORKER:
        _WORKER[path, pattern] = TreeBPE.load(path, pattern)
    return _WORKER[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with the number of ids, the hash of the ids and the hash of the bytes decoded from them."""

    def make():
        bpe = coder(path, pattern)

        def digests(texts: list[str | None]) -> list[list]:
            counts, of_ids, of_bytes = [], [], []
            for body in texts:
                ids = bpe.encode(body)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
            return [counts, of_ids, of_bytes]

        return digests

    return add_columns(docs, text, COLUMNS, make)


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with `ids`: little-endian unsigned 32-bit integers."""

    def make():
        bpe = coder(path, pattern)
        return lambda texts: [[bpe.encode(t).astype("<u4").tobytes() for t in texts]]

    return add_columns(docs, text, {"ids": "binary"}, make)


def decoded(coded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Rows with `decoded`: the bytes of their ids; a null counts as no ids."""

    def make():
        bpe = coder(path, pattern)
        return lambda rows: [[bpe.decode(np.frombuffer(r or b"", dtype="<u4").tolist()) for r in rows]]

    return add_columns(coded, ids, {"decoded": "binary"}, make)
