"""Encoding with the tokenizers library, each distinct word of a worker once.

The byte-level vocabulary cuts a text before its merges, and no cut piece reaches from a character
that isn't white space over a following blank or line feed. So where words are separated by single
blanks and lines by single line feeds, a text's ids are those of its words (each with the blank before
it) and line feeds in turn. Everything else (other white space, special tokens) goes to the library as
it stands.
"""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

#: Words in the store of a worker; beyond that a new one begins and only the last full one is kept with it.
STORE_WORDS = 500_000
#: Signs often found behind a word.
TAILS = ".,;:!?"
#: Words encoded in one call, separated by line feeds.
CALL_WORDS = 500

_WORKER: dict[str, WordEncoder] = {}


class WordEncoder:
    """ids as the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        pre = str(self.library.pre_tokenizer)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        feed = self._ids("\n")
        self.by_word = (
            "ByteLevel(add_prefix_space=False" in pre
            and "use_regex=True" in pre
            and self.library.normalizer is None
            and len(feed) == 1
        )
        self.feed = feed[0] if len(feed) else 0
        self.code = "H" if self.width == "<u2" else "I"
        self.by_word &= sys.byteorder == "little"
        if self.by_word:
            self.signs = self._signs()
            self.tails = {c: self._ids(c).tobytes() for c in TAILS}
            self.feed_bytes = feed.tobytes()

    @staticmethod
    def _signs() -> list[str]:
        """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
        plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
        free = iter(range(256, 512))
        return [chr(b if b in plain else next(free)) for b in range(256)]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.width)

    def _fill(self, words: set[str]) -> None:
        """Stores the ids of words not in the store; a word with a line feed ahead has no blank before it."""
        if len(self.store) + len(words) > STORE_WORDS:
            self.store, self.older = {}, self.store
        store, older = self.store, self.older
        rest, tailed = [], []
        for word in words:
            known = older.get(word)
            if known is not None:
                store[word] = known
                continue
            if word[-1] in TAILS and word[-2:-1].isalpha():
                tailed.append(word)
                word = word[:-1]
                if word in store or word in words:
                    continue
            body = word[1:] if word[:1] == "\n" else word
            if body.isalpha():
                store[word] = self._letters(body, "" if body is not word else " ")
            else:
                rest.append(word)
        self._joined(rest)
        for word in tailed:
            # A sign after a letter is cut from it before the merges.
            store[word] = store[word[:-1]] + self.tails[word[-1]]

    def _letters(self, body: str, blank: str) -> bytes:
        """ids of a word of letters alone: one piece for the merges, so the model takes it directly."""
        # ASCII letters stand for themselves.
        spelt = body if body.isascii() else "".join(map(self.signs.__getitem__, body.encode()))
        spelt = self.signs[32] + spelt if blank else spelt
        ids = array(self.code, [t.id for t in self.library.model.tokenize(spelt)]).tobytes()
        return ids if blank else self.feed_bytes + ids

    def _joined(self, new: list[str]) -> None:
        """ids of any words, many in one call, cut at the line feeds between them."""
        for led in (True, False):
            part = [w for w in new if (w[:1] == "\n") == led]
            lead = "" if led else "\n "
            calls = [part[a : a + CALL_WORDS] for a in range(0, len(part), CALL_WORDS)]
            texts = [lead + lead.join(c) for c in calls]
            for call, coded in zip(calls, self.library.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(coded.ids, dtype=self.width)
                cuts = np.flatnonzero(ids == self.feed)
                ends = [*cuts[1:].tolist(), len(ids)]
                raw, size, skip = ids.tobytes(), ids.itemsize, 0 if led else 1
                for word, a, b in zip(call, cuts.tolist(), ends):
                    self.store[word] = raw[(a + skip) * size : b * size]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text, as unsigned integers as wide as the vocabulary needs."""
        found: list[list | None] = []
        new: set[str] = set()
        gaps: list[tuple[list, list[int], list[str]]] = []
        for text in texts:
            words = self._words(text or "")
            if words is None:
                found.append(None)
                continue
            parts = list(map(self.store.get, words))
            if None in parts:
                empty = [k for k, part in enumerate(parts) if part is None]
                gaps.append((parts, empty, missing := [words[k] for k in empty]))
                new.update(missing)
            found.append(parts)
        self._fill(new)
        for parts, empty, missing in gaps:
            for k, word in zip(empty, missing):
                parts[k] = self.store[word]
        # The line feed put ahead of each text is one id.
        return [
            self._ids(text) if parts is None else np.frombuffer(b"".join(parts), dtype=self.width)[1:]
            for text, parts in zip(texts, found)
        ]

    def _words(self, text: str) -> list[str] | None:
        if not self.by_word or any(s in text for s in self.special):
            return None if text else []
        return led_words(text)


def led_words(text: str) -> list[str] | None:
    """Words if single blanks or line feeds separate them, the first of a line with its feed; else None.

    One line feed is put ahead of the text, so that its first word has no blank.
    """
    words = ("\n" + text.replace("\n", " \n")).split(" ") if text else []
    # Without empty words and bare feeds, other white space shows as a greater number of words.
    if "" in words or "\n" in words or len(text.split()) != len(words):
        return None
    return words


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker; a worker serves many tasks with it."""
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]
