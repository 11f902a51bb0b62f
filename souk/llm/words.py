"""Token ids of many texts by their distinct words.

A tokenizer whose tokens never cross a word gives a text the ids of its words in
turn. A slice's words are coded by Arrow; only words that the Python worker has
not met before are encoded, and the slice's ids are gathered from the table in
numpy. The table keeps the first ``kept`` words of up to ``kept_chars`` characters, which
the frequent ones are among; longer and later words live for their slice.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

MARKS = ".,;:!?|#*$%&"


def byte_alphabet() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: printable Latin-1 as it
    is, the others from U+0100 on in byte order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def letters_and_marks(word: str) -> tuple[str, str] | None:
    """A word of letters (up to U+017F, whose class and case all Unicode versions share) and the
    marks that end it; None for any other word."""
    core = word.rstrip(MARKS)
    if core.isalpha() and (core.isascii() or (max(core) < "ƀ" and "İ" not in core)):
        return core, word[len(core):]
    return None


class WordTable:
    """``encode`` gives the ids of each of a list of words."""

    def __init__(self, encode: Callable[[list[str]], list], kept: int = 700_000, kept_chars: int = 40):
        self.encode, self.kept, self.kept_chars = encode, kept, kept_chars
        self.row: dict[str, int] = {}
        self.flat, self.start, self.size = array("I"), array("q"), array("q")

    def known(self, word: str) -> list[int] | None:
        """The ids of a word that is in the table."""
        r = self.row.get(word)
        return None if r is None else self.flat[self.start[r]:self.start[r] + self.size[r]].tolist()

    def add(self, words: list[str]) -> None:
        for ids in self.encode(words):
            self.start.append(len(self.flat))
            self.size.append(len(ids))
            self.flat.extend(ids)

    def ids(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each list of words, and all ids in turn."""
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = list(map(self.row.get, distinct))
        # long words go last: they leave the table after the slice
        new = sorted((w for w, r in zip(distinct, rows) if r is None), key=len) if None in rows else []
        before = len(self.size)
        self.add(new)
        fresh = dict(zip(new, range(before, len(self.size))))
        row = np.array([fresh[w] if r is None else r for w, r in zip(distinct, rows)], np.int64)
        row = row[coded.indices.to_numpy()]
        counts, ids = self._gather(row, words.offsets.to_numpy())
        stay = next((n for n, w in enumerate(new) if len(w) > self.kept_chars), len(new))
        stay = max(0, min(stay, self.kept - before))
        self.row.update((w, fresh[w]) for w in new[:stay])
        if stay < len(new):
            del self.flat[self.start[before + stay]:], self.start[before + stay:], self.size[before + stay:]
        return counts, ids

    def _gather(self, row: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(row):
            return np.zeros(len(offsets) - 1, np.int64), np.empty(0, np.uint32)
        size = np.frombuffer(self.size, np.int64)[row]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat(np.frombuffer(self.start, np.int64)[row] - ends[:-1], size)
        ids = np.frombuffer(self.flat, np.uint32)[at] if len(at) else np.empty(0, np.uint32)
        return np.diff(ends[offsets - offsets[0]]), ids


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ids with ``end_id`` after each text's ids."""
    counts = counts + 1
    out = np.full(int(counts.sum()), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts) - 1] = False
    out[keep] = ids
    return counts, out
