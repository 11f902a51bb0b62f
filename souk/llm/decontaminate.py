"""Benchmark decontamination: pigeonhole edit matching.

A document leaks a test item if the item occurs in it within an error budget:
k = floor(``error_rate`` * length) edits (Levenshtein, the item whole, anywhere
in the document). Both are compared as lower-cased words joined by one space. An
item of fewer than ``least_chars`` characters has the same budget but must stand
at word bounds: the spaces around it are part of it.

Each item is cut into k + 1 pieces; k edits leave one piece whole, so every
occurrence has an exact piece hit. One Aho-Corasick automaton finds the hits of
all items' pieces in a pass over each whole document. The window around each
hit must hold all but k of the item's disjoint grams (an edit spoils at most one),
and is then verified with Myers' bit-parallel distance.

Documents are read in parallel and never shuffled. The items go to every task in
blocks of about ``block_chars`` characters, one pass over the documents for
each block; ``clean`` and ``leaks`` plan a pass for each block, so their broadcasts add up
to the items' size.

Defined results: null and empty texts and items match nothing; items with
equal text are each reported; repeated rows are matched each; null ids are kept;
other columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import id_text, map_text, texts_of

WORD = re.compile(r"\w+")
GRAM = 5


def normal(text: str) -> str:
    low = text.lower()
    if len(low) == len(text):
        return " ".join(WORD.findall(low))
    # a letter whose lower case has two code points: the words, and so the spans, stay those of the text
    return " ".join([w.lower() for w in WORD.findall(text)])


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 pieces."""
    cut = [round(len(item) * j / (k + 1)) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


class Pattern:
    """An item prepared for Myers' search."""

    def __init__(self, item: str, k: int):
        self.item, self.k = item, k
        self.bits: dict[str, int] = {}
        for i, c in enumerate(item):
            self.bits[c] = self.bits.get(c, 0) | 1 << i
        self.grams = [item[i:i + GRAM] for i in range(0, len(item) - GRAM + 1, GRAM)]

    def plausible(self, window: str) -> bool:
        """Whether all but k of the item's disjoint grams are in the window: an edit spoils one."""
        missing = 0
        for gram in self.grams:
            if gram not in window:
                missing += 1
                if missing > self.k:
                    return False
        return True

    def search(self, text: str) -> tuple[int, int]:
        """Smallest distance of the item to any part of ``text``, and the end of the first such."""
        m = len(self.item)
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, end = m, 0
        get = self.bits.get
        for at, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | ~(xh | up)
            mh = up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, at + 1
            ph = (ph << 1) & full
            mh = (mh << 1) & full
            up = (mh | ~(xv | ph)) & full
            down = ph & xv
        return best, end


class Matcher:
    """Finds items in normalised texts; ``items``: (item_id, text)."""

    def __init__(self, items: list[tuple], error_rate: float, least_chars: int):
        import ahocorasick

        self.ids, self.patterns = [], []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normal(text or "")
            if not item:
                continue
            k = int(len(item) * error_rate)
            if len(item) < least_chars:  # a short item is matched with the spaces around it
                item = f" {item} "
            for offset, piece in pieces(item, k):
                hits.setdefault(piece, []).append((len(self.ids), offset))
            self.ids.append(item_id)
            self.patterns.append(Pattern(item, k))
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        if hits:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Item -> joined windows of ``text`` that hold all its possible occurrences."""
        starts: dict[int, set[int]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for item, offset in places:
                starts.setdefault(item, set()).add(last + 1 - length - offset)
        out = {}
        for item, at in starts.items():
            p = self.patterns[item]
            joined: list[list[int]] = []
            for s in sorted(at):
                lo, hi = max(0, s - p.k), min(len(text), s + len(p.item) + p.k)
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(hi, joined[-1][1])
                else:
                    joined.append([lo, hi])
            out[item] = joined
        return out

    def find(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of every item in a normalised text."""
        found = []
        if not self.ids or not text:
            return found
        text = f" {text} "
        for item, windows in sorted(self.windows(text).items()):
            p = self.patterns[item]
            best = None
            for lo, hi in windows:
                window = text[lo:hi]
                if hi - lo < len(p.item) - p.k or not p.plausible(window):
                    continue
                distance, end = p.search(window)
                if distance <= p.k and (best is None or distance < best[0]):
                    best = (distance, lo, lo + end)
            if best:
                distance, lo, end = best
                mirror = Pattern(p.item[::-1], p.k)
                _, back = mirror.search(text[lo:end][::-1])
                found.append((item, distance, max(0, end - back - 1), min(end - 1, len(text) - 2)))
                if first_only:
                    break
        return found


def _original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` that hold the normalised positions [start, end)."""
    at, low, high = 0, None, len(text)
    for m in WORD.finditer(text):
        size = len(m.group().lower())
        if low is None and at + size > start:
            low = m.start()
        if at < end:
            high = m.end()
        else:
            break
        at += size + 1
    return low or 0, high


def item_blocks(items: DataFrame, block_chars: int) -> int:
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // block_chars))


def block(items: DataFrame, n: int, of: int) -> list[tuple]:
    """The items of block ``n``: about ``block_chars`` characters come to the driver."""
    rows = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(of)) == n) if of > 1 else items
    return sorted(((r["item_id"], r["text"]) for r in rows.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def leaks(docs: DataFrame, items: DataFrame, error_rate: float = 0.1, least_chars: int = 32, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, distance, start, end (code points of the text) of every leak: the best
    occurrence of each item in each document."""
    of = item_blocks(items, block_chars)
    spark = docs.sparkSession

    def one(n: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(block(items, n, of))

        def step():
            matcher = Matcher(shared.value, error_rate, least_chars)

            def of_batch(batch):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                    for item, distance, start, end in matcher.find(normal(text)):
                        rows.append((doc_id, matcher.ids[item], distance, *_original_span(text, start, end)))
                names = ("doc_id", "item_id", "distance", "start", "end")
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                return {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds))}
            return of_batch
        return map_text(id_text(docs), "doc_id long, item_id long, distance int, start int, end int", step)
    return reduce(DataFrame.unionByName, [one(n) for n in range(of)])


def clean(docs: DataFrame, items: DataFrame, error_rate: float = 0.1, least_chars: int = 32, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    at = docs.columns.index("text")
    of = item_blocks(items, block_chars)
    spark, schema = docs.sparkSession, docs.schema

    def one(rows: DataFrame, n: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(block(items, n, of))

        def step():
            matcher = Matcher(shared.value, error_rate, least_chars)

            def of_batch(batch):
                keep = [not matcher.find(normal(t), first_only=True) for t in texts_of(batch.column(at).cast(pa.binary()))]
                return batch.filter(pa.array(keep, pa.bool_()))
            return of_batch
        return map_text(rows, schema, step)
    return reduce(one, range(of), docs)
