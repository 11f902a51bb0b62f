"""Language identification by cross-parsing entropy.

Learning text of each language (labelled rows, the beginnings of a bounded sample
of documents, evenly) becomes a suffix automaton. A text is parsed against each automaton
into the fewest consecutive phrases such that each is the longest match found
in that language's learning text; a character the language lacks is a phrase of
its own. Cross-entropy of a language: phrases * log2(learning length) / length;
the smallest wins, ties go to the first language in alphabetical order.

Texts are read whole: lower-cased, every run of characters that are no letters
as one space. The parse starts a new phrase every ``LANE`` characters, so that
many pieces of many texts go through the automata side by side in numpy.

Defined results: a text that is null or has no letter is ``und`` with score 0;
no learning rows at all: every text is ``und``; one language: its score is 1;
labels that are null are not learned from; a null doc_id is in no held-out part
and not learned from; repeated rows give a row each; other columns are ignored.
Score: 1 - smallest / second smallest cross-entropy, 0 (a tie) to 1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import label_part, labelled_sample, map_text, slices, texts_of

LANE = 512
PAD, SPACE, OTHER = 0, 1, 2


#: Cells of a language's dense transition table at most (beyond: sorted edges, the same moves).
DENSE = 1 << 22


class Automata:
    """Transitions of the languages' suffix automata.

    Every learned letter has a class. ``local[language][class]`` is the class among the
    language's own letters, ``OTHER`` for those it lacks. Dense tables:
    ``step[language][state * width + local]`` is ``4 * width * next + phrases``: the next
    state (premultiplied) and how many phrases ended. Sparse ones, where an alphabet is
    large: (width, sorted keys ``state * width + local``, next states, moves of the start).
    """

    def __init__(self, texts: dict[str, str], dense: int = DENSE):
        self.languages = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t.lower() if c.isalpha()})
        self.classes = np.full(0x110000, SPACE, np.int32)
        for code in range(0x110000):
            if chr(code).isalpha():
                self.classes[code] = OTHER
        for n, letter in enumerate(letters):
            self.classes[ord(letter)] = 3 + n
        self.length, self.local, self.step = {}, [], []
        for language in self.languages:
            chars, _ = self.read([texts[language]])
            self.length[language] = max(2, len(chars))
            own = np.unique(chars[chars > OTHER])
            local = np.full(3 + len(letters), OTHER, np.int32)
            local[[PAD, SPACE]] = PAD, SPACE
            local[own] = 3 + np.arange(len(own))
            self.local.append(local)
            edges, width = _suffix_automaton(local[chars].tolist()), 3 + len(own)
            self.step.append(self._table(edges, width) if len(edges) * width <= dense else self._sparse(edges, width))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all kept characters, and the text each belongs to."""
        low = [t.lower() for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
        chars = self.classes[codes]
        keep = chars != SPACE
        keep[1:] |= (chars[:-1] != SPACE) & (owner[1:] == owner[:-1])
        return chars[keep], owner[keep]

    def _table(self, edges: list[dict[int, int]], width: int) -> np.ndarray:
        table = np.empty((len(edges), width), np.int64)
        for state, out in enumerate(edges):
            row = np.full(width, 2 if state else 1)  # a class unknown to the language: back to the start
            for c, after in edges[0].items():
                row[c] = 4 * width * after + 1  # the phrase ends, the next starts with c
            for c, after in out.items():
                row[c] = 4 * width * after
            row[PAD] = 4 * width * state
            table[state] = row
        return table.astype(np.int32 if table.max() < 2**31 else np.int64).ravel()

    def _sparse(self, edges: list[dict[int, int]], width: int) -> tuple:
        found = sorted((state * width + c, after) for state, out in enumerate(edges) for c, after in out.items())
        keys, after = np.array(found or [(-1, 0)], np.int64).T.copy()
        start = np.zeros(width, np.int64)
        start[list(edges[0])] = list(edges[0].values())
        return width, keys, after, start

    def _phrases(self, step: np.ndarray | tuple, grid: np.ndarray) -> np.ndarray:
        """Phrases of each lane (columns of ``grid``, in the language's classes)."""
        phrases = np.zeros(grid.shape[1], np.int32)
        if isinstance(step, np.ndarray):
            state = np.zeros(grid.shape[1], step.dtype)
            for column in grid:
                move = step[state + column]
                phrases += move & 3
                state = move >> 2
        else:
            width, keys, after, start = step
            state = np.zeros(grid.shape[1], np.int64)
            for column in grid:
                key = state * width + column
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ends = (keys[at] != key) & (column != PAD)
                anew = start[column]
                phrases += ends
                phrases += ends & (anew == 0) & (state != 0)  # a class unknown to the language
                state = np.where(ends, anew, np.where(column == PAD, state, after[at]))
        return phrases + (state != 0)  # the one open at the end

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy of each text (rows) by each language (columns); nan without letters."""
        chars, owner = self.read(texts)
        size = np.bincount(owner, minlength=len(texts))
        lanes = -(-size // LANE)
        first_lane = np.cumsum(lanes) - lanes
        at = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
        lane = first_lane[owner] + at // LANE
        grid = np.zeros((LANE, int(lanes.sum())), np.int32)
        grid[at % LANE, lane] = chars
        lane_owner = np.repeat(np.arange(len(texts)), lanes)
        result = np.full((len(texts), len(self.languages)), np.nan)
        lettered = np.bincount(owner, weights=chars >= OTHER, minlength=len(texts)) > 0
        for n, (language, step) in enumerate(zip(self.languages, self.step)):
            phrases = self._phrases(step, self.local[n][grid])
            total = np.bincount(lane_owner, weights=phrases, minlength=len(texts))
            bits = math.log2(self.length[language])
            result[lettered, n] = total[lettered] * bits / size[lettered]
        return result


def _suffix_automaton(chars: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``chars``."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in chars:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


def _even(texts: list[str], most: int) -> str:
    """The beginnings of all texts, chained, in ``most`` characters; short texts are whole."""
    left, taken = most + 1, {}
    for n, at in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        taken[at] = min(len(texts[at]), max(0, left // (len(texts) - n) - 1))
        left -= taken[at] + 1
    return " ".join(texts[i][:taken[i]] for i in range(len(texts)))


def learn(labelled: DataFrame, docs_per_language: int = 64, chars_per_language: int = 24_000) -> Automata:
    """Automata from ``labelled`` (doc_id, text, lang): at most about ``docs_per_language``
    documents of each language come to the driver, and ``chars_per_language`` characters
    of them are learned: of each document an equal share from its beginning, what short
    ones leave of theirs going to the others."""
    rows = labelled.filter("doc_id is not null and lang is not null").select("doc_id", "lang", "text")
    total = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    rows = labelled_sample(rows, "lang", docs_per_language, total).select(
        "lang", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id").alias("h"))
    chains: dict[str, list[str]] = {}
    for row in sorted(rows.collect(), key=lambda r: (r["lang"], r["h"], bytes(r["text"] or b""))):
        text = bytes(row["text"] or b"").decode("utf-8", "replace")
        if any(c.isalpha() for c in text):
            chains.setdefault(row["lang"], []).append(text)
    return Automata({lang: _even(texts, chars_per_language) for lang, texts in chains.items()})


def identify(docs: DataFrame, automata: Automata) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(automata))  # bounded by languages * chars_per_language

    def step():
        models = Automata.__new__(Automata)
        vars(models).update(shared.value)

        def of(batch):
            names, scores = [], []
            for part in slices([batch], 1_500_000):
                texts = texts_of(part.column(1))
                if not models.languages:
                    names += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                for row in models.entropies(texts):
                    if np.isnan(row[0]):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(np.argmin(row))
                    rest = np.delete(row, best)
                    names.append(models.languages[best])
                    scores.append(float(1 - row[best] / rest.min()) if len(rest) else 1.0)
            return {"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
        return of
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_text(rows, "doc_id long, lang_pred string, score double", step)


def identify_all(docs: DataFrame, parts: int = 4, held_out: int = 2, **learning) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside part ``held_out``."""
    part = label_part("doc_id", parts)
    automata = learn(docs.filter(part != held_out), **learning)
    return identify(docs, automata).select("doc_id", F.coalesce(label_part("doc_id", parts) == held_out, F.lit(False)).alias("held_out"),
                                           "lang_pred", "score")
