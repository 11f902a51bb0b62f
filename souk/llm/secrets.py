"""Secret scans: probabilistic automata of credential formats, inferred from labelled ones.

Labelled credentials are the values that the base patterns find in a bounded
sample of documents. They go into a prefix tree with counts; states whose
outgoing frequencies agree within the Hoeffding bound are merged (red-blue
order), which leaves a small probabilistic automaton of the formats. A second
automaton is learned the same way from ordinary tokens of the sample, without those
that the credentials' automaton prefers: credentials no base pattern knows are among
them. Every candidate token of every text is scored by its log2 likelihood under both;
it is a secret if the likelihood ratio is over 2^``least_bits`` and its bits a character
in favour of the credentials are over half of what nearly all labelled credentials
kept out of the fit reach. Base spans always stay; a candidate that overlaps one is not added.

Defined results: null text has no spans; without labelled credentials no spans
are added; overlapping spans of different kinds are all reported, and redacted
as one; repeated rows give a row each; a null doc_id is kept; other columns are
ignored by ``scan`` and carried along by ``redact``; empty tables give empty
tables. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import hash_below, id_text, map_text, texts_of

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_CHARS = 16
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST_CHARS},}}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
SPANS = "array<struct<kind:string,start:int,end:int>>"
REDACTED = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, value) by start, then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


# -------------------------------------------------------------------- automata
def symbol(c: str) -> tuple[str, int]:
    """Class of a character and the class's size."""
    if "0" <= c <= "9":
        return "9", 10
    if "a" <= c <= "f":
        return "a", 6
    if "A" <= c <= "F":
        return "A", 6
    if "g" <= c <= "z":
        return "z", 20
    if "G" <= c <= "Z":
        return "Z", 20
    return c, 1


SYMBOLS = {chr(i): symbol(chr(i)) for i in range(33, 127)}
N_SYMBOLS = 5 + len("+/_.=-")


class Automaton:
    """States as [arrivals, ends, {class: (next state, count)}]; state 0 starts."""

    def __init__(self, words: list[str], alpha: float = 0.01):
        self.states: list[list] = [[0, 0, {}]]
        for word in words:
            at = 0
            self.states[0][0] += 1
            for c in word:
                k = SYMBOLS[c][0]
                after, n = self.states[at][2].get(k, (len(self.states), 0))
                if not n:
                    self.states.append([0, 0, {}])
                self.states[at][2][k] = (after, n + 1)
                at = after
                self.states[at][0] += 1
            self.states[at][1] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            if a == b:
                continue
            (na, fa, ea), (nb, fb, eb) = self.states[a], self.states[b]
            if self._differ(na, fa, nb, fb):
                return False
            for k in set(ea) | set(eb):
                (ta, ca), (tb, cb) = ea.get(k, (-1, 0)), eb.get(k, (-1, 0))
                if self._differ(na, ca, nb, cb):
                    return False
                if ca and cb:
                    pairs.append((ta, tb))
        return True

    def _fold(self, red: int, blue: int) -> None:
        pairs = [(red, blue)]
        while pairs:
            red, blue = pairs.pop()
            if red == blue:
                continue
            self.states[red][0] += self.states[blue][0]
            self.states[red][1] += self.states[blue][1]
            for k, (tb, cb) in self.states[blue][2].items():
                if k in self.states[red][2]:
                    ta, ca = self.states[red][2][k]
                    self.states[red][2][k] = (ta, ca + cb)
                    pairs.append((ta, tb))
                else:
                    self.states[red][2][k] = (tb, cb)

    def _merge_all(self) -> None:
        red, edges = [0], [(0, k) for k in sorted(self.states[0][2])]
        while edges:
            # the most travelled edge that leaves the red states
            edges.sort(key=lambda e: (self.states[e[0]][2][e[1]][1], e))
            at, k = edges.pop()
            blue, n = self.states[at][2][k]
            if blue in red:
                continue
            for r in red:
                if self._compatible(r, blue):
                    self.states[at][2][k] = (r, n)
                    self._fold(r, blue)
                    break
            else:
                red.append(blue)
            edges = [(r, s) for r in red for s, (t, _) in sorted(self.states[r][2].items()) if t not in red]
        place = {r: i for i, r in enumerate(red)}
        self.states = [[n, f, {k: (place[t], c) for k, (t, c) in e.items()}] for n, f, e in (self.states[r] for r in red)]

    def tables(self) -> list[dict]:
        """For each state, class -> (next state, log2 probability of one character), "" -> end.
        Unseen classes get a smoothed probability and lead back to the start."""
        out = []
        for n, f, edges in self.states:
            total = n + 0.5 * (N_SYMBOLS + 1)
            row = {"": (0, math.log2((f + 0.5) / total)), None: (0, math.log2(0.5 / total / 10))}
            for k, (t, c) in edges.items():
                row[k] = (t, c)
            for c, (k, size) in SYMBOLS.items():
                t, count = edges.get(k, (0, 0))
                row[c] = (t, math.log2((count + 0.5) / total / size))
            out.append(row)
        return out


def bits(tables: list[dict], word: str) -> float:
    """log2 likelihood of the word."""
    state, total = 0, 0.0
    for c in word:
        row = tables[state]
        state, gain = row.get(c) or row[None]
        total += gain
    return total + tables[state][""][1]


def margin(model: dict, word: str) -> float:
    """Bits a character in favour of a credential."""
    return (bits(model["secret"], word) - bits(model["ordinary"], word)) / len(word)


# ------------------------------------------------------------------- operator
def fit(secret: list[str], ordinary: list[str], secret_quantile: float = 0.02, rounds: int = 8) -> dict:
    """Both automata and the level. A quarter of the credentials, by hash, is kept out of the fit
    and gives the level; ordinary words that the credentials' automaton prefers are left out of theirs."""
    held = [w for w in secret if zlib.crc32(b"held" + w.encode()) % 4 == 0]
    learned = [w for w in secret if zlib.crc32(b"held" + w.encode()) % 4]
    model = {"secret": Automaton(learned or secret).tables()}
    # words too short for a candidate know least of the credentials that lie among the others
    kept = [w for w in ordinary if len(w) < LEAST_CHARS] or ordinary
    for _ in range(rounds):
        model["ordinary"] = Automaton(kept or ["word"]).tables()
        last, kept = kept, [w for w in ordinary if margin(model, w) <= 0]
        if kept == last:
            break
    reach = float(np.quantile([margin(model, w) for w in held or secret], secret_quantile))
    return model | {"level": max(0.0, reach / 2)}


def learn(docs: DataFrame, sample_docs: int = 20_000, most_words: int = 4000, secret_quantile: float = 0.02,
          least_bits: float = 16.0) -> dict | None:
    """Both automata and the levels, from about ``sample_docs`` whole documents chosen by a
    hash of doc_id; ``most_words`` words of each sort at most come to the fit."""
    rows = docs.filter(hash_below("secrets", sample_docs / max(1, docs.count())))

    def gather(batches):
        secret: set[str] = set()
        ordinary: set[str] = set()
        for batch in batches:
            for text in texts_of(batch.column(1)):
                spans = base_spans(text)
                secret.update(value for *_, value in spans)
                for start, _, end, _ in spans[::-1]:
                    text = text[:start] + " " + text[end:]
                ordinary.update(ORDINARY.findall(text))
        for sort, words in ((1, secret), (0, ordinary)):
            chosen = sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:most_words]
            yield pa.RecordBatch.from_pydict({"sort": pa.array([sort] * len(chosen), pa.int32()), "word": pa.array(chosen, pa.string())})
    words = id_text(rows).mapInArrow(gather, "sort int, word string").distinct()
    found = {1: [], 0: []}
    for sort in found:
        top = words.filter(F.col("sort") == sort).orderBy(F.crc32("word"), "word").limit(most_words)
        found[sort] = sorted(r["word"] for r in top.collect())
    if not found[1]:
        return None
    return fit(found[1], found[0], secret_quantile) | {"least_bits": least_bits}


def all_spans(text: str, model: dict | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of base and added spans, by start, then kind."""
    base = base_spans(text)
    spans = [(start, kind, end) for start, kind, end, _ in base]
    if model:
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            if any(s < end and start < e for s, _, e, _ in base):
                continue
            if margin(model, m.group()) > max(model["level"], model["least_bits"] / (end - start)):
                spans.append((start, 3, end))
    return sorted(spans)


def scan(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, spans (kind, start, end; by start, then kind) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step():
        formats = shared.value

        def of(batch):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t, formats)] for t in texts_of(batch.column(1))]
            kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            return {"doc_id": batch.column(0), "spans": pa.array(spans, pa.list_(kind))}
        return of
    return map_text(id_text(docs), f"doc_id long, spans {SPANS}", step)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with each secret of the text replaced; ``n_chars``, if there, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def step():
        formats = shared.value

        def of(batch):
            column = batch.column(at)
            texts = texts_of(column.cast(pa.binary()))
            spans = [all_spans(t, formats) for t in texts]
            if not any(spans):
                return batch
            columns = list(batch.columns)
            clean = [redact_text(t, s) if s else t for t, s in zip(texts, spans)]
            known = column.is_valid().to_pylist()
            columns[at] = pa.array([t if v else None for t, v in zip(clean, known)], column.type)
            if size_at is not None:
                old = columns[size_at]
                columns[size_at] = pa.array([len(t) if s else n for t, s, n in zip(clean, spans, old.to_pylist())], old.type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        return of
    return map_text(docs, docs.schema, step)
