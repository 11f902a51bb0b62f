"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages (64 words each, all of the text). Every passage
is encoded from its characters and words (shares of each character class, word
lengths, share of distinct and of repeated words), a tanh layer embeds it, and
gated attention, w . (tanh(U h) * sigmoid(G h)), soft-maxed over the document,
weighs the passages; the weighted sum is scored by a logistic unit. Encoder
layer, attention and output are learned together from document labels.

The fit is bounded: at most about ``per_class`` documents of each label value,
chosen by a hash of doc_id, their whole texts; rows are weighted back to the
label values' shares. Scoring goes over every row.

Defined results: null and empty texts are one passage without words, scored like
any other; with labels of one value only, or none, every score is that value's
share (0.5 without labels); repeated rows give a row each; a null doc_id is never
learned from and not held out; other columns are ignored; empty tables give
empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import id_text, label_part, labelled_sample, map_text, slices

PASSAGE_WORDS = 64
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# byte -> class: 0 white space, 1 line break, 2 lower, 3 upper, 4 digit, 5 other, 6.. each mark
CLASSES = 6 + len(MARKS)
EXTRA = 7
WIDTH = CLASSES + EXTRA
PRIME = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2 ** 64


def byte_classes() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    table[list(b"\x20\x09\x0b\x0c\x0d")] = 0
    table[ord("\n")] = 1
    table[ord("a"):ord("z") + 1] = 2
    table[ord("A"):ord("Z") + 1] = 3
    table[ord("0"):ord("9") + 1] = 4
    for n, mark in enumerate(MARKS):
        table[mark] = 6 + n
    return table


def passages(texts: list[bytes], words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and how many passages each text has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    kind = byte_classes()[data]
    owner = np.repeat(np.arange(len(texts)), sizes)
    solid = kind > 1
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | (owner[1:] != owner[:-1])
    start = np.flatnonzero(begins)
    n_words = np.bincount(owner[start], minlength=len(texts))
    count = np.maximum(1, -(-n_words // words))
    first = np.cumsum(count) - count
    place = np.arange(len(start)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage_of_word = first[owner[start]] + place // words
    total = int(count.sum())
    # a byte belongs to the passage of the last word begun in its text
    last_word = np.cumsum(begins) - 1
    inside = (last_word >= 0) & (owner[start[np.maximum(last_word, 0)]] == owner) if len(start) else np.zeros(len(data), bool)
    passage_of_byte = np.where(inside, passage_of_word[np.maximum(last_word, 0)] if len(start) else 0, first[owner] if len(data) else 0)
    shares = np.bincount(passage_of_byte * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float64)
    n_bytes = shares.sum(axis=1)
    features = np.zeros((total, WIDTH), np.float32)
    features[:, :CLASSES] = shares / np.maximum(1, n_bytes)[:, None]
    if len(start):
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | (owner[1:] != owner[:-1])
        end = np.flatnonzero(ends) + 1
        # a word's code: the sum of its bytes times powers of PRIME, modulo 2 ** 64
        offset = np.where(solid, np.arange(len(data)) - start[np.maximum(last_word, 0)], 0)
        power = np.cumprod(np.full(int((end - start).max()), PRIME, np.uint64))
        value = np.cumsum(np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * power[offset], np.uint64(0)))
        code = value[end - 1] - np.where(start > 0, value[start - 1], np.uint64(0))
        per = np.maximum(1, np.bincount(passage_of_word, minlength=total))
        order = np.lexsort((code, passage_of_word))
        new = np.ones(len(order), bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (passage_of_word[order][1:] != passage_of_word[order][:-1])
        length = end - start
        same = np.zeros(len(start), bool)
        same[1:] = (code[1:] == code[:-1]) & (passage_of_word[1:] == passage_of_word[:-1])
        last = kind[end - 1]
        only = np.bincount(passage_of_word, weights=length == 1, minlength=total)
        for n, v in enumerate((
                np.bincount(passage_of_word, weights=np.minimum(length, 40), minlength=total) / per / 10,
                np.bincount(passage_of_word, weights=np.minimum(length, 40) ** 2, minlength=total) / per / 100,
                np.bincount(passage_of_word[order], weights=new, minlength=total) / per,
                np.bincount(passage_of_word, weights=same, minlength=total) / per,
                np.bincount(passage_of_word, weights=last > 5, minlength=total) / per,
                only / per,
                np.bincount(passage_of_word, minlength=total) / words)):
            features[:, CLASSES + n] = v
    return features, count


# ---------------------------------------------------------------------- model
def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: dict, x: np.ndarray, count: np.ndarray) -> dict:
    """Scores of the bags, and what the backward pass needs."""
    start = np.cumsum(count) - count
    bag = np.repeat(np.arange(len(count)), count)
    h = np.tanh((x - m["mean"]) / m["std"] @ m["V"] + m["b"])
    t, g = np.tanh(h @ m["U"]), _sigmoid(h @ m["G"])
    e = (t * g) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, start)[bag])
    a = e / np.add.reduceat(e, start)[bag]
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return {"bag": bag, "start": start, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ m["c"] + m["d"])}


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 24, gates: int = 12,
        epochs: int = 30, batch: int = 128, rate: float = 0.01, ridge: float = 1e-4) -> dict:
    """Adam on the weighted logistic loss; the same rows give the same model."""
    rng = np.random.default_rng(0)
    m = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 0.01,
         "V": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b": np.zeros(hidden),
         "U": rng.normal(0, hidden ** -0.5, (hidden, gates)), "G": rng.normal(0, hidden ** -0.5, (hidden, gates)),
         "w": rng.normal(0, gates ** -0.5, gates), "c": rng.normal(0, hidden ** -0.5, hidden), "d": np.zeros(1)}
    learned = [k for k in m if k not in ("mean", "std")]
    first, second = ({k: np.zeros_like(m[k]) for k in learned} for _ in range(2))
    offset = np.cumsum(count) - count
    steps = 0
    for _ in range(epochs):
        order = rng.permutation(len(count))
        for at in range(0, len(order), batch):
            bags = order[at:at + batch]
            n = count[bags]
            rows = np.repeat(offset[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            xb = x[rows]
            f = forward(m, xb, n)
            d_score = (f["score"] - y[bags]) * weight[bags] / weight[bags].sum()
            grad = {"c": f["z"].T @ d_score, "d": np.array([d_score.sum()])}
            dz = d_score[:, None] * m["c"]
            h, a, bag = f["h"], f["a"], f["bag"]
            da = (dz[bag] * h).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, f["start"])[bag])
            grad["w"] = (f["t"] * f["g"]).T @ de
            dt = de[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2)
            dg = de[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
            grad["U"], grad["G"] = h.T @ dt, h.T @ dg
            dh = (a[:, None] * dz[bag] + dt @ m["U"].T + dg @ m["G"].T) * (1 - h ** 2)
            grad["V"], grad["b"] = ((xb - m["mean"]) / m["std"]).T @ dh, dh.sum(axis=0)
            steps += 1
            for k in learned:
                g = grad[k] + ridge * m[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] = m[k] - rate * (first[k] / (1 - 0.9 ** steps)) / (np.sqrt(second[k] / (1 - 0.999 ** steps)) + 1e-8)
    return m


def learn(docs: DataFrame, labels: DataFrame, parts: int, held_out: int, per_class: int = 4000) -> dict:
    """The model from labelled rows outside part ``held_out``."""
    known = labels.filter((label_part("doc_id", parts) != held_out) & F.col("quality").isNotNull()).select("doc_id", "quality")
    total = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(total) < 2:
        return {"constant": float(next(iter(total), 0.5))}
    # at most about per_class rows of each label value: a bounded broadcast
    chosen = labelled_sample(known, "quality", per_class, total).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # the document's own columns may have the label's name
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def step():
        def of(batch):
            x, count = passages([t or b"" for t in batch.column(1).to_pylist()])
            ends = pa.array(np.concatenate([[0], np.cumsum(count) * WIDTH]).astype(np.int32))
            return {"quality": batch.column(0).cast(pa.int32()), "x": pa.ListArray.from_arrays(ends, pa.array(x.ravel()))}
        return of
    found = map_text(rows.withColumn("quality", F.col("quality").cast("int")), "quality int, x array<float>", step).toArrow()
    if not found.num_rows:
        return {"constant": 0.5}
    y = found.column(0).to_numpy().astype(np.float64)
    lists = found.column(1).combine_chunks()
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) // WIDTH
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    # a fixed order of the rows, whatever order they came in
    offset = np.cumsum(count) - count
    order = np.lexsort((x[offset, 2], x[offset, 0], x[offset].sum(axis=1), y, count))
    x = np.concatenate([x[offset[i]:offset[i] + count[i]] for i in order]).astype(np.float64)
    y, count = y[order], count[order]
    if len(set(y.tolist())) < 2:
        return {"constant": float(y[0])}
    here = {v: (y == v).sum() for v in (0.0, 1.0)}
    weight = np.where(y == 1, total.get(1, 0) / max(1, here[1.0]), total.get(0, 0) / max(1, here[0.0]))
    return fit(x, count, y, weight / weight.mean())


def score_texts(model: dict, texts: list[bytes]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    x, count = passages(texts)
    return forward(model, x.astype(np.float64), count)["score"]


def score_all(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, threshold: float = 0.3, **learning) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, parts, held_out, **learning))

    def step():
        def of(batch):
            scores = [score_texts(model.value, [t or b"" for t in part.column(1).to_pylist()]) for part in slices([batch], 1_000_000)]
            return {"doc_id": batch.column(0), "score": pa.array(np.concatenate([*scores, np.empty(0)]), pa.float64())}
        return of
    scored = map_text(id_text(docs), "doc_id long, score double", step)
    return scored.select("doc_id", F.coalesce(label_part("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
