"""Toxicity: non-negative positive-unlabelled learning of a word classifier.

Learning sees confirmed toxic documents and unlabelled ones (any documents of
the learning part, their labels unused); a labelled 0 is never a negative. The
risk of "not toxic" is measured on the unlabelled text less the class prior's
share of the positives', and where that corrected part falls below zero the
gradient step turns round (the non-negative estimator), so that the classifier
does not learn to call confirmed positives of the unlabelled text clean. The
class prior is the toxic share of the labelled rows of the learning part.

Features of the whole text: its distinct words, and how many of them (1, 2, 3 or
more) begin with the same ``PREFIXES`` characters, since abuse is inflected and
compounded. The vocabulary holds the features whose rate in positives differs
from that in unlabelled text by ``z_least`` standard errors; start weights are
their log rate ratios.

The fit is bounded: about ``positives`` toxic and ``unlabelled`` documents,
chosen by a hash of doc_id, whole texts. Scoring goes over every row.

Defined results: null and empty texts score like a text without known words; no
confirmed positive to learn from: every score is the class prior (0 without
labels); repeated rows give a row each; a null doc_id is never learned from and
not held out; other columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import hash_below, id_text, int64, label_part, lists, map_text, scratch_table, texts_of

WORD = re.compile(r"\w+")
PREFIXES = (4, 6)
VOCABULARY = 4000


def features_of(text: str) -> set[str]:
    """Distinct words, and ``prefix*1`` .. ``prefix*3`` by how many of them share a prefix."""
    words = set(WORD.findall(text.lower()))
    found = set(words)
    for n in PREFIXES:
        heads = [w[:n] for w in words if len(w) > n]
        for head, count in Counter(heads).items():
            found.add(head + "*1")
            if count > 1:
                found.add(head + "*2")
                if count > 2:
                    found.add(head + "*3")
    return found


def nnpu_weights(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, width: int, prior: float, start: np.ndarray,
                 steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk of the logistic loss.

    rows, cols: the set entries of the 0/1 matrix; positive: True for confirmed rows.
    """
    n = len(positive)
    weight, bias = start.astype(np.float64) / 4, float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    p_share = positive / max(1, positive.sum())
    u_share = ~positive / max(1, (~positive).sum())
    for t in range(1, steps + 1):
        z = bias + np.bincount(rows, weights=weight[cols], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_as_negative = np.logaddexp(0, z)
        negative_risk = u_share @ loss_as_negative - prior * (p_share @ loss_as_negative)
        d_negative = (u_share - prior * p_share) * p
        d = -d_negative if negative_risk < 0 else prior * p_share * (p - 1) + d_negative
        grad = np.append(np.bincount(cols, weights=d[rows], minlength=width) + ridge * weight, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weight -= move[:-1]
        bias -= move[-1]
    return weight, bias


def learn(docs: DataFrame, labels: DataFrame, parts: int, held_out: int, positives: int = 4000, unlabelled: int = 12_000,
          z_least: float = 3.5, least_docs: int = 3) -> dict:
    """The classifier {"words": {word: weight}, "bias": b} from rows outside part ``held_out``."""
    known = labels.filter((label_part("doc_id", parts) != held_out) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n_toxic, n_known = known.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count("*")).first()
    if not n_toxic:
        return {"words": {}, "bias": -30.0}
    prior = min(0.9, max(0.001, n_toxic / n_known))
    # at most about ``positives`` rows: bounded by the sample's share
    chosen = known.filter((F.col("toxic") == 1) & hash_below("pu", positives / n_toxic)).select("doc_id").distinct()
    rows = docs.filter(label_part("doc_id", parts) != held_out).select("doc_id", "text")
    rows = rows.join(F.broadcast(chosen.withColumn("souk_sure", F.lit(1))), "doc_id", "left")
    other = hash_below("unlabelled", unlabelled / max(1, docs.count()))
    rows = rows.filter(F.col("souk_sure").isNotNull() | other)
    rows = rows.select(F.col("souk_sure").isNotNull().alias("sure"), other.alias("other"), F.col("text").cast("binary").alias("text"))

    rows = scratch_table(rows, "toxicity-sample")
    n_sure, n_other = rows.agg(F.count(F.when(F.col("sure"), 1)), F.count(F.when(F.col("other"), 1))).first()
    if not n_sure or not n_other:
        return {"words": {}, "bias": float(np.log(prior / (1 - prior)))}

    def tally(batches):
        count: dict[str, list[int]] = {}
        for batch in batches:
            for sure, other, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                for f in features_of(text):
                    pair = count.setdefault(f, [0, 0])
                    pair[0] += sure
                    pair[1] += other
            if len(count) > 200_000:
                yield columns(count)
                count = {}
        yield columns(count)

    def columns(count):
        pairs = np.array(list(count.values()), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"feature": pa.array(list(count), pa.string()), "in_sure": int64(pairs[:, 0]), "in_other": int64(pairs[:, 1])})
    seen = rows.mapInArrow(tally, "feature string, in_sure long, in_other long").groupBy("feature").agg(
        F.sum("in_sure").alias("in_sure"), F.sum("in_other").alias("in_other"))
    rate_s, rate_o = (F.col("in_sure") + 0.5) / (n_sure + 1), (F.col("in_other") + 0.5) / (n_other + 1)
    error = F.sqrt((rate_o * (1 - rate_o) + rate_s * (1 - rate_s) / 4) / n_sure)
    seen = seen.filter((F.col("in_sure") >= 1) & (F.col("in_sure") + F.col("in_other") >= least_docs))
    seen = seen.select("feature", (F.abs(rate_s - rate_o) / error).alias("z"), F.log(rate_s / rate_o).alias("start"))
    # the vocabulary's size is a parameter of the model
    words = seen.filter(F.col("z") >= z_least).orderBy(F.desc("z"), "feature").limit(VOCABULARY).toArrow()
    if not words.num_rows:
        return {"words": {}, "bias": float(np.log(prior / (1 - prior)))}
    names = words.column("feature").to_pylist()
    place = {f: i for i, f in enumerate(names)}

    def step():
        def of(batch):
            hits = [np.array(sorted(place[f] for f in place.keys() & features_of(t)), np.int32) for t in texts_of(batch.column(2))]
            return {"sure": batch.column(0), "other": batch.column(1), "hits": lists(hits)}
        return of
    found = map_text(rows, "sure boolean, other boolean, hits array<int>", step).toArrow()
    sure, other = (found.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (0, 1))
    hits = found.column(2).combine_chunks()
    row = np.repeat(np.arange(len(sure)), pc.list_value_length(hits).to_numpy(zero_copy_only=False))
    col = hits.flatten().to_numpy(zero_copy_only=False)
    # one matrix row for each use of a document: as confirmed and as unlabelled
    as_sure, as_other = np.cumsum(sure) - 1, sure.sum() + np.cumsum(other) - 1
    rows_ = np.concatenate([as_sure[row[sure[row]]], as_other[row[other[row]]]])
    cols_ = np.concatenate([col[sure[row]], col[other[row]]])
    positive = np.arange(n_sure + n_other) < n_sure
    start = words.column("start").to_numpy()
    weight, bias = nnpu_weights(rows_, cols_, positive, len(names), prior, start)
    return {"words": dict(zip(names, weight.tolist())), "bias": bias}


def scorer(model: dict):
    """Function from text to score (0 to 1)."""
    words, bias = model["words"], model["bias"]
    known = frozenset(words)

    def score(text: str) -> float:
        z = bias + sum(words[w] for w in sorted(known & features_of(text)))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
    return score


def score_all(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, threshold: float = 0.7, **learning) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, parts, held_out, **learning))

    def step():
        score = scorer(model.value)

        def of(batch):
            return {"doc_id": batch.column(0), "score": pa.array([score(t) for t in texts_of(batch.column(1))], pa.float64())}
        return of
    scored = map_text(id_text(docs), "doc_id long, score double", step)
    return scored.select("doc_id", F.coalesce(label_part("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, threshold: float = 0.7, **learning) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, parts, held_out, **learning))
    at = docs.columns.index("text")

    def step():
        score = scorer(model.value)

        def of(batch):
            keep = [score(t) < threshold for t in texts_of(batch.column(at).cast(pa.binary()))]
            return batch.filter(pa.array(keep, pa.bool_()))
        return of
    return map_text(docs, docs.schema, step)
