"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source.

Measures of each whole text are computed in its own row by SQL functions. Over
the documents that pass the base rules, every (lang, source) cell gets a KLL
sketch of each metric. Sketches merge, so cells with fewer than ``least``
documents take the sketch merged over their language, and languages with fewer
the one merged over everything. A cell's limits are its quartiles widened by
``spread`` times their distance (at least by the metric's ``slack``, so that a
metric that is constant in clean text keeps a margin). The limits are joined to
the documents on (lang, source), null being a value like any other.

Only DataFrame and SQL functions. Repeated windows are found by sorting a text's
window hashes (64-bit) in the row: no window leaves its row and nothing is
shuffled but the measures.

Defined results: null text has no words and fails the base rules; null lang or
source is a cell of its own; with no document that passes the base rules there
are no limits and the base rules decide; repeated rows are counted and returned
each; other columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import scratch_table

GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"
SYMBOL = r"[#*$%&|<>]"
MARK = r"[^\p{L}\p{N}\s]"
START_BITS = 21

# metric -> (expression over the measures, least margin)
METRICS = {
    "symbols": ("n_symbols / n_words", 0.15),
    "marks": ("n_marks / n_words", 0.08),
    "word_length": ("word_chars / n_words", 0.6),
    "dup_lines": ("n_dup_lines / n_lines", 0.4),
    "repeats": ("n_repeat_words / n_words", 0.4),
}


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def _window(words: str, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def _head(key: Column) -> Column:
    return F.shiftright(key, START_BITS)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    rows = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(GAP_CHARS)) != "")
    rows = rows.select("doc_id", "lang", "source", "t", _words(F.col("t")).alias("w"), lines.alias("l"))
    size = F.size("w")
    # sort key of window i: the first bits of its words' hash, then i
    starts = F.when(size >= 3, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        "doc_id", "lang", "source", "w", size.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(MARK)).cast("long").alias("n_marks"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(starts, lambda i: _window("w", i).bitwiseAND(F.lit(-(1 << START_BITS))).bitwiseOR(i))).alias("k"))
    # windows whose neighbour in that order has the same first bits, then those with the same hash
    alike = F.filter("k", lambda x, n: (_head(x) == _head(F.get("k", n + 1))) | (_head(x) == _head(F.get("k", n - 1))))
    at = F.transform(alike, lambda x: x.bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int"))
    # a text with more windows than START_BITS can number: all of them
    at = F.when(size > (1 << START_BITS), F.sequence(F.lit(0), size - 3)).otherwise(at)
    rows = rows.withColumn("s", F.sort_array(F.transform(at, lambda i: F.struct(_window("w", i).alias("h"), i.alias("i")))))
    found = F.filter("s", lambda x, n: (x["h"] == F.get("s", n - 1)["h"]) | (x["h"] == F.get("s", n + 1)["h"]))
    rows = rows.withColumn("r", F.sort_array(F.transform(found, lambda x: x["i"])))
    # a repeated window covers three words, less those that the next one covers too
    covered = F.transform("r", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("r", k + 1) - i, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines",
                       total.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def limits(measured: DataFrame, least: int = 200, spread: float = 6.0) -> DataFrame:
    """cell_lang, cell_source and a low and high limit of each metric, for every cell of
    ``measured``."""
    passed = measured.filter(~base_failed())
    cells = measured.select(F.col("lang").alias("cell_lang"), F.col("source").alias("cell_source")).distinct()
    sketches = passed.groupBy("lang", "source").agg(F.count("*").alias("n"), *[
        F.kll_sketch_agg_double(F.expr(f"cast({e} as double)")).alias(m) for m, (e, _) in METRICS.items()])
    sketches = scratch_table(sketches, "quality-sketches")

    def merged(by: list[str], mark: str) -> DataFrame:
        return sketches.groupBy(*by).agg(F.sum("n").alias(f"n_{mark}"), *[
            F.kll_merge_agg_double(m).alias(f"{m}_{mark}") for m in METRICS]).select(
            *[F.col(b).alias(f"{b}_{mark}") for b in by], f"n_{mark}", *[f"{m}_{mark}" for m in METRICS])
    own = sketches.select(F.col("lang").alias("lang_cell"), F.col("source").alias("source_cell"), F.col("n").alias("n_cell"),
                          *[F.col(m).alias(f"{m}_cell") for m in METRICS])
    cells = cells.join(own, F.col("cell_lang").eqNullSafe(F.col("lang_cell")) & F.col("cell_source").eqNullSafe(F.col("source_cell")), "left")
    cells = cells.join(merged(["lang"], "lang"), F.col("cell_lang").eqNullSafe(F.col("lang_lang")), "left")
    whole = merged([], "all")  # one row
    cells = cells.withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one", "left")
    out = []
    for m, (_, slack) in METRICS.items():
        sketch = F.when(F.col("n_cell") >= least, F.col(f"{m}_cell")).when(F.col("n_lang") >= least, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        margin = F.greatest(spread * (high - low), F.lit(slack))
        out += [(low - margin).alias(f"{m}_low"), (high + margin).alias(f"{m}_high")]
    return cells.select("cell_lang", "cell_source", *out)


def judge(docs: DataFrame, least: int = 200, spread: float = 6.0) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row."""
    measured = scratch_table(measures(docs), "quality-measures")
    cut = scratch_table(limits(measured, least, spread), "quality-limits")
    rows = measured.join(cut, F.col("lang").eqNullSafe(F.col("cell_lang")) & F.col("source").eqNullSafe(F.col("cell_source")), "left")
    inside = F.lit(True)
    for m, (e, _) in METRICS.items():
        value = F.expr(f"cast(try_divide({e.replace(' / ', ', ')}) as double)")
        inside = inside & F.coalesce(value.between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
                       (~base_failed() & inside).alias("kept"))
