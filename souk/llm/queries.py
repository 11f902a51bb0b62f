"""The operators' queries over the given tables, with production parameters and whole results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm import (bpe, decontaminate, html_text, langid, packing, quality_mil, quality_rules, repair, search, secrets, simhash, tokenfile,
                      toxicity)
from souk.llm.common import scratch_dir, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: 4-word shingles, links at 4 or fewer differing bits."""
    found = simhash.components(table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document by its cell's adaptive limits."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak within a tenth of the item's length in edits."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), error_rate=0.1)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned outside the part crc32 mod 5 = 0."""
    return quality_mil.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), parts=5, held_out=0, threshold=0.3)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and inferred secret spans of every document, counts and digests."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.learn(docs))
    base = F.filter("spans", lambda s: s["kind"] != "format")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, count and checksum of every document's ids, as read back from the token files."""
    path = scratch_dir(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return tokenfile.read_digests(spark, path)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of every document."""
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned outside the part crc32 mod 3 = 1."""
    return toxicity.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), parts=3, held_out=1, threshold=0.7)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned outside the part crc32 mod 4 = 2."""
    return langid.identify_all(table(spark, sf_dir, "documents"), parts=4, held_out=2)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation, damaged by its rows' checksums."""
    return repair.report(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


OP12_SQL = r"""
WITH tokens AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term, docs),
norms AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // total) AS m FROM lengths, corpus),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids, along the curve."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2, length=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_text": op3_html_text,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_token_file": op7_token_file,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_repair": op11_repair,
    "op12_search": op12_search,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {"op12_search": OP12_SQL}
