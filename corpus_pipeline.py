"""A training-data pipeline over ``documents``: five stages, each one operator of ``souk.llm``.

Each stage's rows are written as Parquet to the shared folder and read back as
the next one's documents. All but the last return the columns of ``documents``:

1. toxicity: documents that the positive-unlabelled classifier rejects go;
2. near duplicates: of each SimHash class the document with the smallest doc_id stays;
3. decontamination: documents that leak a benchmark item go;
4. secrets: every span found is replaced in the text (``n_chars`` follows);
5. tokens: ids of the kept texts and the bytes they decode to, as counts and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from souk.llm import bpe, decontaminate, secrets, simhash, toxicity
from souk.llm.common import scratch_table, table

TOXIC_AT = 0.7


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), parts=3, held_out=1, threshold=TOXIC_AT)


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, shingle=4, bits=4)


def leaks_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), error_rate=0.1)


def secrets_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.learn(docs))


def token_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("simhash_near_dedup", near_duplicates_go),
    ("decontamination", leaks_go),
    ("secret_scan", secrets_go),
    ("byte_bpe", token_round_trip),
]

#: SQL cannot express the stages: tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
