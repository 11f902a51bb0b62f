"""Helpers shared by the operators: whole-text batches, scratch tables, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (shared by driver and executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/souk-{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so a lost
    executor costs a reread and not the computation."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle that is dealt out by hand."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def label_part(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``parts`` (null doc_id: null)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


def hash_below(salt: str, share: float) -> Column:
    """Whether a row's doc_id hash falls in the first ``share`` of all 64-bit hashes: a share of
    any size above 0 picks its part of the rows."""
    most = (1 << 63) - 1
    # the hash is signed; 1 stands for every row, a null doc_id among them
    at = int(min(1.0, share) * 2.0**64) - (1 << 63)
    return F.xxhash64(F.col("doc_id"), F.lit(salt)) <= F.lit(min(at, most))


def labelled_sample(rows: DataFrame, label: str, per_class: int, total: dict) -> DataFrame:
    """About ``per_class`` rows of each label value at most, chosen by a hash of doc_id
    (the same rows at every run and partitioning). ``total``: rows of each label value."""
    keep = F.lit(False)
    for value, n in total.items():
        keep = keep | ((F.col(label) == value) & hash_below("sample", per_class / max(1, n)))
    return rows.filter(keep)


SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in slices of about ``most`` bytes (one row at least)."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """A list column of int32 arrays."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int32)]).astype(np.int32)))


def map_text(df: DataFrame, schema, step: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict]]) -> DataFrame:
    """``mapInArrow`` where ``step()`` builds, once per task, a function from batch to columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = step()
        for batch in slices(batches):
            out = f(batch)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a binary column: null becomes the empty text, a byte that is not
    UTF-8 the replacement sign."""
    return ["" if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()]


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text's bytes (so that no reader has to trust their encoding)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def int64(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))
