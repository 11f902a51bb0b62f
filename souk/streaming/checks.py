"""Interview checks on a stream of incoming survey files.

``duration_issues`` applies ``check_time`` (stateless) to a streaming
DataFrame; ``outlier_issues`` compares each new value with column statistics
computed from the survey already collected. Both write append-only results with a checkpoint
in the session's checkpoint folder, so a restarted query resumes exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import quality as Q
from ..session import ensure_checkpoint_dir


def read_interviews(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def duration_issues(stream: DataFrame, lower: float, upper: float) -> DataFrame:
    return Q.check_time(stream, lower, upper)


def column_stats(history: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """Statistics per column of the collected survey (one aggregate, read once on the driver)."""
    return Q.column_stats(history, columns)


def outlier_issues(stream: DataFrame, stats: dict[str, tuple], columns: list[str], k: float = 3.0,
                   index: str = "index") -> DataFrame:
    """The same issues as ``find_outliers``, against the collected survey's statistics."""
    return Q.outlier_cells(stream, stats, columns, k, index)


def start_sink(df: DataFrame, path: str, name: str, available_now: bool = True,
               checkpoint_location: str | None = None) -> StreamingQuery:
    """Append results to ``path``; progress is kept in ``checkpoint_location``
    (default: ``<spark.checkpoint.dir>/streams/<name>``) so a restart resumes."""
    ckpt = checkpoint_location or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/streams/{name}"
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt) \
        .outputMode("append").queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
