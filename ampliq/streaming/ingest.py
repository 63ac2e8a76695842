"""Reads that arrive as a stream: distinct reads counted as files come in.

Every later table is a sum over distinct reads, so their counts are the only state. ``unique_counts`` keeps it in the query's state store;
``merged`` keeps it in a table, batch by batch, which suits many distinct reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def reads(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of reads, in the order in which they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unique_counts(stream: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The running counts of distinct reads, for output modes ``complete`` and ``update``."""
    return stream.groupBy(*keys, seq).agg(F.count(F.lit(1)).alias("n_reads"))


def windowed_counts(stream: DataFrame, keys: list[str], time: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Reads per key and arrival window; rows later than the watermark are dropped and closed windows are emitted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n_reads"))


def merged(stream: DataFrame, path: str, keys: list[str], seq: str = "seq") -> DataStreamWriter:
    """Each batch's counts in a folder of its own: a batch that runs again replaces its folder, so nothing counts twice."""

    def add(batch: DataFrame, number: int) -> None:
        unique_counts(batch, keys, seq).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add)


def totals(spark: SparkSession, path: str, keys: list[str], seq: str = "seq") -> DataFrame:
    """The counts over all batches so far."""
    return spark.read.parquet(path).groupBy(*keys, seq).agg(F.sum("n_reads").alias("n_reads"))
