"""Two-pass external shuffle into balanced shards, in DataFrame operations only.

Pass one scatters every record into one of many buckets by a seeded hash; a bucket is small enough for a task's memory. Pass two
puts a bucket's records into a fixed order, permutes them with Spark's ``shuffle`` (a seeded Fisher-Yates shuffle of an array) and
numbers them. Buckets follow one another, so a record's number over all is its bucket's offset plus its place there; number modulo
shards is the shard and number divided by shards the slot. So the law is ``rows``: shards differ by one record at most.

Each Spark partition permutes its buckets in the order of their ids with a random stream that starts from seed and partition number, and the
number of partitions is fixed by the number of buckets: a task that runs again gives the same permutation.

Null or repeated ids, empty or null texts: such rows are records like others (null text: no bytes). Rows that repeat one another are
told apart by a copy number before they are scattered, so that thousands of equal rows spread over all buckets. An empty table
gives no rows. Further columns are ignored by ``assign_shards`` and carried by ``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table, text_bytes

SHARDS = 16
SEED = 20_240_601
#: Records of a bucket of ids and sizes; bytes of a bucket of whole documents.
BUCKET_ROWS = 4096
BUCKET_BYTES = 32 << 20
#: Buckets that share one subtotal when offsets are added up.
SUBTOTAL = 1024


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, n) -> (bucket, before): the records of all earlier buckets, summed in two levels."""
    parted = counts.withColumn("part", F.floor(F.col("bucket") / SUBTOTAL))
    inside = parted.withColumn("inner", F.sum("n").over(W.partitionBy("part").orderBy("bucket")) - F.col("n"))
    parts = parted.groupBy("part").agg(F.sum("n").alias("n_part"))
    parts = parts.withColumn("outer", F.sum("n_part").over(W.orderBy("part")) - F.col("n_part")).drop("n_part")
    return inside.join(parts, "part").select("bucket", (F.col("inner") + F.col("outer")).alias("before"))


def permuted(records: DataFrame, n_buckets: int, key: list[Column], seed: int) -> DataFrame:
    """``records`` with ``number`` (long): a seeded random permutation of 0 to n - 1 over all of them."""
    names = records.columns
    spread = records.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n_buckets)))
    buckets = (
        spread.repartition(max(1, min(n_buckets, 100_000)), "bucket")
        .groupBy("bucket")
        .agg(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), *key).alias("_order"), *names)).alias("held"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle(F.sort_array("held"), seed).alias("held"))
    )
    counts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    placed = buckets.join(_offsets(counts), "bucket").select("before", F.posexplode("held").alias("place", "r"))
    return placed.select(*[F.col(f"r.{x}").alias(x) for x in names], (F.col("before") + F.col("place")).alias("number"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", (text_bytes("text") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
    n = docs.count()
    mixed = permuted(rows, max(1, math.ceil(n / bucket_rows)), [F.col(c) for c in ("doc_id", "size", "text_crc32", "copy")], seed)
    return mixed.select("doc_id", "size", "text_crc32", F.pmod("number", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("number") / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Shuffles whole documents and writes them as ``path/shard=K``, in the order of their slots within each file."""
    total = docs.select(F.sum(text_bytes("text") + 64)).first()[0] or 0
    mixed = permuted(docs, max(1, math.ceil(total / bucket_bytes)), [F.col(c) for c in ("doc_id", "text")], seed)
    out = mixed.withColumn("shard", F.pmod("number", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("number") / shards).cast("long")).drop("number")
    rows_a_file = 250_000
    out.withColumn("_file", F.floor(F.col("slot") / rows_a_file)).repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
