"""Amplicon data derived from the driver's tables by expressions that mean the same in Spark and in DuckDB.

Every line item is a read of one of 20 references of 64 bases; return flag, order and line number decide which edit it carries and where.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edits import with_edits

WINDOW = [31, 32]
CUT = 31
REFS = 20

_CTE = """
items AS (
  SELECT l_orderkey, l_linenumber, l_linestatus AS sample, l_returnflag, CAST(l_partkey % 20 AS INT) AS ref_id FROM {lineitem}),
src AS (
  SELECT l_orderkey, l_linenumber, sample, ref_id, concat('R', CAST(ref_id AS {S})) AS ref_name,
    translate(concat(md5(concat('r', CAST(ref_id AS {S}))), md5(concat('s', CAST(ref_id AS {S})))),
              '0123456789abcdef', 'ACGTACGTACGTACGT') AS ref_seq,
    CAST(20 + l_orderkey % 24 AS INT) AS p, CAST(1 + l_linenumber % 3 AS INT) AS k,
    CASE WHEN l_returnflag = 'R' THEN 'S'
         WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'D'
         WHEN l_returnflag = 'A' THEN 'I' ELSE 'N' END AS e
  FROM items),
gap AS (
  SELECT *,
    CASE e WHEN 'S' THEN concat(substr(ref_seq, 1, p), translate(substr(ref_seq, p + 1, 1), 'ACGT', 'CGTA'), substr(ref_seq, p + 2))
           WHEN 'D' THEN concat(substr(ref_seq, 1, p), repeat('-', k), substr(ref_seq, p + k + 1))
           WHEN 'I' THEN concat(substr(ref_seq, 1, p), substr('GATTACA', 1, k), substr(ref_seq, p + 1))
           ELSE ref_seq END AS aln_seq,
    CASE e WHEN 'I' THEN concat(substr(ref_seq, 1, p), repeat('-', k), substr(ref_seq, p + 1)) ELSE ref_seq END AS aln_ref
  FROM src),
reads AS (
  SELECT *, replace(aln_seq, '-', '') AS read_seq,
    substr(translate(concat(md5(concat('q', CAST(l_orderkey AS {S}))), md5(concat('q', CAST(l_linenumber AS {S}))),
                            md5(concat('z', CAST(l_orderkey AS {S})))),
                     '0123456789abcdef', '!#%+/29;?ABCEGHI'), 1, length(replace(aln_seq, '-', ''))) AS qual
  FROM gap)
"""

#: What SQL knows about each read by construction: the edits in the window of positions 31 and 32.
WITH = (
    "WITH "
    + _CTE.format(S="VARCHAR", lineitem="lineitem")
    + """, mods AS (
  SELECT *, e = 'S' AND p IN (31, 32) AS sub_w, e = 'D' AND p <= 32 AND p + k > 31 AS del_w, e = 'I' AND p = 32 AS ins_w FROM reads),
vars AS (
  SELECT *, sub_w OR del_w OR ins_w AS modified, CASE WHEN sub_w THEN 1 ELSE 0 END AS n_sub, CASE WHEN del_w THEN k ELSE 0 END AS n_del, CASE WHEN ins_w THEN k ELSE 0 END AS n_ins FROM mods)
"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files give fewer partitions than these: the work on a row is much more than its bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: The columns that reads are derived from.
ITEMS = ["l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_partkey"]


def _reads_of(items: DataFrame) -> DataFrame:
    return items.sparkSession.sql("WITH " + _CTE.replace("{S}", "STRING") + " SELECT * FROM reads", lineitem=items)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads_of(spread(table(spark, sf_dir, "lineitem").select(*ITEMS)))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_name, ref_seq): one row per reference. It hangs on the part alone, so one item of each reference is derived, not all."""
    items = table(spark, sf_dir, "lineitem")
    one = items.groupBy((F.col("l_partkey") % REFS).alias("l_partkey")).agg(*[F.min(c).alias(c) for c in ITEMS if c != "l_partkey"])
    return _reads_of(one.select(*ITEMS)).select("ref_name", "ref_seq").distinct()


def reference_rows() -> dict[str, list[int]]:
    return {f"R{k}": WINDOW for k in range(REFS)}


def alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, ref_name, aln_seq, aln_ref, n_reads): distinct aligned pairs."""
    return reads(spark, sf_dir).groupBy("sample", "ref_name", "aln_seq", "aln_ref").agg(F.count(F.lit(1)).alias("n_reads"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alleles with their called edits."""
    return with_edits(alleles(spark, sf_dir), reference_rows())


def ref_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_name, pos, ref_base)."""
    from ..functions.sequences import letters

    return references(spark, sf_dir).select("ref_name", F.posexplode(letters(F.col("ref_seq"))).alias("pos", "ref_base"))
