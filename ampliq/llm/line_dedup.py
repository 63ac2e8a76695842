"""Removal of lines that many sites share, in DataFrame operations.

A line (its spaces at both ends cut off, at least ``min_chars`` characters) is known by two hashes, 128 bits together. Its spread is
the number of distinct sites it occurs on. HyperLogLog sketches of the sites, one per line, are built from the lines within tasks and merge by
aggregation; no table of lines and sites is made. A line whose estimate is well above ``min_sites`` is boilerplate and one well below isn't; only
for the lines whose estimate is near the threshold (within three standard errors, at least one site) the documents are read again and the distinct sites
counted exactly.

Boilerplate goes from every document in which it makes up at most ``max_share`` of the characters of its lines. A document that
consists mostly of such lines is a copy of others rather than a page with boilerplate, and stays as it is for the stage that finds near copies.

Null text: stays null, no lines. A null site is a site of its own. A row is known by a hash of its id and text, so rows with a null or repeated
doc_id are handled like any other (rows that shared a hash would only look for each other's boilerplate, too). Repeated rows are changed alike. Empty tables give empty results. Other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table, written

MIN_SITES = 12
MIN_CHARS = 10
MAX_SHARE = 0.5
LG_K = 12


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _hashes(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def _known(line: Column, min_chars: int) -> Column:
    return F.length(F.trim(line)) >= min_chars


def shared_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(line: the two hashes) of every line on at least ``min_sites`` distinct sites."""
    spark = docs.sparkSession
    lines = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(F.array_distinct(F.filter(_lines("text"), lambda x: _known(x, min_chars)))).alias("line"))
    lines = lines.select(_hashes(F.trim("line")).alias("line"), "site")
    estimates = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    band = max(1.0, 3 * 1.04 * min_sites / 2 ** (LG_K / 2))
    estimates = written(estimates.where(F.col("sites") >= min_sites - band), spark, "estimates")
    near = estimates.where(F.col("sites") <= min_sites + band)
    exact = lines.join(near.select("line"), "line").groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    return estimates.where(F.col("sites") > min_sites + band).select("line").union(exact.select("line"))


def without_shared_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` with its text cleaned, and n_lines and n_removed."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    boilerplate = written(shared_lines(docs, site, min_sites, min_chars), spark, "boilerplate")
    id_, gone_, lines_, kept_ = fresh(docs.columns, "_id", "_gone", "_lines", "_kept")
    row = F.xxhash64("doc_id", "text")
    keyed = docs.select(row.alias(id_), F.explode(F.array_distinct(F.filter(_lines("text"), lambda x: _known(x, min_chars)))).alias("line"))
    hit = keyed.select(id_, _hashes(F.trim("line")).alias("line")).join(boilerplate, "line")
    gone = hit.groupBy(id_).agg(F.collect_set("line").alias(gone_))
    met = docs.select(*names).withColumn(id_, row).join(gone, id_, "left")
    is_gone = lambda x: _known(x, min_chars) & F.coalesce(F.array_contains(gone_, _hashes(F.trim(x))), F.lit(False))
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(F.trim(x)))
    parts = met.withColumn(lines_, _lines("text")).withColumn(kept_, F.when(F.col(gone_).isNull(), F.col(lines_)).otherwise(F.filter(lines_, lambda x: ~is_gone(x))))
    untouched = F.col(gone_).isNull() | (chars(F.col(lines_)) - chars(F.col(kept_)) > max_share * chars(F.col(lines_)))
    parts = parts.withColumn(kept_, F.when(untouched, F.col(lines_)).otherwise(F.col(kept_)))
    return parts.select(
        *[F.when(F.col("text").isNotNull(), F.array_join(kept_, "\n")).alias("text") if c == "text" else F.col(c) for c in names],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_) - F.size(kept_)).cast("long").alias("n_removed"),
    )


def op4_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = without_shared_lines(docs)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH parts AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
flat AS (
  SELECT DISTINCT coalesce(source, '') AS site, trim(line) AS line FROM (SELECT source, unnest(lines) AS line FROM parts) AS u
  WHERE length(trim(line)) >= {MIN_CHARS}),
shared AS (
  SELECT line FROM flat GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT doc_id, pos, line, trim(line) IN (SELECT line FROM shared) AS gone
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts) AS u),
sums AS (
  SELECT doc_id, count(*) AS n_lines, coalesce(sum(length(trim(line))) FILTER (WHERE gone), 0) > {MAX_SHARE} * sum(length(trim(line))) AS untouched
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce((SELECT count(*) FROM marked m WHERE m.doc_id = d.doc_id AND m.gone AND NOT s.untouched), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN s.untouched THEN d.text
    ELSE (SELECT string_agg(m.line, chr(10) ORDER BY m.pos) FROM marked m WHERE m.doc_id = d.doc_id AND NOT m.gone) END, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
