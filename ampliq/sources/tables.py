"""Settings tables: amplicons, regions, batches, gene annotation, alternate alleles, count files."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement

AMPLICON = ["amplicon_name", "amplicon_seq", "guide_seq", "expected_hdr_amplicon_seq", "coding_seq"]
REGION = ["chr_id", "bpstart", "bpend", "name", "guide_seq", "expected_hdr", "coding_seq", "coding_seq_name"]
BATCH_ALIASES = {"n": "name", "r1": "fastq_r1", "r2": "fastq_r2", "a": "amplicon_seq", "g": "guide_seq"}


def _tsv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=header, comment="#", nullValue="NA")


def named(columns: list[str], known: list[str] = AMPLICON) -> list[str]:
    """The known names that given ones mean: the same up to case, or the closest."""
    out = []
    for c in columns:
        close = difflib.get_close_matches(c.strip().lower(), known, n=1, cutoff=0.6)
        if not close:
            raise ValueError(f"unknown column {c!r}; expected some of {known}")
        out.append(close[0])
    if len(set(out)) < len(out):
        raise ValueError(f"columns {columns} mean a name twice")
    return out


def amplicons(spark: SparkSession, path: str) -> DataFrame:
    """The amplicon table; its first line is a header if it holds no sequence."""
    first = next(iter(spark.read.text(path).where(~F.col("value").startswith("#")).head(1)), None)
    cells = (first[0] if first else "").split("\t")
    header = len(cells) < 2 or not set(cells[1].upper()) <= set("ACGTN")
    df = _tsv(spark, path, header)
    names = named(df.columns) if header else AMPLICON[: len(df.columns)]
    df = df.toDF(*names)
    return df.select(*[(F.upper(c) if c != "amplicon_name" else F.col(c)).alias(c) for c in names], *[F.lit(None).cast("string").alias(c) for c in AMPLICON if c not in names])


def amplicon_problems(amplicons: DataFrame, key: str = "ref_name") -> DataFrame:
    """Each amplicon with its length, whether it has symbols that are no bases, how many have its sequence or the reverse complement, how many its name, and
    which of its guides (comma-joined in ``guide_seq``, if there is one) it holds on neither strand."""
    seqs = amplicons.groupBy("amplicon_seq").agg(F.count(F.lit(1)).alias("n"))
    out = amplicons.withColumn("turned_seq", reverse_complement(F.col("amplicon_seq")))
    out = out.join(seqs.withColumnRenamed("n", "same"), "amplicon_seq", "left")
    out = out.join(seqs.select(F.col("amplicon_seq").alias("turned_seq"), F.col("n").alias("turned")), "turned_seq", "left")
    names = amplicons.groupBy(key).agg(F.count(F.lit(1)).alias("same_name"))
    out = out.join(names, key, "left")
    guides = F.filter(F.transform(F.split(F.upper("guide_seq"), ","), F.trim), lambda g: g != "") if "guide_seq" in amplicons.columns else F.array().cast("array<string>")
    missing = F.filter(F.coalesce(guides, F.array().cast("array<string>")), lambda g: ~F.col("amplicon_seq").contains(g) & ~F.col("turned_seq").contains(g))
    return out.select(key, "amplicon_seq", F.length("amplicon_seq").alias("length"), F.col("amplicon_seq").rlike("[^ACGTN]").alias("bad_bases"), F.coalesce("same", F.lit(0)).alias("same"), F.coalesce("turned", F.lit(0)).alias("turned"), F.coalesce("same_name", F.lit(0)).alias("same_name"), missing.alias("missing_guides"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    df = _tsv(spark, path)
    df = df.toDF(*REGION[: len(df.columns)])
    df = df.select(*[F.col(c) for c in df.columns], *[F.lit(None).cast("string").alias(c) for c in REGION if c not in df.columns])
    df = df.withColumns({"bpstart": F.col("bpstart").cast("long"), "bpend": F.col("bpend").cast("long"), "name": F.regexp_replace("name", " ", "_")})
    twice = df.groupBy("name").count().where("count > 1").head(5)
    if twice:
        raise ValueError(f"region names occur twice: {[r['name'] for r in twice]}")
    return df


def batch(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Batch settings with full names; columns and values not given come from ``defaults``."""
    df = _tsv(spark, path, header=True)
    df = df.toDF(*[BATCH_ALIASES.get(c.strip(), c.strip()) for c in df.columns])
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    twice = df.groupBy("name").count().where("count > 1").head(5) if "name" in df.columns else []
    if twice:
        raise ValueError(f"batch names occur twice: {[r['name'] for r in twice]}")
    return df


def genes(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True)
    return df.withColumns({c: F.col(c).cast("long") for c in ("txStart", "txEnd")})


def alternate_alleles(spark: SparkSession, path: str) -> DataFrame:
    """(region_name, reference_seq, reference_name): one row per alternate reference."""
    df = _tsv(spark, path).toDF("region_name", "seqs", "names").where(F.col("region_name") != "region_name")
    both = F.arrays_zip(F.split("seqs", ",").alias("s"), F.split("names", ",").alias("n"))
    return df.select("region_name", F.explode(both).alias("x")).select("region_name", F.col("x.s").alias("reference_seq"), F.col("x.n").alias("reference_name"))


def count_file(spark: SparkSession, path: str) -> DataFrame:
    """A wide count table, whose first line is the reference's bases, as (label, pos, ref_base, value)."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    head = lines.where(F.trim(F.element_at("c", 1)).isin("", "Sequence")).select(F.expr("slice(c, 2, size(c) - 1)").alias("bases")).limit(1)
    body = lines.where(~F.trim(F.element_at("c", 1)).isin("", "Sequence")).crossJoin(F.broadcast(head))
    return body.select(F.element_at("c", 1).alias("label"), "bases", F.posexplode(F.expr("slice(c, 2, size(c) - 1)")).alias("pos", "v")).select("label", "pos", F.get("bases", F.col("pos")).alias("ref_base"), F.col("v").cast("double").alias("value"))
