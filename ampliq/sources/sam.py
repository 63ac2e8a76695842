"""SAM text as DataFrames, and back. BAM files are in ``bam``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["name", "flag", "chr", "pos", "mapq", "cigar", "next_chr", "next_pos", "length", "seq", "qual"]
SCHEMA = "name string, flag int, chr string, pos long, mapq int, cigar string, next_chr string, next_pos long, length long, seq string, qual string"


def read(spark: SparkSession, path: str, exclude_flags: int = 0, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records of SAM text (headers left out), with the optional fields in ``tags``; filtered by flags and by overlap with a region."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    tags = F.map_from_entries(F.transform(F.filter(F.slice(cells, 12, F.greatest(F.size(cells) - 11, F.lit(0))), lambda t: t.contains(":")), lambda t: F.struct(F.substring_index(t, ":", 1), F.get(F.split(t, ":", 3), F.lit(2)))))
    out = rows.select(*[F.get(cells, F.lit(k)).cast(kinds[c]).alias(c) for k, c in enumerate(COLUMNS)], tags.alias("tags"))
    return _selected(out, exclude_flags, chrom, start, end)


def _selected(df: DataFrame, exclude_flags: int, chrom: str | None, start: int | None, end: int | None) -> DataFrame:
    from ..functions.sequences import cigar_length

    if exclude_flags:
        df = df.where(F.col("flag").bitwiseAND(F.lit(exclude_flags)) == 0)
    if chrom:
        df = df.where(F.col("chr") == chrom)
    if start is not None and end is not None:
        df = df.where((F.col("pos") <= end) & (F.col("pos") + cigar_length(F.col("cigar"), "MDN=X") - 1 >= start))
    return df


def write(records: DataFrame, path: str, contigs: dict[str, int], annotation: str | None = None) -> None:
    """SAM text in coordinate order, with a header; ``annotation`` is a column written as an optional text field."""
    spark = records.sparkSession
    head = "\n".join(["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs.items()]])
    note = [F.concat(F.lit("c2:Z:"), F.coalesce(F.col(annotation).cast("string"), F.lit("")))] if annotation else []
    rows = records.repartitionByRange("chr", "pos").sortWithinPartitions("chr", "pos")
    body = rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in COLUMNS], *note).alias("value"))
    spark.createDataFrame([(head,)], "value string").coalesce(1).union(body).write.text(path)
