"""Edits as VCF records: left-aligned, counted, sorted, written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import inserted_bases

KINDS = ("substitution", "deletion", "insertion")


def left_aligned(ref: Column, pos: Column, size: Column, added: Column) -> Column:
    """(pos, ref, alt) of a deletion of ``size`` bases at ``pos`` (added: empty), or of ``added`` put before it: 0-based, as far left as the sequence allows,
    with the base before it in front, or the one behind it at the start of the reference.

    With the added bases in place, an indel moves left by a base while the base before it equals its last one."""
    text = F.when(added == "", ref).otherwise(F.concat(F.substring(ref, F.lit(1), pos), added))
    base = lambda k: F.substring(text, k + 1, F.lit(1))
    stops = F.filter(F.sequence(F.lit(1), F.greatest(pos, F.lit(1))), lambda j: base(pos - j) != base(pos + size - j))
    moved = F.when(pos == 0, 0).otherwise(F.coalesce(F.array_min(stops) - 1, pos))
    at = pos - moved
    piece = F.substring(text, at + 1, size)
    before = F.when(at > 0, F.substring(text, at, F.lit(1))).otherwise("")
    behind = F.when(at > 0, "").otherwise(F.substring(ref, F.when(added == "", size).otherwise(0) + 1, F.lit(1)))
    with_it, without = F.concat(before, piece, behind), F.concat(before, behind)
    return F.struct(F.greatest(at - 1, F.lit(0)).cast("int").alias("pos"), F.when(added == "", with_it).otherwise(without).alias("ref"), F.when(added == "", without).otherwise(with_it).alias("alt"))


def edit_counts(variants: DataFrame, places: dict[str, tuple[str, int]], keys: list[str], weight: str = "n_reads") -> DataFrame:
    """(keys, chr, pos, ref, alt, n_reads, frequency): edits in the window by genome position (1-based).

    ``places``: chromosome and 1-based start of each reference; reads of others are left out. The frequency is of all reads of the key.
    """
    spark = variants.sparkSession
    where = spark.createDataFrame([(k, c, s) for k, (c, s) in places.items()], "ref_name string, chr string, _start long")  # a row a reference
    rows = variants.where(F.col("edits.mods_in_window") > 0).join(F.broadcast(where), "ref_name").withColumn("_ref", F.translate("aln_ref", "-", ""))
    cell = lambda pos, size, text: F.struct(pos.cast("int").alias("pos"), size.cast("int").alias("size"), text.alias("text"))
    subs = F.zip_with("edits.substitution_positions", "edits.substitution_values", lambda p, v: cell(p, F.lit(0), v))
    dels = F.transform(F.filter("edits.deletion_coordinates", lambda c: c["end"] > c["start"]), lambda c: cell(c["start"], c["end"] - c["start"], F.lit("")))
    bases = inserted_bases(F.col("aln_seq"), F.col("edits.ref_positions"), F.col("edits.insertion_coordinates"), F.col("edits.insertion_sizes"))
    ins = F.zip_with("edits.insertion_coordinates", bases, lambda c, b: cell(c["end"], F.length(b), b))
    each = rows.select(*keys, "chr", "_start", "_ref", weight, F.explode(F.concat(subs, dels, ins)).alias("x"))
    whole = F.struct(F.col("x.pos").alias("pos"), F.substring("_ref", F.col("x.pos") + 1, F.lit(1)).alias("ref"), F.col("x.text").alias("alt"))
    each = each.withColumn("y", F.when(F.col("x.size") == 0, whole).otherwise(left_aligned(F.col("_ref"), F.col("x.pos"), F.col("x.size"), F.col("x.text"))))
    counts = each.groupBy(*keys, "chr", (F.col("_start") + F.col("y.pos")).alias("pos"), F.col("y.ref").alias("ref"), F.col("y.alt").alias("alt")).agg(F.sum(weight).alias(weight))
    totals = variants.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    met = counts.join(totals, keys) if keys else counts.crossJoin(F.broadcast(totals))  # one row
    return met.withColumn("frequency", F.col(weight) / F.col("_total")).drop("_total")


def sorted_records(counts: DataFrame) -> DataFrame:
    """Chromosomes whose names are numbers first, by number, then the others by name; then position and alleles by length and letters."""
    number = F.when(F.col("chr").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("chr").cast("long"))
    return counts.orderBy(number.isNull(), number, "chr", "pos", F.length("alt"), "alt", F.length("ref"), "ref")


def write(counts: DataFrame, path: str, lengths: dict[str, int] | None = None) -> None:
    """VCF text: header lines (a contig line for each of ``lengths``), then a record per edit; one part file per range of the sort."""
    contigs = [f"##contig=<ID={k},length={n}>" for k, n in (lengths or {}).items()]
    head = "\n".join(["##fileformat=VCFv4.5", "##source=ampliq", '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele Frequency">', *contigs, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"])
    body = sorted_records(counts).select(F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.concat(F.lit("AF="), F.format_string("%.3f", "frequency"))).alias("value"))
    spark = counts.sparkSession
    spark.createDataFrame([(head,)], "value string").coalesce(1).union(body).write.text(path)
