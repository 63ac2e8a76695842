"""Allele tables: whole, around a cut, by target base; and their order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import letters, reverse_complement
from .edits import modified
from .positions import ref_positions

ORDER = (F.desc, "n_reads"), (F.asc, "aln_seq"), (F.asc, "aln_ref")


def unique_reads(reads: DataFrame, keys: list[str] | None = None, seq: str = "seq", order: str | None = None) -> DataFrame:
    """(keys, seq, n) of distinct reads, counted within tasks first; with ``order`` also where each was first seen."""
    aggs = [F.count(F.lit(1)).alias("n_reads")] + ([F.min(order).alias("first_seen")] if order else [])
    return reads.groupBy(*(keys or []), seq).agg(*aggs)


def _met(reads: DataFrame, counts: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Reads and a table with one row for each value of the columns. Nulls are equal, which also spares the filters that would work out derived columns a second time."""
    renamed = counts.withColumnsRenamed({c: f"_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return reads.join(renamed, reduce(and_, same), how).drop(*[f"_{c}" for c in columns])


def annotated(reads: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Every read with ``n_reads``, the number of reads of its key that are equal to it. Reads meet their counts, so that a frequent one is no single task's."""
    columns = [*keys, seq]
    return _met(reads, unique_reads(reads.select(*columns), keys, seq), columns, "left")


def seen_often(reads: DataFrame, keys: list[str], more_than: int, seq: str = "seq") -> DataFrame:
    """The reads that occur more than so many times in their key."""
    columns = [*keys, seq]
    return _met(reads, unique_reads(reads.select(*columns), keys, seq).where(F.col("n_reads") > more_than), columns, "left_semi")


def unique_pairs(pairs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct read pairs with their number and the qualities of the first."""
    return pairs.groupBy(*keys, "seq1", "seq2").agg(F.count(F.lit(1)).alias("n_reads"), F.min_by("qual1", order).alias("qual1"), F.min_by("qual2", order).alias("qual2"))


def strand_merged(reads: DataFrame, keys: list[str], seq: str = "seq", order: str = "first_seen", weight: str = "n_reads") -> DataFrame:
    """Reads and their reverse complements as one, under the spelling seen first. A read that is its own reverse complement counts once."""
    both = reads.withColumn("_key", F.least(F.col(seq), reverse_complement(F.col(seq))))
    return both.groupBy(*keys, "_key").agg(F.min_by(seq, F.struct(order, seq)).alias(seq), F.sum(weight).alias(weight), F.min(order).alias(order)).drop("_key")


def allele_rows(variants: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """A row per aligned pair: status, numbers of edited bases, and reads."""
    rows = variants.groupBy(*keys, "ref_name", "aln_seq", "aln_ref", F.when(modified(ignore), "MODIFIED").otherwise("UNMODIFIED").alias("read_status"), F.col("edits.deletion_n").alias("n_deleted"), F.col("edits.insertion_n").alias("n_inserted"), F.col("edits.substitution_n").alias("n_mutated"))
    return rows.agg(F.sum("n_reads").alias("n_reads"))


def allele_table(variants: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """``allele_rows`` with the percent of the key's reads."""
    return with_percent(allele_rows(variants, keys, ignore), keys)


def with_percent(alleles: DataFrame, keys: list[str], name: str = "pct_reads") -> DataFrame:
    """Reads as a percent of those of the key; totals are summed apart, so that a large key isn't one task's window."""
    if not keys:
        return alleles.crossJoin(alleles.agg(F.sum("n_reads").alias("_total"))).withColumn(name, 100.0 * F.col("n_reads") / F.col("_total")).drop("_total")
    totals = alleles.groupBy(*keys).agg(F.sum("n_reads").alias("_total"))
    return alleles.join(totals, keys).withColumn(name, 100.0 * F.col("n_reads") / F.col("_total")).drop("_total")


def ordered(alleles: DataFrame) -> DataFrame:
    return alleles.orderBy(*[f(c) for f, c in ORDER])


def around_cut(alleles: DataFrame, keys: list[str], cut: Column, left: int | Column, right: int | Column, weight: str = "n_reads", keep_whole: bool = False) -> DataFrame:
    """Alleles of the ``left`` columns up to and with the cut position and the ``right`` ones behind it, summed.

    An insertion at the cut moves columns out of the window, as the window is one of alignment columns. With ``keep_whole`` alleles stay apart by
    their whole sequences, which are kept as whole_seq and whole_ref.
    """
    keys = [*keys, "whole_seq", "whole_ref"] if keep_whole else keys
    alleles = alleles.withColumns({"whole_seq": F.col("aln_seq"), "whole_ref": F.col("aln_ref")}) if keep_whole else alleles
    at = F.array_position(ref_positions(F.col("aln_ref")), cut.cast("int")).cast("int")
    cut_out = alleles.withColumn("_at", at).withColumn("_s", F.greatest(F.col("_at") - left + 1, F.lit(1)))
    part = lambda c: F.substring(c, F.col("_s"), F.col("_at") + right - F.col("_s") + 1)
    rows = cut_out.select(*keys, part(F.col("aln_seq")).alias("aln_seq"), part(F.col("aln_ref")).alias("aln_ref"), (F.col("read_status") == "UNMODIFIED").alias("unedited"), "n_deleted", "n_inserted", "n_mutated", weight)
    return rows.groupBy(*keys, "aln_seq", "aln_ref", "unedited", "n_deleted", "n_inserted", "n_mutated").agg(F.sum(weight).alias(weight))


def at_target_base(alleles: DataFrame, keys: list[str], target: str, weight: str = "n_reads") -> DataFrame:
    """Alleles reduced to the columns at which the reference has the target base."""
    pairs = F.filter(F.arrays_zip(letters(F.col("aln_seq")).alias("q"), letters(F.col("aln_ref")).alias("r")), lambda x: x["r"] == target)
    rows = alleles.withColumn("_p", pairs).select(*keys, F.array_join(F.transform("_p", lambda x: x["q"]), "").alias("aln_seq"), F.array_join(F.transform("_p", lambda x: x["r"]), "").alias("aln_ref"), weight)
    return rows.groupBy(*keys, "aln_seq", "aln_ref").agg(F.sum(weight).alias(weight))


def collapsed(alleles: DataFrame, keys: list[str], weight: str = "n_reads") -> DataFrame:
    return alleles.groupBy(*keys, "aln_seq", "aln_ref").agg(F.sum(weight).alias(weight))


def frequent(alleles: DataFrame, least_pct: float, rows: int) -> DataFrame:
    """The first ``rows`` alleles, in order, with at least ``least_pct`` percent of the reads."""
    return ordered(alleles.where(F.col("pct_reads") >= least_pct)).limit(rows)


def reconstituted(alleles: DataFrame, weight: str = "n_reads") -> DataFrame:
    """One row per read: the allele's sequence without gaps, as often as it was read."""
    return alleles.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int")))).withColumn("read_seq", F.translate("aln_seq", "-", ""))


def compiled_references(alleles: DataFrame, keys: list[str], least_share: float) -> DataFrame:
    """References from a run: the sequence without gaps of each key's most frequent allele, and of the others with at least the share of its reads, each
    once with the reads of its most frequent allele. Only what passes is ranked; a share above zero bounds how many these are."""
    most = alleles.groupBy(*keys).agg(F.min(F.struct((-F.col("n_reads")).alias("n"), "aln_seq"))["aln_seq"].alias("_most"))
    passed = alleles.join(most, keys).where((F.col("pct_reads") >= 100 * least_share) | (F.col("aln_seq") == F.col("_most")))
    each = passed.groupBy(*keys, F.translate("aln_seq", "-", "").alias("ref_seq")).agg(F.min(F.struct((-F.col("n_reads")).alias("n"), "aln_seq", "pct_reads")).alias("x"))
    each = each.select(*keys, "ref_seq", (-F.col("x.n")).alias("n_reads"), F.col("x.aln_seq").alias("_aln"), F.col("x.pct_reads").alias("pct_reads"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n_reads"), "_aln"))).drop("_aln")


def ambiguous(alleles: DataFrame) -> DataFrame:
    """Of a stored allele table the reads that fit several references equally well."""
    return alleles.where(F.col("ref_name").startswith("AMBIGUOUS"))


def rewindowed(alleles: DataFrame, cuts: DataFrame, left: int, right: int, keys: list[str], center: int | None = None, weight: str = "n_reads") -> DataFrame:
    """A stored allele table around each guide's cut (cuts: ref_name, guide, cut), or around ``center`` of every reference, with percents of the key's
    reads. Alleles of a reference with several guides appear once a guide."""
    if center is None:
        met, by = alleles.join(cuts.select("ref_name", "guide", "cut"), "ref_name"), ["ref_name", "guide"]
    else:
        met, by = alleles.withColumn("cut", F.lit(center)), ["ref_name"]
    totals = alleles.groupBy(*keys).agg(F.sum(weight).alias("_all")) if keys else alleles.agg(F.sum(weight).alias("_all"))
    out = around_cut(met, [*keys, *by], F.col("cut"), left, right, weight)
    out = out.join(totals, keys) if keys else out.crossJoin(F.broadcast(totals))  # one row
    return out.withColumn("pct_reads", 100.0 * F.col(weight) / F.col("_all")).drop("_all")
