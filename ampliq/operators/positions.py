"""Per-position counts in long form: reference, position, kind, base, reads. Sinks pivot them; nothing else does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import letters

KINDS = ("insertion", "insertion_left", "deletion", "substitution")
BASES = ("A", "C", "G", "T", "N", "-")


def edit_positions(variants: DataFrame, keys: list[str], in_window: bool = False, weight: str = "n_reads") -> DataFrame:
    """(keys, kind, pos, n): reads with an edit of each kind at each position. A read counts once a position and kind.

    ``in_window`` takes the edits that count for the quantification window; the left flank is only kept for all edits.
    """
    kinds = [k for k in KINDS if not in_window or k != "insertion_left"]
    name = lambda k: f"edits.{'' if in_window else 'all_'}{k}_positions"

    def marked(kind: str):
        return F.transform(F.array_distinct(F.col(name(kind))), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pos")))

    marks = F.flatten(F.array(*map(marked, kinds)))
    long = variants.select(*keys, weight, F.explode(marks).alias("x"))
    return long.groupBy(*keys, "x.kind", "x.pos").agg(F.sum(weight).alias("n"))


def with_totals(positions: DataFrame, keys: list[str]) -> DataFrame:
    """The same with kind ``total``: the sum of insertions, deletions and substitutions (not of distinct reads)."""
    total = positions.where(F.col("kind") != "insertion_left").groupBy(*keys, "pos").agg(F.sum("n").alias("n"))
    return positions.unionByName(total.withColumn("kind", F.lit("total")))


def substitution_bases(variants: DataFrame, keys: list[str], in_window: bool = False, weight: str = "n_reads") -> DataFrame:
    """(keys, pos, base, n): reads with each observed base at each substituted position."""
    pre = "" if in_window else "all_"
    long = variants.select(*keys, weight, F.explode(F.arrays_zip(F.col(f"edits.{pre}substitution_positions").alias("pos"), F.col(f"edits.{pre}substitution_values").alias("base"))).alias("x"))
    return long.groupBy(*keys, "x.pos", "x.base").agg(F.sum(weight).alias("n"))


def ref_positions(aln_ref: Column) -> Column:
    """For each column of an aligned reference its position, or a negative number in an insertion."""
    start = F.struct(F.lit(0).alias("seen"), F.array().cast("array<int>").alias("out"))
    step = lambda a, c: F.when(c == "-", F.struct(a["seen"].alias("seen"), F.concat(a["out"], F.array(F.when(a["seen"] == 0, -1).otherwise(-a["seen"]))).alias("out"))).otherwise(F.struct((a["seen"] + 1).alias("seen"), F.concat(a["out"], F.array(a["seen"])).alias("out")))
    return F.aggregate(letters(aln_ref), start, step)["out"]


def nucleotides(variants: DataFrame, keys: list[str], weight: str = "n_reads") -> DataFrame:
    """(keys, pos, base, n): the pileup. Columns of insertions have no position and are left out."""
    # the k-th reference base is at the k-th column that isn't a gap, so positions are ranks within the filtered columns
    pairs = F.filter(F.arrays_zip(letters(F.col("aln_seq")).alias("base"), letters(F.col("aln_ref")).alias("ref")), lambda x: x["ref"] != "-")
    long = variants.select(*keys, weight, F.posexplode(pairs).alias("pos", "x"))
    return long.groupBy(*keys, "pos", F.col("x.base").alias("base")).agg(F.sum(weight).alias("n"))


def percents(counts: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` with pct = 100 n / total of the key; 0 where there are no reads."""
    met = counts.join(totals.select(*keys, F.col("n_reads").alias("_total")), keys, "left")
    return met.withColumn("pct", F.when(F.coalesce("_total", F.lit(0)) > 0, 100.0 * F.col("n") / F.col("_total")).otherwise(F.lit(0.0))).drop("_total")


def sizes(variants: DataFrame, keys: list[str], weight: str = "n_reads") -> DataFrame:
    """(keys, kind, size, n): histogram of bases inserted, deleted and substituted in the window; size 0 included."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"edits.{k}_n").alias("size")) for k in ("insertion", "deletion", "substitution")])
    return variants.select(*keys, weight, F.explode(kinds).alias("x")).groupBy(*keys, "x.kind", "x.size").agg(F.sum(weight).alias("n"))


def zero_filled(histogram: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """A histogram with every size from low to high for each key."""
    bins = histogram.select(*keys).distinct().withColumn("size", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return bins.join(histogram, [*keys, "size"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mean_sizes(variants: DataFrame, keys: list[str], kind: str, weight: str = "n_reads") -> DataFrame:
    """(keys, pos, mean_size): mean size of the insertions or deletions that touch each position."""
    spans = F.arrays_zip(F.col(f"edits.{kind}_coordinates").alias("c"), F.col(f"edits.{kind}_sizes").alias("size"))
    end = F.col("x.c.end") if kind == "insertion" else F.col("x.c.end") - 1  # a deletion's range is half-open
    long = variants.select(*keys, weight, F.explode(spans).alias("x")).where(end >= F.col("x.c.start")).select(*keys, weight, F.col("x.size").alias("size"), F.explode(F.sequence(F.col("x.c.start"), end)).alias("pos"))
    return long.groupBy(*keys, "pos").agg((F.sum(F.col("size") * F.col(weight)) / F.sum(weight)).alias("mean_size"))


def percentile_cut(histogram: DataFrame, keys: list[str], share: float = 0.99) -> DataFrame:
    """(keys, cut): the first size at which the running count exceeds ``share`` of all reads."""
    from pyspark.sql import Window as W

    run = histogram.withColumn("_run", F.sum("n").over(W.partitionBy(*keys).orderBy("size"))).withColumn("_all", F.sum("n").over(W.partitionBy(*keys)))
    return run.where(F.col("_run") > share * F.col("_all")).groupBy(*keys).agg(F.min("size").alias("cut"))


def base_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref_base, base, n) summed from (keys, pos, ref_base, base, n)."""
    return changes.groupBy(*keys, "ref_base", "base").agg(F.sum("n").alias("n"))


def selected(pileup: DataFrame, ref_bases: DataFrame, target: str) -> DataFrame:
    """The pileup at positions whose reference base is ``target``; ref_bases: (keys, pos, ref_base)."""
    return pileup.join(ref_bases.where(F.col("ref_base") == target), [c for c in ref_bases.columns if c != "ref_base"])


def other_shares(pileup: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Of the bases other than the target, each one's share at its position."""
    from pyspark.sql import Window as W

    others = pileup.where(~F.col("base").isin(target))
    return others.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "pos")))


def conversion_rates(pileup: DataFrame, keys: list[str], ref_bases: DataFrame, source: str, target: str) -> DataFrame:
    """(keys, pos, rate): target / (source + target) at positions of the source base."""
    at = selected(pileup, ref_bases, source)
    sums = at.groupBy(*keys, "pos").agg(F.sum(F.when(F.col("base") == target, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("base").isin(source, target), F.col("n")).otherwise(0)).alias("a"))
    return sums.select(*keys, "pos", F.when(F.col("a") > 0, F.col("t") / F.col("a")).otherwise(F.lit(0.0)).alias("rate"))
