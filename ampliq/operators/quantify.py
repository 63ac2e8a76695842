"""Rates of editing, classes of reads, frameshifts and splice sites, and statistics of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .edits import modified
from .positions import ref_positions

#: The seven exclusive combinations of kinds, by name.
COMBINATIONS = {
    "only_insertions": (1, 0, 0), "only_deletions": (0, 1, 0), "only_substitutions": (0, 0, 1), "insertions_and_deletions": (1, 1, 0),
    "insertions_and_substitutions": (1, 0, 1), "deletions_and_substitutions": (0, 1, 1), "insertions_deletions_and_substitutions": (1, 1, 1),
}


def _has(kind: str, ignore: tuple[str, ...]) -> Column:
    return F.lit(False) if kind in ignore else F.col(f"edits.{kind}_n") > 0


def editing(variants: DataFrame, keys: list[str], ignore: tuple[str, ...] = (), weight: str = "n_reads", discard_indels: bool = False) -> DataFrame:
    """Reads per key: all, modified, unmodified, discarded, with each kind of edit and with each combination, and percents.

    ``discard_indels`` sets reads with an insertion or deletion aside: they count as discarded and nowhere else.
    """
    flags = {k: _has(k, ignore) for k in ("insertion", "deletion", "substitution")}
    gone = (flags["insertion"] | flags["deletion"]) if discard_indels else F.lit(False)
    count = lambda test: F.coalesce(F.sum(F.when(test & ~gone, F.col(weight))), F.lit(0)).cast("long")
    combined = {n: (flags["insertion"] == bool(i)) & (flags["deletion"] == bool(d)) & (flags["substitution"] == bool(s)) for n, (i, d, s) in COMBINATIONS.items()}
    out = variants.groupBy(*keys).agg(
        count(F.lit(True)).alias("n_reads"), count(modified(ignore)).alias("modified"), count(~modified(ignore)).alias("unmodified"),
        F.coalesce(F.sum(F.when(gone, F.col(weight))), F.lit(0)).cast("long").alias("discarded"),
        *[count(test).alias(f"{k}s") for k, test in flags.items()], *[count(test).alias(n) for n, test in combined.items()],
    )
    percent = lambda c: F.when(F.col("n_reads") > 0, 100.0 * F.col(c) / F.col("n_reads"))
    return out.withColumn("modified_pct", percent("modified")).withColumn("unmodified_pct", percent("unmodified"))


def class_counts(variants: DataFrame, keys: list[str], weight: str = "n_reads", discard_indels: bool = False) -> DataFrame:
    """(keys, class_name, n): reads by reference and whether they are modified. ``discard_indels`` puts those with an insertion or deletion into a class
    DISCARDED_ and the reference."""
    name = F.concat("ref_name", F.when(modified(), "_MODIFIED").otherwise("_UNMODIFIED"))
    if discard_indels:
        name = F.when(_has("insertion", ()) | _has("deletion", ()), F.concat(F.lit("DISCARDED_"), "ref_name")).otherwise(name)
    return variants.groupBy(*keys, name.alias("class_name")).agg(F.sum(weight).cast("long").alias("n"))


def ordered_classes(counts: DataFrame, keys: list[str], refs: list[str]) -> DataFrame:
    """``class_counts`` with ``rank``: classes in the order of their references, unmodified before modified, then by name. A key has two or three classes a
    reference."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(refs) for x in (r, k)])
    ref = F.regexp_replace(F.regexp_replace("class_name", "^DISCARDED_", ""), "_(UN)?MODIFIED$", "")
    spans = W.partitionBy(*keys).orderBy(F.coalesce(F.element_at(order, ref), F.lit(len(refs))), F.col("class_name").endswith("_MODIFIED"), "class_name")
    return counts.withColumn("rank", F.row_number().over(spans))


def top_unaligned(unaligned: DataFrame, n_total: Column, considered: int = 10_000, rows: int = 10, least_aligned: float = 0.5, seq: str = "seq", order: str = "ord") -> DataFrame:
    """(seq, n_reads): the most frequent of the first ``considered`` unaligned reads, where less than ``least_aligned`` of all reads are aligned; else nothing."""
    few = F.broadcast(unaligned.agg(F.count(F.lit(1)).alias("_n")).where(n_total - F.col("_n") < least_aligned * n_total))  # one row or none
    first = unaligned.orderBy(order).limit(considered).groupBy(seq).agg(F.count(F.lit(1)).alias("n_reads"))
    return first.orderBy(F.desc("n_reads"), seq).limit(rows).crossJoin(few).drop("_n")


def run_statistics(variants: DataFrame, unaligned: DataFrame, weight: str = "n_reads") -> DataFrame:
    """One row: reads in and aligned, distinct reads, and sums of edits in and outside the window and of irregular ends."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long") * F.col(weight)), F.lit(0)).alias(c.split(".")[-1])
    a = variants.agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("n_aligned"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.col(weight) - 1), F.lit(0)).alias("n_repeats"),
        *[total(f"edits.{c}") for c in ("substitution_n", "substitutions_outside_window", "mods_in_window", "mods_outside_window")],
        F.coalesce(F.sum(F.when(F.col("edits.irregular_ends"), F.col(weight))), F.lit(0)).alias("irregular_ends"), F.max(F.length("aln_seq")).alias("read_length"),
    )
    return a.crossJoin(unaligned.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n_unaligned"))).withColumn("n_total", F.col("n_aligned") + F.col("n_unaligned"))


def frames(variants: DataFrame, keys: list[str], exon: Column, splicing: Column, length_change: Column | None = None, weight: str = "n_reads") -> DataFrame:
    """Modified reads whose exons change length by a multiple of three (in frame) or not (frameshift), or not at all (non-coding), and
    reads with an edit on a splice site. ``exon`` and ``splicing`` are arrays of positions; a repair template's own change is added."""
    inserted = F.aggregate(
        F.filter(F.arrays_zip(F.col("edits.insertion_coordinates").alias("c"), F.col("edits.insertion_sizes").alias("n")), lambda x: F.array_contains(exon, x["c"]["start"])), F.lit(0), lambda s, x: s + x["n"]
    )
    deleted = F.size(F.array_intersect("edits.deletion_positions", exon))
    touched = F.arrays_overlap("edits.substitution_positions", exon) | (deleted > 0) | (inserted > 0)
    change = inserted - deleted + (F.lit(0) if length_change is None else length_change)
    spliced = F.arrays_overlap(F.concat("edits.deletion_positions", "edits.insertion_positions", "edits.substitution_positions"), splicing)
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col(weight))), F.lit(0)).cast("long")
    rows = variants.withColumn("_change", change).withColumn("_coding", touched).withColumn("_mod", modified())
    return rows.groupBy(*keys).agg(
        count(F.col("_mod") & F.col("_coding") & (F.pmod("_change", F.lit(3)) != 0)).alias("frameshift"), count(F.col("_mod") & F.col("_coding") & (F.pmod("_change", F.lit(3)) == 0)).alias("in_frame"),
        count(F.col("_mod") & ~F.col("_coding")).alias("non_coding"), count(F.coalesce(spliced, F.lit(False))).alias("splice_sites"),
    )


def over_references(frames_by_reference: DataFrame, rates: DataFrame, keys: list[str], template: str | None = None) -> DataFrame:
    """``frames`` summed over references (keys, ref_name, ...). All unmodified reads of a repair template count as edited outside of exons: each is a repair."""
    met = frames_by_reference.join(rates.select(*keys, "ref_name", "unmodified"), [*keys, "ref_name"], "left")
    repaired = F.when(F.col("ref_name") == template, F.coalesce("unmodified", F.lit(0))).otherwise(0) if template else F.lit(0)
    sums = [F.sum(c).alias(c) for c in ("frameshift", "in_frame")] + [F.sum(F.col("non_coding") + repaired).alias("non_coding"), F.sum("splice_sites").alias("splice_sites")]
    return met.groupBy(*keys).agg(*sums)


def base_qualities(aligned: DataFrame, keys: list[str], pos: int, original: str, target: str, least: int) -> DataFrame:
    """(keys, total, and eight counts): what the reads (aln_seq, aln_ref, qual) have at a reference position: the original base, the target or another one, with a
    quality of at least ``least`` (high) or less (low), or nothing (deleted). A position beyond a read's alignment counts in the total alone."""
    at = F.array_position(ref_positions(F.col("aln_ref")), F.lit(pos)).cast("int")
    base = F.substring(F.col("aln_seq"), F.col("_at"), F.lit(1))
    quality = F.ascii(F.substring(F.col("qual"), F.length(F.translate(F.substring(F.col("aln_seq"), F.lit(1), F.col("_at")), "-", "")), F.lit(1))) - 33
    rows = aligned.withColumn("_at", at).withColumn("_base", F.when(F.col("_at") > 0, base)).withColumn("_high", quality >= least)
    kinds = {"original": F.col("_base") == original, "target": F.col("_base") == target, "other": ~F.col("_base").isin(original, target, "-")}
    counts = [F.count_if(test & (F.col("_high") if level == "high" else ~F.col("_high"))).alias(f"{k}_{level}") for k, test in kinds.items() for level in ("high", "low")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if(F.col("_base") == "-").alias("deleted"))


# Thresholds of the checks on a run.
GUARDRAILS = {"total_reads": 10000, "aligned_share": 0.9, "share_in_window": 0.01, "ends_modified": 0.01, "outside_window_substitutions": 0.002, "substitution_rate": 0.3, "guide_length": 19, "amplicon_length": 50, "amplicon_to_read_length": 1.5}


def guardrails(stats: DataFrame, by_reference: DataFrame, amplicons: dict[str, int], guides: dict[str, int], limits: dict | None = None) -> DataFrame:
    """(check, subject, value, limit, raised): the ten checks of a run; a check whose share has nothing below it gives no row.

    stats: of ``run_statistics``; by_reference: (ref_name, n_reads); amplicons and guides: their lengths by name. Checks of one amplicon or guide name it as
    subject. Reads are spread unevenly where an amplicon has at most the aligned share's limit of its expected reads, or at least the
    rest of them: that limit, not one of its own, is what published runs use. The read length is the longest aligned read's, gaps included.
    """
    lim = GUARDRAILS | (limits or {})
    row = lambda check, subject, value, limit, raised: F.struct(F.lit(check).alias("check"), F.lit(subject).cast("string").alias("subject"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), raised.alias("raised"))
    share = lambda a, b: F.when(b > 0, a / b)
    mods = F.col("mods_in_window") + F.col("mods_outside_window")
    subs = F.col("substitution_n") + F.col("substitutions_outside_window")
    at_most = lambda name, v: row(name, None, v, lim[name], v <= lim[name])
    at_least = lambda name, v: row(name, None, v, lim[name], v >= lim[name])
    checks = [
        row("total_reads", None, F.col("n_total"), lim["total_reads"], F.col("n_total") < lim["total_reads"]),
        at_most("aligned_share", share(F.col("n_aligned"), F.col("n_total"))), at_most("share_in_window", share(F.col("mods_in_window"), mods)),
        at_least("ends_modified", share(F.col("irregular_ends"), F.col("n_aligned"))), at_least("outside_window_substitutions", share(F.col("substitutions_outside_window"), subs)),
        at_least("substitution_rate", share(subs, mods)),
        *[row("amplicon_length", k, F.lit(n), lim["amplicon_length"], F.lit(n < lim["amplicon_length"])) for k, n in sorted(amplicons.items())],
        *[row("guide_length", k, F.lit(n), lim["guide_length"], F.lit(n < lim["guide_length"])) for k, n in sorted(guides.items())],
        *[row("amplicon_to_read_length", k, share(F.lit(n), F.col("read_length")), lim["amplicon_to_read_length"], F.col("read_length") * lim["amplicon_to_read_length"] < n) for k, n in sorted(amplicons.items())],
    ]
    out = stats.select(F.explode(F.array(*checks)).alias("x")).select("x.*").where("value IS NOT NULL")
    if len(amplicons) < 2:
        return out
    spark, limit = stats.sparkSession, lim["aligned_share"]
    names = spark.createDataFrame([(k,) for k in sorted(amplicons)], "subject string")  # tens
    counts = names.join(by_reference.select(F.col("ref_name").alias("subject"), "n_reads"), "subject", "left").withColumn("_n", F.coalesce("n_reads", F.lit(0)))
    met = counts.crossJoin(F.broadcast(stats.select((F.col("n_total") / len(amplicons)).alias("_expected"))))  # one row
    value = F.when(F.col("_expected") > 0, F.col("_n") / F.col("_expected"))
    spread = (F.col("_n") <= F.col("_expected") * limit) | (F.col("_n") >= F.col("_expected") * (1 - limit))
    return out.union(met.select(F.lit("proportion"), "subject", value.cast("double"), F.lit(float(limit)), spread).where(value.isNotNull()))
