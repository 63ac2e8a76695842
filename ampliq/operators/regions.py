"""Mapped reads and regions: demultiplexing, interval joins, trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the bins in which intervals of one chromosome meet.
BIN = 10_000
#: Bases in a block of a genome.
BLOCK = 1 << 16


def overlapping(a: DataFrame, b: DataFrame, chrom: str, start: tuple[str, str], end: tuple[str, str], width: int = BIN, how: str = "inner") -> DataFrame:
    """Rows of ``a`` and ``b`` of one chromosome whose closed intervals overlap, each pair once.

    Intervals meet in bins, so the join is on (chromosome, bin) and stays linear in what overlaps; a pair is kept in the bin in
    which the later of its two starts lies.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(F.col(s), F.col(e)) / width)))
    left = a.withColumn("_bin", bins(start[0], end[0]))
    right = b.withColumn("_bin", bins(start[1], end[1]))
    met = left.join(right, [chrom, "_bin"]).where((F.col(start[1]) <= F.col(end[0])) & (F.col(start[0]) <= F.col(end[1])) & (F.floor(F.greatest(start[0], start[1]) / width) == F.col("_bin")))
    return met.drop("_bin")


def gene_names(regions: DataFrame, genes: DataFrame, region_keys: list[str], chrom: str, start: tuple[str, str], end: tuple[str, str], name: str) -> DataFrame:
    """Every region with the sorted, comma-joined names of the genes it overlaps; null where there is none."""
    hits = overlapping(regions, genes, chrom, start, end).groupBy(*region_keys).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("genes"))
    return regions.join(hits, region_keys, "left")


def demultiplexed(mapped: DataFrame, chrom: str, start: str, end: str) -> DataFrame:
    """Reads per location."""
    return mapped.groupBy(chrom, start, end).agg(F.count(F.lit(1)).alias("n_reads"))


def enough(counts: DataFrame, least: int, strict: bool, n: str = "n_reads") -> DataFrame:
    """Regions or samples with enough reads; whether the limit itself is enough depends on the mode."""
    return counts.where(F.col(n) > least if strict else F.col(n) >= least)


def unmatched(regions: DataFrame, amplicons: DataFrame, keys: list[str]) -> DataFrame:
    return regions.join(amplicons, keys, "left_anti")


def excluding_flags(records: DataFrame, mask: int) -> DataFrame:
    return records.where(F.col("flag").bitwiseAND(F.lit(mask)) == 0)


def _once(value: Column) -> Column:
    """A column that is worked out where it stands. A filter on a plain one is moved below all that derives it, and derives it there again, for each time it is named."""
    return F.explode_outer(F.array(value))


def spanning(records: DataFrame, regions: DataFrame, chrom: str = "chr") -> DataFrame:
    """Records with each region that they cover entirely.

    records: chr, pos (1-based), cigar, seq; regions: chr, bpstart, bpend (1-based, inclusive), name."""
    from ..functions.sequences import cigar_length

    ends = records.withColumn("_end", _once(F.col("pos") + cigar_length(F.col("cigar"), "MDN=X") - 1))
    return overlapping(ends, regions, chrom, ("pos", "bpstart"), ("_end", "bpend")).where((F.col("pos") <= F.col("bpstart")) & (F.col("_end") >= F.col("bpend"))).drop("_end")


def trimmed(met: DataFrame) -> DataFrame:
    """Records of ``spanning`` cut to their regions: the read bases at and between the region's end positions; none where an end lies on no base."""
    met = met.withColumn("_runs", _once(_laid_runs(F.col("pos"), F.col("cigar"))))
    met = met.withColumn("_first", _offset(F.col("_runs"), F.col("bpstart"))).withColumn("_last", _offset(F.col("_runs"), F.col("bpend"))).where(F.col("_first").isNotNull() & F.col("_last").isNotNull())
    return met.withColumn("seq", F.substring(F.col("seq"), F.col("_first") + 1, F.col("_last") - F.col("_first") + 1)).drop("_first", "_last", "_runs")


def covering(records: DataFrame, regions: DataFrame, chrom: str = "chr") -> DataFrame:
    """Records that cover a region entirely, cut to it (see ``spanning`` and ``trimmed``)."""
    return trimmed(spanning(records, regions, chrom))


def _laid_runs(pos: Column, cigar: Column) -> Column:
    """A CIGAR's runs with where each begins on the chromosome and in the read: running sums over the runs."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNS=X])"), F.lit(1))
    runs = F.transform(runs, lambda r: F.struct(F.regexp_extract(r, r"^(\d+)", 1).cast("int").alias("n"), F.substring(r, -1, 1).alias("kind")))
    none = F.array().cast("array<struct<kind: string, n: int, ref: bigint, read: int>>")
    start = F.struct(pos.cast("long").alias("ref"), F.lit(0).alias("read"), none.alias("out"))

    def step(a, r):
        on_ref, in_read = r["kind"].isin("M", "=", "X", "D", "N"), r["kind"].isin("M", "=", "X", "S", "I")
        laid = F.struct(r["kind"].alias("kind"), r["n"].alias("n"), a["ref"].alias("ref"), a["read"].alias("read"))
        return F.struct((a["ref"] + F.when(on_ref, r["n"]).otherwise(0)).alias("ref"), (a["read"] + F.when(in_read, r["n"]).otherwise(0)).alias("read"), F.concat(a["out"], F.array(laid)).alias("out"))

    return F.aggregate(runs, start, step)["out"]


def read_offset(pos: Column, cigar: Column, at: Column) -> Column:
    """The place (from 0) in a read of the base that lies on a position; null if none does."""
    return _offset(_laid_runs(pos, cigar), at)


def _offset(runs: Column, at: Column) -> Column:
    holds = lambda r: r["kind"].isin("M", "=", "X") & (at >= r["ref"]) & (at < r["ref"] + r["n"])
    run = F.get(F.filter(runs, holds), F.lit(0))
    return (run["read"] + at - run["ref"]).cast("int")


def read_offsets(pos: Column, cigar: Column) -> Column:
    """For each base of a read its position on the chromosome; null for clipped and inserted ones."""
    none = F.array().cast("array<bigint>")
    laid = F.filter(_laid_runs(pos, cigar), lambda r: r["n"] > 0)
    return F.flatten(F.transform(laid, lambda r: F.when(r["kind"].isin("M", "=", "X"), F.sequence(r["ref"], r["ref"] + r["n"] - 1)).when(r["kind"].isin("S", "I"), F.array_repeat(F.lit(None).cast("long"), r["n"])).otherwise(none)))


def in_blocks(contigs: DataFrame, chrom: str = "chr", width: int = BLOCK) -> DataFrame:
    """(chr, block, bases) of contigs (chr, seq): block k has the bases from k * width on, in capitals."""
    cut = contigs.where(F.length("seq") > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 1) / width))))
    return cut.select(chrom, "block", F.upper(F.substring(F.col("seq"), (F.col("block") * width + 1).cast("int"), F.lit(width))).alias("bases"))


def fetched(genome: DataFrame, ranges: DataFrame, chrom: str = "chr", width: int = BLOCK) -> DataFrame:
    """Reference bases of each different row of ``ranges`` (chr, start, end): 0-based, half-open; empty where the contig has none.

    genome: blocks (chr, block, bases), or whole contigs (chr, seq), which are cut first. A range meets the blocks it lies in and no others."""
    blocks = genome if "block" in genome.columns else in_blocks(genome, chrom, width)
    names = ranges.columns
    start, end = F.greatest(F.col("start"), F.lit(0)).cast("long"), F.col("end").cast("long")
    wanted = ranges.distinct().withColumn("block", F.explode_outer(F.when(end > start, F.sequence(F.floor(start / width), F.floor((end - 1) / width)))))
    met = wanted.join(blocks.select(chrom, "block", "bases"), [chrom, "block"], "left")
    first = F.greatest(start - F.col("block") * width, F.lit(0))
    part = F.substring(F.col("bases"), (first + 1).cast("int"), (F.least(end - F.col("block") * width, F.lit(width)) - first).cast("int"))
    parts = F.sort_array(F.collect_list(F.when(F.col("bases").isNotNull(), F.struct("block", part.alias("bases")))))
    return met.groupBy(*names).agg(parts.alias("parts")).select(*names, F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("ref_seq"))
