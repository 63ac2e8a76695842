"""Comparison of two samples: allele tables, per-position tests, rates."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLELE_KEYS = ["aln_seq", "aln_ref", "unedited", "n_deleted", "n_inserted", "n_mutated"]
PSEUDO = 0.1


def merged_alleles(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two allele tables (keys, n_reads, pct_reads) with zeros for what is missing, and the log ratio of the percents."""
    side = lambda df, k: df.select(*keys, F.col("n_reads").alias(f"n_reads_{k}"), F.col("pct_reads").alias(f"pct_reads_{k}"))
    met = side(a, 1).join(side(b, 2), keys, "full_outer")
    met = met.withColumns({c: F.coalesce(c, F.lit(0).cast(t)) for c, t in met.dtypes if c not in keys})
    return met.withColumn("lfc", log_fold_change(F.col("pct_reads_1"), F.col("pct_reads_2")))


def two_samples(alleles: DataFrame, keys: list[str], first: str, second: str, sample: str = "sample") -> DataFrame:
    """``merged_alleles`` of two samples of one table, in one pass over it: each key's reads and percents of either sample, side by side."""
    pick = lambda c, s: F.coalesce(F.sum(F.when(F.col(sample) == s, F.col(c))), F.lit(0)).cast(dict(alleles.dtypes)[c])
    named = {f"{c}_{k}": pick(c, s) for k, s in ((1, first), (2, second)) for c in ("n_reads", "pct_reads")}
    met = alleles.where(F.col(sample).isin(first, second)).groupBy(*keys).agg(*[v.alias(n) for n, v in sorted(named.items())])
    return met.withColumn("lfc", log_fold_change(F.col("pct_reads_1"), F.col("pct_reads_2")))


def matching_alleles(first: DataFrame, second: DataFrame) -> DataFrame:
    """(sequence, file_1, file_2): allele files of two runs that can be compared: of amplicons with one sequence, the same cuts and a guide in common.

    first, second: (sequence, guides, cuts, files), arrays in the order of the guides. Files pair by place; what one run has more is left out."""
    side = lambda df, k: df.select("sequence", *[F.col(c).alias(f"{c}_{k}") for c in ("guides", "cuts", "files")])
    met = side(first, 1).join(side(second, 2), "sequence").where((F.col("cuts_1") == F.col("cuts_2")) & F.arrays_overlap("guides_1", "guides_2"))
    pairs = met.select("sequence", F.explode(F.arrays_zip("files_1", "files_2")).alias("x")).select("sequence", F.col("x.files_1").alias("file_1"), F.col("x.files_2").alias("file_2"))
    return pairs.where("file_1 IS NOT NULL AND file_2 IS NOT NULL")


def log_fold_change(a: Column, b: Column) -> Column:
    return F.log2((a + PSEUDO) / (b + PSEUDO))


def most_changed(merged: DataFrame, rows: int) -> DataFrame:
    """The alleles most enriched in the first sample and those most enriched in the second. Each side is a top-k of its own; the merged table is
    an aggregate, so that its shuffle is planned once and used by both."""
    side = lambda name, order: merged.orderBy(order, "aln_seq", "aln_ref").limit(rows).withColumn("side", F.lit(name))
    return side("first", F.desc("lfc")).unionByName(side("second", F.asc("lfc")))


def _log_binomial(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


#: Terms that are such a share of the first of a sum add nothing to it.
NEGLIGIBLE = 1e-17
TERMS = 4096


def _sum_from(k: int, up: bool, rows: int, other: int, first: int) -> float:
    """The likelihoods of the tables from ``k`` outward in one direction, over that of ``k``: running products of the ratios of neighbours, until they no longer count."""
    end, total, term = (min(first, rows) if up else max(0, first - other)), 1.0, 1.0
    while k != end and term > NEGLIGIBLE:
        n = min(TERMS, abs(end - k))
        if up:
            x = np.arange(k, k + n, dtype=np.float64)
            ratios = (rows - x) * (first - x) / ((x + 1) * (other - first + 1 + x))
        else:
            x = np.arange(k, k - n, -1, dtype=np.float64)
            ratios = x * (other - first + x) / ((rows + 1 - x) * (first + 1 - x))
        terms = term * np.cumprod(ratios)
        total += float(terms.sum())
        term, k = float(terms[-1]), k + n if up else k - n
    return total


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """The two-sided p-value of a table of two by two: the tables as likely as this one, or less, with its margins.

    Likelihoods rise to the mode and fall behind it. They are summed outward from three places: the mode, for the whole; this table; and the first table on the other side
    of the mode that is no more likely, found by bisection. A sum takes in some ten standard deviations of tables, which grow with the root of the counts."""
    rows, other, first = a + b, c + d, a + c
    if not rows or not other or not first or not b + d:
        return 1.0
    low, high = max(0, first - other), min(first, rows)
    mode = min(max((rows + 1) * (first + 1) // (rows + other + 2), low), high)
    given = rows, other, first
    log = lambda k: _log_binomial(rows, k) + _log_binomial(other, first - k)
    up = a >= mode
    least = log(a) + 1e-7
    # the tables on the other side of the mode, outward
    others = range(min(mode, a - 1), low - 1, -1) if up else range(max(mode, a + 1), high + 1)
    at = bisect.bisect_left(others, True, key=lambda k: log(k) <= least)
    tail = _sum_from(a, up, *given)
    if at < len(others):
        tail += math.exp(min(0.0, log(others[at]) - log(a))) * _sum_from(others[at], not up, *given)
    whole = _sum_from(mode, True, *given) + _sum_from(mode, False, *given) - 1
    return min(1.0, math.exp(min(0.0, log(a) - log(mode))) * tail / whole)


def position_tests(counts: DataFrame, totals: DataFrame, keys: list[str], positions: DataFrame, first: str, second: str, sample: str = "sample", of_total: list[str] | None = None) -> DataFrame:
    """(keys, pos, n_1, n_2, p, q): per position Fisher's exact test of modified against other reads of two samples, with Bonferroni's correction.

    counts: (sample, keys, pos, n); totals: (sample, of_total, n_reads), where ``of_total`` are those of the keys that reads are summed by. Both samples are taken from either
    table in one pass. ``positions`` has every (keys, pos) to test; the correction is by the number of positions of the key."""
    of_total = keys if of_total is None else of_total
    pick = lambda c, s, n: F.sum(F.when(F.col(sample) == s, F.col(c)).otherwise(0)).alias(n)
    both = lambda df, by, c, n: df.where(F.col(sample).isin(first, second)).groupBy(*by).agg(pick(c, first, f"{n}_1"), pick(c, second, f"{n}_2"))
    met = positions.join(both(counts, [*keys, "pos"], "n", "n"), [*keys, "pos"], "left").join(both(totals, of_total, "n_reads", "all"), of_total, "left")
    met = met.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_1", "n_2")})
    m = positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("tests"))

    @F.pandas_udf("double")
    def p_value(n1: pd.Series, r1: pd.Series, n2: pd.Series, r2: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(n1, r1, n2, r2, strict=True)])

    rest = lambda k: F.greatest(F.coalesce(f"all_{k}", F.lit(0)) - F.col(f"n_{k}"), F.lit(0))
    tested = met.withColumn("p", p_value("n_1", rest(1), "n_2", rest(2))).join(m, keys)
    return tested.select(*keys, "pos", "n_1", "n_2", "p", F.least(F.lit(1.0), F.col("p") * F.col("tests")).alias("q"))


def significant(tests: DataFrame, keys: list[str], cutoff: float = 0.05, window: list[int] | None = None) -> DataFrame:
    """Numbers of significant positions, over the whole reference and in the window."""
    hit = F.col("q") <= cutoff
    inside = F.col("pos").isin(window) if window else F.lit(True)
    return tests.groupBy(*keys).agg(F.sum(hit.cast("long")).alias("n_significant"), F.sum((hit & inside).cast("long")).alias("n_significant_window"))


def rate_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Modified and unmodified percents of two samples' rates side by side, and their differences; every row of the first stays."""
    side = lambda df, k: df.select(*keys, *[F.col(c).alias(f"{c}_{k}") for c in ("modified_pct", "unmodified_pct", "n_reads")])
    met = side(a, 1).join(side(b, 2), keys, "left")
    return met.withColumn("modified_diff", F.col("modified_pct_1") - F.col("modified_pct_2")).withColumn("unmodified_diff", F.col("unmodified_pct_1") - F.col("unmodified_pct_2"))
