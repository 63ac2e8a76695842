"""Tables over many samples: one plan keyed by sample, nothing per sample on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(variants: DataFrame, keys: list[str], weight: str = "n_reads") -> DataFrame:
    return variants.groupBy(*keys).agg(F.sum(weight).alias("n_reads"))


def fractions(positions: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by position with their share of the reads of their key."""
    met = positions.join(totals.select(*keys, F.col("n_reads").alias("_all")), keys)
    return met.withColumn("fraction", F.col("n") / F.col("_all")).drop("_all")


def of_several(positions: DataFrame, keys: list[str], source: str, least: int = 2) -> DataFrame:
    """The rows of keys that at least so many sources have: what one source has alone isn't put beside others."""
    enough = positions.groupBy(*keys).agg(F.count_distinct(source).alias("_n")).where(F.col("_n") >= least).select(*keys)
    return positions.join(enough, keys, "left_semi")


def summary(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Rates per reference summed to samples or regions, with percents of the sums."""
    sums = [c for c, t in rates.dtypes if t == "bigint"]
    out = rates.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    percent = lambda c: F.when(F.col("n_reads") > 0, 100.0 * F.col(c) / F.col("n_reads"))
    return out.withColumn("modified_pct", percent("modified")).withColumn("unmodified_pct", percent("unmodified"))


def amplicon_information(used: DataFrame, amplicon: str, sample: str) -> DataFrame:
    """Each amplicon with how many samples use it, and which."""
    return used.groupBy(amplicon).agg(F.count(F.lit(1)).alias("n_samples"), F.array_join(F.array_sort(F.collect_set(sample)), ",").alias("samples"))


def amplicon_names(given: list[tuple[str, str]], longest: int = 21) -> dict[str, str]:
    """A short unique name for each amplicon sequence, from (sequence, name) in order: the shared name, cut to ``longest`` characters, with a number where
    names clash. Driver-side: there are tens of amplicons."""
    out: dict[str, str] = {}
    for seq, name in given:
        if seq in out:
            continue
        base = name[:longest]
        found, k = base, 1
        while found in out.values():
            k += 1
            found = f"{base}_{k}"
        out[seq] = found
    return out
