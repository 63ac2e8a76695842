"""Edits by guide, and consensus of guides over samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_guide(variants: DataFrame, windows: dict[str, list[int]], keys: list[str], weight: str = "n_reads") -> DataFrame:
    """(keys, category, n_reads): MODIFIED and the sorted names of the guides in whose windows a read is edited, or UNMODIFIED."""
    edited = F.concat("edits.all_substitution_positions", "edits.all_deletion_positions", "edits.all_insertion_positions")
    hits = F.array_compact(F.array(*[F.when(F.arrays_overlap(edited, F.array(*map(F.lit, w))), F.lit(n)) for n, w in sorted(windows.items())]))
    category = F.when(F.size(hits) > 0, F.concat(F.lit("MODIFIED "), F.array_join(hits, " + "))).otherwise("UNMODIFIED")
    return variants.withColumn("category", category).groupBy(*keys, "category").agg(F.sum(weight).alias(weight))


def agree(guides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agree): whether all samples of a key have the same guides and windows; guides: (keys, sample, guide, window)."""
    sets = guides.groupBy(*keys, "sample").agg(F.array_sort(F.collect_set(F.struct("guide", "window"))).alias("s"))
    return sets.groupBy(*keys).agg((F.count_distinct("s") == 1).alias("agree"))
