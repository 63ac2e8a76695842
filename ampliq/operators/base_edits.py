"""Combinations of base edits within reads, and queries on combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import letters, values_at_reference


def _cells(source: str, target: str, positions: list[int] | Column | None) -> Column:
    """For each reference position with the source base (among ``positions``, numbers or a column of arrays): what was read there, and its code.

    R: the reference base, T: the target base, D: deleted, I: bases inserted behind it, N: another base."""
    code = lambda v: F.when(v == source, "R").when(v == target, "T").when(v == "-", "D").when(F.length(v) != 1, "I").otherwise("N")
    values = values_at_reference(F.col("aln_seq"), F.col("aln_ref"))
    pairs = F.zip_with(values, letters(F.translate("aln_ref", "-", "")), lambda v, r: F.struct(v.alias("value"), r.alias("base")))
    placed = F.transform(pairs, lambda x, k: F.struct(k.alias("pos"), x["base"].alias("base"), x["value"].alias("value"), code(x["value"]).alias("code")))
    among = (lambda pos: F.lit(True)) if positions is None else (lambda pos: F.array_contains(positions, pos)) if isinstance(positions, Column) else (lambda pos: pos.isin(positions))
    return F.filter(placed, lambda x: (x["base"] == source) & among(x["pos"]))


def combinations(alleles: DataFrame, keys: list[str], source: str, target: str, weight: str = "n_reads", form: str = "category", positions: list[int] | Column | None = None) -> DataFrame:
    """(keys, combination, n_reads): at each position of the source base what was read, a text a read.

    ``form``: category, a letter a position (R, T, D, I, N); binary, T where the target base was read and X elsewhere; precise, what was read, joined by commas.
    """
    cells = _cells(source, target, positions)
    texts = {
        "category": F.array_join(F.transform(cells, lambda x: x["code"]), ""), "binary": F.array_join(F.transform(cells, lambda x: F.when(x["code"] == "T", "T").otherwise("X")), ""),
        "precise": F.array_join(F.transform(cells, lambda x: x["value"]), ","),
    }
    return alleles.groupBy(*keys, texts[form].alias("combination")).agg(F.sum(weight).alias(weight))


def base_edit_counts(alleles: DataFrame, keys: list[str], source: str, target: str, weight: str = "n_reads", positions: list[int] | Column | None = None) -> dict[str, DataFrame]:
    """The tables on base edits within reads, from alleles with n_deleted and n_inserted: reads by combination in each form and whether the read has an
    insertion or deletion; reads by position and code; and reads whose positions are all the reference's, all the target's, or neither."""
    marked = alleles.withColumn("has_indel", (F.col("n_deleted") > 0) | (F.col("n_inserted") > 0))
    out = {form: combinations(marked, [*keys, "has_indel"], source, target, weight, form, positions) for form in ("binary", "category", "precise")}
    names = {"R": "reference", "T": "target", "D": "deletion", "I": "insertion", "N": "other"}
    cells = marked.select(*keys, weight, F.explode(_cells(source, target, positions)).alias("x"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col(weight))), F.lit(0)).cast("long")
    out["positions"] = cells.groupBy(*keys, F.col("x.pos").alias("pos")).agg(F.sum(weight).alias("total"), *[count(F.col("x.code") == c).alias(n) for c, n in names.items()])
    whole = out["category"].withColumn("kind", F.when(F.col("combination").rlike("^R*$"), "reference").when(F.col("combination").rlike("^T+$"), "target").otherwise("other"))
    sums = [count((F.col("kind") == k) & (F.col("has_indel") == i)).alias(k + ("_indels" if i else "")) for k in ("reference", "target", "other") for i in (False, True)]
    out["reads"] = whole.groupBy(*keys).agg(*sums) if keys else whole.agg(*sums)
    return out


def membership(combined: DataFrame, weight: str = "n_reads") -> DataFrame:
    """Combinations with the number of converted positions (degree) and their rank by reads."""
    degree = F.length(F.regexp_replace("combination", "[^T]", ""))
    return combined.withColumn("degree", degree).withColumn("rank", F.rank().over(W.orderBy(F.desc(weight))))


def subset(members: DataFrame, min_size: int | None = None, max_size: int | None = None, max_rank: int | None = None, min_degree: int | None = None, max_degree: int | None = None, weight: str = "n_reads", present: tuple[int, ...] = (), absent: tuple[int, ...] = ()) -> DataFrame:
    """The combinations within the given limits, largest first: with the target base at all ``present`` positions (numbers within the combination), at none of
    the ``absent`` ones."""
    # the test waits for the sums: Spark would otherwise make the combinations of all reads twice, once below their aggregation
    target = lambda k: F.when(F.col(weight).isNotNull(), F.substring("combination", k + 1, 1)) == "T"
    for k in present:
        members = members.where(target(k))
    for k in absent:
        members = members.where(~target(k))
    for column, low, high in ((weight, min_size, max_size), ("rank", None, max_rank), ("degree", min_degree, max_degree)):
        if low is not None:
            members = members.where(F.col(column) >= low)
        if high is not None:
            members = members.where(F.col(column) <= high)
    return members.orderBy(F.desc(weight), "combination")
