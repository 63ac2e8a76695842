"""Text outputs: tab-separated tables, wide position tables whose header repeats bases, and a run's facts as JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names of the published tables.
ALLELE_NAMES = {"aln_seq": "Aligned_Sequence", "aln_ref": "Reference_Sequence", "ref_name": "Reference_Name", "read_status": "Read_Status", "n_deleted": "n_deleted", "n_inserted": "n_inserted", "n_mutated": "n_mutated", "n_reads": "#Reads", "pct_reads": "%Reads"}
EDITING_NAMES = {
    "ref_name": "Amplicon", "unmodified_pct": "Unmodified%", "modified_pct": "Modified%", "n_reads": "Reads_aligned", "unmodified": "Unmodified", "modified": "Modified", "discarded": "Discarded", "insertions": "Insertions", "deletions": "Deletions",
    "substitutions": "Substitutions", "only_insertions": "Only Insertions", "only_deletions": "Only Deletions", "only_substitutions": "Only Substitutions", "insertions_and_deletions": "Insertions and Deletions",
    "insertions_and_substitutions": "Insertions and Substitutions", "deletions_and_substitutions": "Deletions and Substitutions", "insertions_deletions_and_substitutions": "Insertions Deletions and Substitutions",
}


def _text(c: str, kind: str) -> Column:
    return F.coalesce(F.bround(c, 8).cast("string") if kind == "double" else F.col(c).cast("string"), F.lit("NA"))


def tsv(df: DataFrame, path: str, names: dict[str, str] | None = None) -> None:
    """A tab-separated table with a header; a null is NA, numbers are rounded half to even at the eighth place."""
    names = {c: names.get(c, c) for c in df.columns} if names else {c: c for c in df.columns}
    kinds = dict(df.dtypes)
    df.select(*[_text(c, kinds[c]).alias(n) for c, n in names.items()]).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def wide(counts: DataFrame, bases: DataFrame, path: str, label: str, value: str, first: str = "") -> None:
    """One line per label with a cell per position; the header is the reference's bases. Names repeat, so the lines are text.

    counts: (label, pos, value); bases: (pos, ref_base) of one reference, whose length bounds a line."""
    places = bases.select("pos", "ref_base")
    head = places.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref_base"))), lambda x: x["ref_base"]), "\t").alias("h")).select(F.concat(F.lit(first + "\t"), "h").alias("value"), F.lit("").alias("_k"))
    every = counts.select(label).distinct().crossJoin(F.broadcast(places.select("pos")))
    filled = every.join(counts, [label, "pos"], "left").withColumn("_v", F.coalesce(F.col(value).cast("string"), F.lit("0")))
    rows = filled.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_v"))), lambda x: x["_v"]), "\t").alias("cells"))
    body = rows.select(F.concat_ws("\t", F.col(label).cast("string"), "cells").alias("value"), F.concat(F.lit("x"), F.col(label).cast("string")).alias("_k"))
    head.union(body).repartitionByRange(1, "_k").sortWithinPartitions("_k").select("value").write.text(path)


def tsv_lines(df: DataFrame, table: Column, names: dict[str, str], weight: Column) -> DataFrame:
    """(table, head, weight, line): the lines of many tab-separated tables with their headers; ``table`` names the one that a row belongs to. Rows go by falling weight.

    names: columns and what they are called. A null is NA, numbers are rounded half to even at the eighth place."""
    kinds = dict(df.dtypes)
    rows = df.select(F.coalesce(table, F.lit("")).alias("table"), F.lit(1).alias("head"), weight.cast("long").alias("weight"), F.concat_ws("\t", *[_text(c, kinds[c]) for c in names]).alias("line"))
    heads = rows.select("table").distinct().select("table", F.lit(0).alias("head"), F.lit(0).cast("long").alias("weight"), F.lit("\t".join(names.values())).alias("line"))
    return heads.unionByName(rows)


def wide_lines(counts: DataFrame, tables: DataFrame, refs: DataFrame, labels: list[str], first: str = "") -> DataFrame:
    """(table, head, weight, line): the lines of many tables with a row per label and a cell per position of a reference, whose bases are the header.

    counts: (table, label, pos, value); tables: (table, ref_name), the tables that there are; refs: (ref_name, ref_seq). A position without a count is 0.
    A table's rows are its labels, as many cells each as the reference has bases, so its lines are bounded."""
    bases = refs.select("ref_name", F.regexp_extract_all("ref_seq", F.lit("."), F.lit(0)).alias("bases"))
    every = tables.select(F.coalesce("table", F.lit("")).alias("table"), "ref_name").join(bases, "ref_name")
    held = counts.groupBy("table", "label").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.col("value").cast("string")))).alias("held"))
    asked = every.select("table", "bases", F.posexplode(F.array(*map(F.lit, labels))).alias("k", "label")).join(held, ["table", "label"], "left")
    cells = F.array_join(F.transform("bases", lambda _, k: F.coalesce(F.element_at("held", k), F.lit("0"))), "\t")
    rows = asked.select("table", F.lit(1).alias("head"), (-F.col("k")).cast("long").alias("weight"), F.concat_ws("\t", "label", cells).alias("line"))
    return every.select("table", F.lit(0).alias("head"), F.lit(0).cast("long").alias("weight"), F.concat_ws("\t", F.lit(first), F.array_join("bases", "\t")).alias("line")).unionByName(rows)


def publish_lines(lines: DataFrame, path: str) -> None:
    """Many tables in one job, each in a folder ``table=<name>`` of text files that follow each other by their names. Tables are dealt out by ranges of their
    lines, so that a long one is written by several tasks; the header is the first line of the first file."""
    order = [F.asc("table"), F.asc("head"), F.desc("weight"), F.asc("line")]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("table", F.col("line").alias("value")).write.partitionBy("table").text(path)


def published_lines(spark, path: str) -> DataFrame:
    """(table, value): the lines of all published tables."""
    return spark.read.option("basePath", path).schema("value string, table string").text(path).select("table", "value")


def base_edit_files(tables: dict[str, DataFrame], stem: str) -> None:
    """The files on base edits within reads, from ``base_edit_counts``: combinations with their counts, most frequent first (binary, category, precise: a cell
    a position), counts by position (arrays: a row a class), and reads of only reference or only target bases (counts)."""
    for form in ("binary", "category", "precise"):
        cells = F.array_join(F.split("combination", "," if form == "precise" else ""), "\t")
        lines = tables[form].select(cells.alias("cells"), F.initcap(F.col("has_indel").cast("string")).alias("has_indel"), F.col("n_reads").alias("count"))
        lines.orderBy(F.desc("count"), "cells", "has_indel").select(F.concat_ws("\t", "cells", "has_indel", "count").alias("value")).write.text(f"{stem}.{form}_allele_counts.txt")
    classes = ("total", "reference", "target", "deletion", "insertion", "other")
    rows = tables["positions"].agg(F.array_sort(F.collect_list(F.struct("pos", *classes))).alias("r"))  # a row a position
    per = rows.select(*[F.array_join(F.col(f"r.{c}").cast("array<string>"), "\t").alias(c) for c in classes])
    per.select(F.explode(F.array(*[F.concat_ws("\t", F.lit(f"{c}_counts"), c) for c in classes])).alias("value")).coalesce(1).write.text(f"{stem}.arrays.txt")
    tsv(tables["reads"], f"{stem}.counts.txt")


def run_info(facts: dict, path: str, spark) -> None:
    """A run's facts as one JSON document of plain types."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(path)
