"""Finished runs below a folder: found by their facts, unrolled to single runs, and their tables read as one.

A run is a folder that holds ``run_info`` (JSON, see ``sinks.run_info``) with its name, its mode and its status; its tables lie beside it, a Parquet folder each. A run of several
(batch, pooled, whole genome) names its parts, which are runs in folders below its own, however deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import run_info

FACTS = "name string, mode string, status string, parts array<string>"
#: Modes of runs that consist of others, and what a run's status says when it is over.
OF_OTHERS = ("batch", "pooled", "wgs")
COMPLETE = "complete"


def write(spark: SparkSession, path: str, name: str, tables: dict[str, DataFrame], mode: str = "single", status: str = COMPLETE, parts: list[str] | None = None) -> None:
    """A run with its tables. Its facts come last, so that a run that broke off has none."""
    for table, df in tables.items():
        df.write.parquet(f"{path}/{table}")
    run_info({"name": name, "mode": mode, "status": status, "parts": parts or []}, f"{path}/run_info", spark)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, mode, status, parts): a row per run below a folder. Files are listed, and only those with facts are read."""
    facts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    facts = facts.where(F.col("file").rlike("/run_info/[^/]+$"))
    return facts.select(F.regexp_replace("file", "/run_info/[^/]+$", "").alias("path"), F.from_json("value", FACTS).alias("x")).select("path", "x.*")


def unrolled(runs: DataFrame) -> DataFrame:
    """(path, name, status, part_of): single runs, with the names of the runs that they are parts of, outermost first. A part that its run names but that has no
    facts is there with the status ``missing``. A row a run throughout."""
    above = runs.where(F.col("mode").isin(*OF_OTHERS)).select(F.col("path").alias("above"), F.col("name").alias("outer"))
    single = runs.where(~F.col("mode").isin(*OF_OTHERS)).select("path", "name", "status")
    named = runs.where(F.col("mode").isin(*OF_OTHERS)).select("path", F.explode("parts").alias("name")).select(F.concat_ws("/", "path", "name").alias("path"), "name")
    missing = named.join(runs.select("path"), "path", "left_anti").select("path", "name", F.lit("missing").alias("status"))
    every = single.unionByName(missing)
    # a path's own beginnings, each as long as a folder, meet the runs of others
    cells = F.split("path", "/")
    begun = F.transform(F.sequence(F.lit(1), F.size(cells) - 1), lambda n: F.array_join(F.slice(cells, F.lit(1), n), "/"))
    met = every.withColumn("above", F.explode(begun)).join(above, "above").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.length("above").alias("n"), "outer"))), lambda x: x["outer"]).alias("part_of"))
    return every.join(met, "path", "left").select("path", "name", "status", F.coalesce("part_of", F.array().cast("array<string>")).alias("part_of"))


def table(spark: SparkSession, runs: DataFrame, name: str) -> DataFrame:
    """One table of all complete single runs (from ``unrolled``), with the columns run and part_of. Runs may differ in their columns; what a run lacks is null."""
    found = {r["path"]: r for r in runs.where(F.col("status") == COMPLETE).collect()}  # a row a run
    if not found:
        raise ValueError("no complete run")
    rows = spark.read.option("mergeSchema", True).parquet(*[f"{p}/{name}" for p in found])
    known = spark.createDataFrame([(p, r["name"], r["part_of"]) for p, r in found.items()], "_path string, run string, part_of array<string>")
    at = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), f"/{name}/[^/]*$", ""), "^file:/+", "/")
    return rows.withColumn("_at", at).join(known.withColumn("_path", F.regexp_replace("_path", "^file:/+", "/")), F.col("_at") == F.col("_path")).drop("_at", "_path")
