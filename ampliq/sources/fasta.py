"""FASTA files as blocks of bases, for ranges to be fetched from without a chromosome ever being one value.

Lines are read where they lie. Each split of a file gives pieces of its contigs; how long they are, summed over the few pieces in the order of the file,
tells where each begins on its contig. Only pieces are moved, to the block that they belong to.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.regions import BLOCK
from .fastq import _lines, _runs

_PIECES = "file string, block long, segment long, name string, at long, bases string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, segment, name, at, bases): bases in the order of their lines. A segment is what a split has of one contig; its name is null if it
    began in an earlier split; at is the place in the segment. A name has a piece without bases."""

    def f(batches):
        segment = at = 0
        for file, block, first, values in _runs(batches):
            if first:
                segment = at = 0
            heads = [k for k, x in enumerate(pc.starts_with(values, ">").to_pylist()) if x]
            rows = []
            for start, end in zip([-1, *heads], [*heads, len(values)], strict=True):
                if start >= 0:
                    segment, at = segment + 1, 0
                    rows.append((file, block, segment, (values[start].as_py()[1:].split() or [""])[0], 0, ""))
                bases = "".join(values.slice(start + 1, end - start - 1).to_pylist()).replace(" ", "").replace("\r", "").upper()
                if bases:
                    rows.append((file, block, segment, None, at, bases))
                    at += len(bases)
            if rows:
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "block", "segment", "name", "at", "bases"])

    return _lines(spark, path).mapInArrow(f, _PIECES)


def _segments(pieces: DataFrame) -> DataFrame:
    """(file, block, segment, chr, start, n): where each segment begins on its contig. A row per contig and split."""
    parts = pieces.groupBy("file", "block", "segment").agg(F.max("name").alias("name"), F.sum(F.length("bases")).alias("n"))
    order = W.partitionBy("file").orderBy("block", "segment")
    named = parts.withColumn("number", F.count("name").over(order)).withColumn("chr", F.last("name", ignorenulls=True).over(order)).where("number > 0")
    return named.withColumn("start", F.sum("n").over(W.partitionBy("file", "number").orderBy("block", "segment")) - F.col("n")).drop("name", "number")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(chr, length) of the contigs."""
    return _segments(_pieces(spark, path)).groupBy("chr").agg(F.sum("n").alias("length"))


def read(spark: SparkSession, path: str, width: int = BLOCK) -> DataFrame:
    """(chr, block, bases): block k has the bases from k * width on, in capitals."""
    pieces = _pieces(spark, path)
    placed = pieces.where("bases <> ''").drop("name").join(_segments(pieces), ["file", "block", "segment"]).select("chr", (F.col("start") + F.col("at")).alias("pos"), "bases")
    last = F.col("pos") + F.length("bases") - 1
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(last / width))))
    first = F.greatest(F.col("pos"), F.col("block") * width)
    part = F.substring(F.col("bases"), (first - F.col("pos") + 1).cast("int"), (F.least(last + 1, (F.col("block") + 1) * width) - first).cast("int"))
    held = cut.groupBy("chr", "block").agg(F.sort_array(F.collect_list(F.struct(first.alias("pos"), part.alias("bases")))).alias("parts"))  # a block's bases at most
    return held.select("chr", "block", F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("bases"))


def write(contigs: DataFrame, path: str, width: int = 60) -> None:
    """(chr, seq) as FASTA with lines of ``width`` bases, contigs in the order of their names."""
    lines = F.array_join(F.regexp_extract_all("seq", F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")
    contigs.repartitionByRange("chr").sortWithinPartitions("chr").select(F.concat(F.lit(">"), "chr", F.lit("\n"), lines).alias("value")).write.text(path)
