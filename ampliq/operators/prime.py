"""Prime editing and repair templates: scaffold incorporation, and edits seen from the first reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edits import with_edits
from .positions import ref_positions

SCAFFOLD = "Scaffold-incorporated"


def scaffold_search(reference: str, prime_edited: str, extension: str, scaffold: str, shortest: int = 1) -> tuple[int, str]:
    """(position behind the extension on the edited reference, the least piece of scaffold that the reference doesn't go on with)."""
    at = prime_edited.find(extension)
    if at < 0:
        raise ValueError("the extension is not in the edited reference")
    after = at + len(extension)
    n = shortest
    while n < len(scaffold) and prime_edited[after : after + n] == scaffold[:n]:
        n += 1
    return after, scaffold[:n]


def with_scaffold(variants: DataFrame, edited: str, after: int, piece: str) -> DataFrame:
    """Reads of the edited reference in which the piece of scaffold follows the extension, as reads of a reference of their own."""
    column = F.array_position(ref_positions(F.col("aln_ref")), F.lit(after - 1).cast("int")).cast("int")
    found = (F.col("ref_name") == edited) & (F.substring(F.col("aln_seq"), column + 1, F.lit(len(piece))) == piece)
    return variants.withColumn("ref_name", F.when(found, SCAFFOLD).otherwise(F.col("ref_name")))


def scaffold_sizes(variants: DataFrame, after: int, scaffold: str, keys: list[str], weight: str = "n_reads") -> DataFrame:
    """(keys, matched, gap, n_reads): how many of the bases behind the extension are the scaffold's, from its start on, and how many of them, from
    there on, are inserted (have a gap in the reference)."""
    column = F.array_position(ref_positions(F.col("aln_ref")), F.lit(after - 1).cast("int")).cast("int")
    behind = lambda c: F.substring(F.col(c), column + 1, F.length(c))
    bases = F.translate(behind("aln_seq"), "-", "")
    matched = F.array_max(F.array(F.lit(0), *[F.when(bases.startswith(scaffold[:k]), k) for k in range(1, len(scaffold) + 1)]))
    gap = F.least(F.length(F.regexp_extract(behind("aln_ref"), "^-*", 0)), F.lit(len(scaffold)), F.length(bases))
    rows = variants.withColumn("matched", matched).withColumn("gap", gap)
    return rows.groupBy(*keys, "matched", "gap").agg(F.sum(weight).alias(weight))


def from_first(aligned: DataFrame, assigned: DataFrame, first: str, window: list[int], key: str = "seq") -> DataFrame:
    """Reads' alignments to the first reference with its edits, under the reference they were assigned to.

    aligned: all alignments (key, ref_name, aln_seq, aln_ref); assigned: (key, ref_name, n_reads, ...)."""
    base = aligned.where(F.col("ref_name") == first).select(key, "aln_seq", "aln_ref")
    owned = assigned.select(key, F.col("ref_name").alias("assigned_ref"), *[c for c in ("sample", "n_reads") if c in assigned.columns])
    return with_edits(base.join(owned, key).withColumn("ref_name", F.lit(first)), {first: window})


