"""Read filters by base quality (phred + 33), as Spark columns and DataFrame operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import any_of, letters

BASE = 33


def scores(qual: Column) -> Column:
    return F.transform(letters(qual), lambda c: F.ascii(c) - BASE)


def lowest(qual: Column) -> Column:
    return F.array_min(scores(qual))


def any_below(qual: Column, least: int) -> Column:
    """Whether any base has a quality below ``least``: one match of a class of characters, without an array."""
    return qual.rlike(f"[\\x00-\\x{max(0, min(126, BASE + least - 1)):02x}]")


def none_below(qual: Column, least: int) -> Column:
    """Whether there are bases and all have a quality of at least ``least``. Each test refers to the qualities once, as filters make them anew for each reference."""
    return qual.rlike(f"^[^\\x00-\\x{max(0, min(126, BASE + least - 1)):02x}]+\\z")


def mean(qual: Column) -> Column:
    """The mean quality; null of an empty string."""
    n = F.length(qual)
    total = F.aggregate(F.split(qual, ""), F.lit(0), lambda s, c: s + F.ascii(c))
    return F.when(n > 0, total / n - BASE)


def mean_at_least(qual: Column, least: float) -> Column:
    """Whether the bases' qualities reach ``least`` on average: what they have above it, less what they lack. An empty string has no mean and fails."""
    return F.aggregate(F.split(qual, ""), F.lit(0.0), lambda s, c: s + (F.ascii(c) - F.lit(float(BASE + least)))) >= 0


def masked(seq: Column, qual: Column, least: int) -> Column:
    """Bases of a quality below ``least`` become N. A read without such a base is left as it is."""
    marks = F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda b, q: F.when(F.ascii(q) < BASE + least, "N").otherwise(b))
    return F.when((F.length(qual) > 0) & any_below(qual, least), F.array_join(marks, "")).otherwise(seq)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings end to end, and where each begins (one more at the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def checked(seq: pa.Array, qual: pa.Array, min_single: int, min_mean: float, mask_below: int) -> pa.Array:
    """(keep, seq) of a batch of reads: sums and smallest values of all qualities laid end to end, and their low ones as marks over the bases."""
    seq, qual = seq.cast(pa.string()), qual.cast(pa.string())
    known = ~qual.is_null().to_numpy(zero_copy_only=False)
    q, at = _bytes(qual.fill_null(""))
    n = np.diff(at)
    some = np.flatnonzero(n)
    keep = np.ones(len(qual), bool)
    if min_single or min_mean:
        keep = known & (n > 0)
        if len(some) and min_single:
            keep[some] &= np.minimum.reduceat(q, at[some]) >= BASE + min_single
        if len(some) and min_mean:
            keep[some] &= np.add.reduceat(q.astype(np.int64), at[some]) - n[some] * float(BASE + min_mean) >= 0
    if mask_below:
        bases, place = _bytes(seq.fill_null(""))
        low = q < BASE + mask_below
        if np.array_equal(place, at):
            changed = pa.StringArray.from_buffers(len(seq), pa.py_buffer(place.astype(np.int32)), pa.py_buffer(np.where(low, np.uint8(ord("N")), bases)))
        else:  # some reads have fewer or more qualities than bases
            cut = [bases[a:b].copy() for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            for x, a, b in zip(cut, at[:-1].tolist(), at[1:].tolist(), strict=True):
                m = min(len(x), b - a)
                x[:m][low[a : a + m]] = ord("N")
            changed = pa.array([x.tobytes().decode() for x in cut], pa.string())
        seq = pc.if_else(seq.is_null(), None, changed)
    return pa.StructArray.from_arrays([pa.array(keep), seq], ["keep", "seq"])


def filtered(reads: DataFrame, min_single: int = 0, min_mean: float = 0, mask_below: int = 0, mates: tuple[tuple[str, str], ...] = (("seq", "qual"),)) -> DataFrame:
    """Reads of which every mate passes; what is masked is masked after the test. A threshold of 0 tests nothing. A read without qualities passes no test.

    Only bases and qualities go through Arrow, once for all tests; the smallest quality alone is a match of a class of characters."""
    if not min_mean and not mask_below:
        for _, q in mates:
            reads = reads.where(none_below(F.col(q), min_single)) if min_single else reads
        return reads

    @F.arrow_udf("keep boolean, seq string")
    def check(seq: pa.Array, qual: pa.Array) -> pa.Array:
        return checked(seq, qual, min_single, min_mean, mask_below)

    columns = reads.columns
    check = check.asNondeterministic()  # else the test is moved below, and made again behind, all that derives the reads
    reads = reads.withColumns({f"_checked{k}": check(F.col(s), F.col(q)) for k, (s, q) in enumerate(mates)})
    for k in range(len(mates) if min_single or min_mean else 0):
        reads = reads.where(F.col(f"_checked{k}.keep"))
    changed = {s: F.col(f"_checked{k}.seq") for k, (s, _) in enumerate(mates)} if mask_below else {}
    return reads.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in columns])


def by_presence(reads: DataFrame, include: list[str], exclude: list[str], seqs: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Reads with any of ``include`` (if there are any) and none of ``exclude``; of pairs, either mate counts."""
    has = lambda parts: any_of(F.col(seqs[0]), parts) if len(seqs) == 1 else any_of(F.concat_ws(" ", *seqs), parts)
    return reads.where((has(include) if include else F.lit(True)) & ~has(exclude))


def presence_counts(reads: DataFrame, parts: list[str], seq: str = "seq") -> DataFrame:
    """(part, n): reads that hold each part."""
    sums = reads.agg(*[F.sum(F.col(seq).contains(p).cast("long")).alias(f"p{k}") for k, p in enumerate(parts)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(F.col(f"p{k}"), F.lit(0)).alias("n")) for k, p in enumerate(parts)])).alias("x")).select("x.part", "x.n")
