"""Where guides fit with mismatches: every place within some mismatches by exact pieces, and how a guide's alignment differs from its site.

A guide cut into ``most + 1`` pieces keeps at least one of them at each place that differs in ``most`` bases or fewer. So the pieces meet
the reference's words of their length, and each meeting is verified base by base. A place that several pieces find is kept for the first of
them that is exact there, so nothing has to be made distinct.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from .align import GAP_EXTEND, GAP_OPEN, align, scoring_matrix
from .references import parse_windows, position_maps

#: So many pieces at most are broadcast; more are joined by a shuffle in which each word is dealt over SALTS tasks.
BROADCAST_PIECES, SALTS = 200_000, 16


def _cut(guide: Column, parts: int) -> Column:
    """(piece, from, text) of a guide's pieces, as equal in length as can be."""
    n = F.length(guide)
    edge = lambda k: F.floor(k * n / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(k.alias("piece"), edge(k).alias("from"), F.substring(guide, edge(k) + 1, edge(k + 1) - edge(k)).alias("text")))


def sites(references: DataFrame, guides: DataFrame, most: int = 4) -> DataFrame:
    """(guide_name, guide, ref_name, strand, start, site, n_mismatches, mismatches): all places of guides on either strand that differ in at most ``most`` bases.

    references: (ref_name, ref_seq); guides: (guide_name, guide) of more than ``most`` bases (shorter and null ones are left out). ``start`` counts
    on the reference as given, ``site`` and ``mismatches`` (from 0) go in the guide's direction. Case doesn't matter; an N is a base of its own."""
    asked = guides.select("guide_name", F.upper("guide").alias("guide")).where(F.length("guide") > most)
    both = asked.select("guide_name", "guide", F.lit("+").alias("strand"), F.col("guide").alias("laid")).union(asked.select("guide_name", "guide", F.lit("-"), reverse_complement(F.col("guide"))))
    pieces = both.select("*", F.inline(_cut(F.col("laid"), most + 1)))
    sizes = [r[0] for r in pieces.select(F.length("text")).distinct().collect()]  # one or two for each length of a guide
    sizes = sizes or [1]
    refs = references.select("ref_name", F.upper("ref_seq").alias("seq")).where(F.length("seq") > 0)
    starts = F.sequence(F.lit(1), F.length("seq"))
    words = refs.select("ref_name", "seq", F.explode(starts).alias("at"))
    words = words.select("ref_name", "seq", "at", F.explode(F.array(*[F.when(F.col("at") + k <= F.length("seq") + 1, F.substring(F.col("seq"), F.col("at"), F.lit(k))) for k in sorted(sizes)])).alias("text")).where("text IS NOT NULL")
    if pieces.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES:
        met = words.join(F.broadcast(pieces), "text")
    else:
        salted = pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = words.withColumn("salt", F.pmod(F.xxhash64("ref_name", "at"), F.lit(SALTS)).cast("int")).join(salted, ["text", "salt"])
    n = F.length("laid")
    met = met.withColumn("start", F.col("at") - 1 - F.col("from")).where((F.col("start") >= 0) & (F.col("start") + n <= F.length("seq")))
    met = met.withColumn("found", F.substring(F.col("seq"), F.col("start") + 1, n))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("found"), i + 1, F.lit(1)) != F.substring(F.col("laid"), i + 1, F.lit(1)))
    met = met.withColumn("wrong", differ).where(F.size("wrong") <= most)
    first_exact = F.array_min(F.transform(F.filter(_cut(F.col("laid"), most + 1), lambda p: F.substring(F.col("found"), p["from"] + 1, F.length(p["text"])) == p["text"]), lambda p: p["piece"]))
    met = met.where(F.col("piece") == first_exact)
    ahead = F.col("strand") == "+"
    wrong = F.when(ahead, F.col("wrong")).otherwise(F.reverse(F.transform("wrong", lambda i: n - 1 - i)))
    site = F.when(ahead, F.col("found")).otherwise(reverse_complement(F.col("found")))
    return met.select("guide_name", "guide", "ref_name", "strand", "start", site.alias("site"), F.size("wrong").alias("n_mismatches"), wrong.alias("mismatches"))


def aligned_maps(target: str, source: str, gap_open: int = GAP_OPEN, gap_extend: int = 0) -> tuple[list[int], list[int]]:
    """For each base of ``source`` its place in ``target`` by their alignment, gaps filled from the left and from the right."""
    a, b, _ = align([target], source, scoring_matrix(), np.zeros(len(source) + 1, int), gap_open, gap_extend)[0]
    return position_maps(b, a)


def mismatches(guide: str, site: str, gap_open: int = GAP_OPEN, gap_extend: int = 0) -> list[int]:
    """The guide's bases that its alignment to the site doesn't pair with an equal one; a base beside a gap is paired from both sides, so it counts too."""
    left, right = aligned_maps(site, guide, gap_open, gap_extend)
    n = len(site)
    return [i for i, (c, lo, hi) in enumerate(zip(guide, left, right, strict=True)) if not (lo >= 0 and hi < n and c == site[lo] == site[hi])]


def best_place(guide: str, seq: str, gap_open: int = GAP_OPEN) -> dict:
    """Where a guide lies best in a longer sequence, ahead only: the site, its first column and the one behind its last, the score, the mismatches, and both aligned."""
    a, b, score = align([guide], seq, scoring_matrix(), np.zeros(len(seq) + 1, int), gap_open, 0)[0]
    first, last = len(a) - len(a.lstrip("-")), len(a.rstrip("-"))
    site = b[first:last].replace("-", "")
    return {"site": site, "score": score, "mismatches": mismatches(guide, site, gap_open) if site else list(range(len(guide))), "start": first, "end": last, "aln_guide": a, "aln_seq": b}


def span_mismatches(seq: str, other: str, start: int, end: int, to_seq: tuple[list[int], list[int]], to_other: list[int]) -> list[float]:
    """Where ``seq`` differs from ``other`` between two places of ``other``, counted from the first; half a base before what ``seq`` lacks.

    ``to_seq`` are the places of other's bases in seq, from the left and from the right, ``to_other`` those of seq's bases in other, from the left."""
    left, right = to_seq
    first = left[start]
    places = to_other[first : right[end] if end < len(right) else len(seq)]
    out = {float(k) for k, p in enumerate(places) if p < 0 or seq[first + k] != other[p]}
    for k, step in enumerate(np.diff(places).tolist(), 1):
        if step != 1:  # a base that other lacks, or bases that seq lacks
            out.add(float(k) if step == 0 else k - 0.5)
    return sorted(out)


def cloned_windows(coordinates: str | None, there: list[int]) -> list[int]:
    """The positions of ``a-b_c-d`` on another sequence, of whose bases ``there`` holds the places on the first (never falling): of each range, from
    the first base that lies in it to the last one, with what has been inserted between them."""
    out: list[int] = []
    held = np.asarray(there)
    for span in (coordinates or "").split("_"):
        if span in ("", "0"):
            continue
        inside = parse_windows(span, 1 << 60)
        low, high = np.searchsorted(held, inside[0]), np.searchsorted(held, inside[-1], "right") - 1
        if low <= high:
            out += range(int(low), int(np.searchsorted(held, held[high])) + 1)
    return out


def with_cloned_windows(pairs: DataFrame, to: str = "window") -> DataFrame:
    """``pairs`` (source_seq, target_seq, coordinates, ...) with the coordinates' positions on the target, through the alignment of the two.

    Null sequences or coordinates give an empty window."""
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + f", `{to}` array<int>"

    def f(frames):
        for pdf in frames:
            found, made = [], {}
            for key in zip(pdf["source_seq"], pdf["target_seq"], pdf["coordinates"], strict=True):
                if key not in made:
                    source, target, coordinates = key
                    made[key] = cloned_windows(coordinates, aligned_maps(source, target, gap_extend=GAP_EXTEND)[0]) if source and target and coordinates else []
                found.append(made[key])
            yield pdf.assign(**{to: pd.Series(found, index=pdf.index, dtype=object)})

    return pairs.mapInPandas(f, schema)
