"""References built on the driver: guides, cut points, windows, seeds, exons. Tens of rows, broadcast afterwards."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from .align import GAP_EXTEND, GAP_INCENTIVE, GAP_OPEN, MIN_SCORE, align, rc, scoring_matrix

WINDOW_CENTER, WINDOW_SIZE, PLOT_WINDOW = -3, 1, 20


@dataclass
class Guide:
    name: str
    seq: str
    start: int
    end: int
    cut: int
    window: list[int]
    plot: list[int] = field(default_factory=list)
    mismatches: list[float] = field(default_factory=list)


@dataclass
class Reference:
    name: str
    seq: str
    guides: list[Guide]
    window: list[int]
    min_score: float = MIN_SCORE
    exons: list[int] = field(default_factory=list)
    splicing: list[int] = field(default_factory=list)
    exon_change: int = 0
    fw_seeds: list[str] = field(default_factory=list)
    rc_seeds: list[str] = field(default_factory=list)
    incentive: np.ndarray | None = None

    def as_row(self) -> dict:
        """What the alignment needs."""
        return {"name": self.name, "seq": self.seq, "incentive": self.incentive, "min_score": self.min_score, "fw_seeds": self.fw_seeds, "rc_seeds": self.rc_seeds}


def option_list(text: str, n: int, kind: type = int) -> list:
    """One value per guide from a comma list; what is missing takes the first value."""
    given = [kind(x) for x in str(text).split(",") if x.strip()]
    if len(given) > n > 0:
        raise ValueError(f"{len(given)} values for {n} guides")
    return (given + [given[0]] * n)[:n] if given else []


def places(ref: str, part: str) -> list[int]:
    """Starts of all occurrences, overlapping ones too, whatever their case."""
    return [m.start() for m in re.finditer(f"(?={re.escape(part)})", ref, re.IGNORECASE)]


def parse_windows(text: str | None, length: int) -> list[int] | None:
    """Positions of ``a-b_c-d``, both ends included; None or "0" gives none."""
    if not text or text == "0":
        return None
    out: list[int] = []
    for span in text.split("_"):
        m = re.fullmatch(r"(\d+)-(\d+)", span)
        if not m:
            raise ValueError(f"{span!r} is no range like 5-10")
        first, last = int(m[1]), int(m[2])
        if last >= length:
            raise ValueError(f"{span!r} ends behind the reference of {length} bases")
        out += range(first, last + 1)
    return out


def place_guides(ref: str, guides: list[str], names: list[str] | None = None, centers: list[int] | None = None, sizes: list[int] | None = None, plot: int = PLOT_WINDOW, drop_at_edge: bool = False) -> list[Guide]:
    """Every match of every guide on either strand, with its cut and its window. The cut is the base left of it."""
    n = len(guides)
    names, centers, sizes = names or [""] * n, centers or [WINDOW_CENTER] * n, sizes or [WINDOW_SIZE] * n
    out: list[Guide] = []
    for guide, name, center, size in zip(guides, names, centers, sizes, strict=True):
        if not guide:
            continue
        ahead, back = places(ref, guide), places(ref, rc(guide))
        for at, cut in [(s, s + len(guide) - 1 + center) for s in ahead] + [(s, s - center - 1) for s in back]:
            around = max(1, plot)
            if drop_at_edge and (cut - around + 1 < 0 or cut + around > len(ref) - 1):
                continue
            own = name if len(ahead) + len(back) == 1 else f"{name or guide.upper()}_{at}"
            taken, k = {g.name for g in out if g.name}, 1
            unique = own
            while unique and unique in taken and len(ahead) + len(back) > 1:
                k += 1
                unique = f"{own}_{k}"
            window = list(range(max(0, cut - size + 1), min(len(ref), cut + size + 1))) if size > 0 else []
            out.append(Guide(unique, guide.upper(), at, at + len(guide) - 1, cut, window))
    around = max(1, plot)
    for g in out:  # a window that leaves the reference makes the following ones as narrow
        around = min(around, g.cut + 1, len(ref) - g.cut - 1) if plot > 0 else around
        g.plot = list(range(max(0, g.cut - around + 1), min(len(ref), g.cut + around + 1)))
    return out


def quantification_window(ref: str, guides: list[Guide], coordinates: str | None = None, skip_left: int = 0, skip_right: int = 0) -> list[int]:
    """Given coordinates, else the guides' windows, else the whole reference; less the bases set aside at the ends."""
    length = len(ref)
    given = parse_windows(coordinates, length)
    if given is None:
        given = sorted({p for g in guides for p in g.window})
    whole = not given
    aside = set(range(skip_left)) | set(range(length - skip_right, length) if skip_right else ())
    left = sorted(set(range(length) if whole else given) - aside)
    if not whole and set(given) - set(left):
        raise ValueError("bases set aside at the ends lie in the quantification window")
    if not left:
        raise ValueError("all bases are set aside")
    return left


def seeds(ref: str, count: int = 5, length: int = 10, skip_left: int = 15, skip_right: int = 15) -> tuple[list[str], list[str]]:
    """Parts of the reference that its reverse complement doesn't have, and their reverse complements; starts are ``count`` apart."""
    turned = rc(ref)
    found = [ref[k : k + length] for k in range(skip_left, len(ref) - skip_right - length, max(1, count)) if ref[k : k + length] not in turned]
    return found, [rc(s) for s in found]


def exon_positions(ref: str, coding: list[str]) -> tuple[list[int], list[int]]:
    """Positions inside the coding parts, and the two bases on either side of each that splicing needs."""
    inside: set[int] = set()
    beside: set[int] = set()
    for part in coding:
        at = ref.upper().find(part.upper())
        if at < 0:
            raise ValueError("a coding sequence is not in the reference")
        inside |= set(range(at, at + len(part)))
        beside |= {at - 2, at - 1, at + len(part), at + len(part) + 1}
    return sorted(inside), sorted(p for p in beside - inside if 0 <= p < len(ref))


def spans(positions: list[int]) -> list[tuple[int, int]]:
    """(first, last) of the runs of consecutive numbers."""
    out: list[tuple[int, int]] = []
    for p in sorted(set(positions)):
        if out and p == out[-1][1] + 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def build(name: str, seq: str, guides: list[str], coding: list[str] | None = None, coordinates: str | None = None, min_score: float = MIN_SCORE, incentive: int = GAP_INCENTIVE, skip_left: int = 15, skip_right: int = 15, **options) -> Reference:
    """A reference with everything the plan needs of it."""
    seq = seq.upper()
    bad = set(seq) - set("ACGTN")
    if bad:
        raise ValueError(f"{name}: {''.join(sorted(bad))} are no bases")
    placed = place_guides(seq, guides, **options)
    exons, splicing = exon_positions(seq, coding or [])
    favour = np.zeros(len(seq) + 1, np.int64)
    for g in placed:
        if 0 <= g.cut + 1 <= len(seq):
            favour[g.cut + 1] = incentive
    fw, rv = seeds(seq, skip_left=skip_left, skip_right=skip_right)
    return Reference(name, seq, placed, quantification_window(seq, placed, coordinates, skip_left, skip_right), min_score, exons, splicing, 0, fw, rv, favour)


def position_maps(aligned: str, other: str) -> tuple[list[int], list[int]]:
    """For each base of the first aligned sequence its place in the second: filled from the left, and from the right, where the second has a gap."""
    left, right, seen = [], [], 0
    for a, b in zip(aligned, other, strict=True):
        if a != "-":
            left.append(seen if b != "-" else seen - 1)
            right.append(seen)
        seen += b != "-"
    return left, right


def cloned(positions: list[int], source: Reference, target: Reference) -> list[int]:
    """Positions of one reference on another, through their alignment; those in gaps are left out."""
    a, b, score = align([source.seq], target.seq, scoring_matrix(), np.zeros(len(target.seq) + 1, int), GAP_OPEN, GAP_EXTEND)[0]
    at, out, i, j = set(positions), [], 0, 0
    for x, y in zip(a, b, strict=True):
        if x != "-" and y != "-" and i in at:
            out.append(j)
        i, j = i + (x != "-"), j + (y != "-")
    return out


def cloned_guides(source: Reference, target: Reference, least: float = 60.0) -> list[Guide]:
    """The guides of a reference on one that lacks them, if the two align with at least ``least``."""
    _, _, score = align([source.seq], target.seq, scoring_matrix(), np.zeros(len(target.seq) + 1, int))[0]
    if score < least:
        return []
    out = []
    for g in source.guides:
        span, cut, window = (cloned(p, source, target) for p in (list(range(g.start, g.end + 1)), [g.cut], g.window))
        if span and cut:
            out.append(Guide(g.name, g.seq, span[0], span[-1], cut[0], window, cloned(g.plot, source, target)))
    return out


def with_annotations_of(source: Reference, target: Reference, least: float = 60.0, incentive: int = GAP_INCENTIVE) -> Reference:
    """``target`` with the guides, windows and exons of ``source`` where it has none of its own, if the two align with at least ``least``.

    Exons go through the alignment span by span; what they gain or lose in length is added to ``exon_change``, which frameshifts take into account."""
    aligned, other, score = align([source.seq], target.seq, scoring_matrix(), np.zeros(len(target.seq) + 1, int))[0]
    if score < least:
        return target
    out = replace(target, incentive=np.zeros(len(target.seq) + 1, np.int64) if target.incentive is None else target.incentive.copy())
    if not out.guides and source.guides:
        out.guides = cloned_guides(source, target, least)
        for g in out.guides:
            out.incentive[g.cut + 1] = incentive
        out.window = sorted(set(cloned(source.window, source, target))) or out.window
    if not out.exons and source.exons:
        left, right = position_maps(aligned, other)
        exons: list[int] = []
        for first, last in spans(source.exons):
            there = range(max(left[first], 0), min(right[last], len(target.seq) - 1) + 1)
            exons += there
            out.exon_change += len(there) - (last - first + 1)
        out.exons, out.splicing = sorted(set(exons)), cloned(source.splicing, source, target)
    return out


def _part_like(part: str, seq: str, gap_open: int, gap_extend: int) -> str:
    """The piece of ``seq`` that ``part`` aligns to."""
    a, b, _ = align([part], seq, scoring_matrix(), np.zeros(len(seq) + 1, int), gap_open, gap_extend)[0]
    return b[len(a) - len(a.lstrip("-")) : len(a.rstrip("-"))].replace("-", "")


def prime_editing_guides(seq: str, first: str, edited: str, extension: str, spacer: str, nicking: str = "", extension_window: int = 5, center: int = WINDOW_CENTER, size: int = WINDOW_SIZE, gap_open: int = -50, gap_extend: int = 0) -> list[tuple[str, str, int, int]]:
    """(name, guide, center, size) of the parts of a prime editing experiment on the reference ``seq``.

    The extension's DNA is at home on the edited reference, the spacer on the first one, and the nicking guide on the first one's reverse
    complement. On another reference a part is what its home's alignment lays in its place, and a center moves with the bases gained or lost there."""
    dna = lambda s: s.upper().replace("U", "T")
    if dna(spacer) not in first and rc(dna(spacer)) not in first:
        raise ValueError("the spacer is not in the first reference")
    parts = [("PE Extension", rc(dna(extension)), edited, seq, 0, extension_window), ("PE spacer sgRNA", dna(spacer), first, seq, center, size)]
    if nicking:
        parts.append(("PE nicking sgRNA", dna(nicking), rc(first), rc(seq), center, size))
    out = []
    for name, part, home, here, at, width in parts:
        piece = _part_like(part, home, gap_open, gap_extend)
        if here != home:
            a, b, _ = align([home], here, scoring_matrix(), np.zeros(len(here) + 1, int))[0]
            (left, right), (_, back) = position_maps(a, b), position_maps(b, a)
            start = home.find(piece)
            stop = start + len(piece)
            piece = here[left[start] : right[stop] if stop < len(right) else None]
            end = min(stop, len(right) - 1)
            at = back[min(end + at, len(back) - 1)] - right[end] if at else 0
        out.append((name, piece, at, width))
    return out


def flexible_guide(ref: str, guide: str, least: float = 80.0, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> tuple[str, list[float]] | None:
    """The part of the reference most like the guide on either strand, and where they differ (a gap lies half a base before); None below ``least`` percent."""
    best = None
    for seq in (ref.upper(), rc(ref)):
        a, b, _ = align([guide.upper()], seq, scoring_matrix(), np.zeros(len(seq) + 1, int), gap_open, gap_extend)[0]
        first, last = len(a) - len(a.lstrip("-")), len(a.rstrip("-"))
        inner_a, inner_b = a[first:last], b[first:last]
        same = 100 * sum(x == y for x, y in zip(inner_a, inner_b, strict=True)) / max(1, len(inner_a))
        if same >= least and (best is None or same > best[0]):
            wrong, at = [], 0
            for x, y in zip(inner_a, inner_b, strict=True):
                if x == "-":
                    wrong.append(at - 0.5)
                elif x != y:
                    wrong.append(float(at))
                at += y != "-"
            best = (same, inner_b.replace("-", ""), wrong)
    return best[1:] if best else None


def prime_edited(ref: str, spacer: str, extension: str, least: float = 60.0) -> str:
    """The reference after prime editing: the extension's reverse complement laid over the reference where the two align."""
    ref, edit = ref.upper(), rc(extension.replace("U", "T"))
    site = places(ref, spacer)
    if not site:
        flipped = places(rc(ref), spacer)
        if not flipped:
            raise ValueError("the spacer is not in the reference")
        return rc(prime_edited(rc(ref), spacer, extension, least))
    a, b, _ = align([edit], ref, scoring_matrix(), np.zeros(len(ref) + 1, int))[0]
    first, last = len(a) - len(a.lstrip("-")), len(a.rstrip("-"))
    start, stop = len(b[:first].replace("-", "")), len(b[:last].replace("-", ""))
    same = 100 * sum(x == y for x, y in zip(a[first:last], b[first:last], strict=True)) / max(1, last - first)
    if same < least:
        raise ValueError("the extension doesn't fit the reference")
    return ref[:start] + edit + ref[stop:]


def missing_parts(references: DataFrame, parts: list[str], seq: str = "ref_seq") -> DataFrame:
    """(part): the guides or exons that no reference holds on either strand."""
    spark = references.sparkSession
    asked = spark.createDataFrame([(p,) for p in parts], "part string")
    both = references.select(F.col(seq).alias("s")).union(references.select(reverse_complement(F.col(seq)).alias("s")))
    return asked.join(both, F.col("s").contains(F.col("part")), "left_anti")
