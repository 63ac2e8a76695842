"""Alleles as amino acids: translated from an exon's start, aligned again, silent edits in lower case."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import AMINO
from .align import align

LETTERS = "ARNDCQEGHILKMFPSTWYVX*"


def identity_matrix(match: int = 5, mismatch: int = -4) -> np.ndarray:
    """Scores by character code. A matrix in the common text format can be given instead (``align.parse_matrix``)."""
    m = np.full((128, 128), 0, np.int32)
    for a in LETTERS:
        for b in LETTERS:
            m[ord(a), ord(b)] = match if a == b else mismatch
    return m


def codons_of(seq: str) -> list[str]:
    return [seq[k : k + 3] for k in range(0, len(seq) - 2, 3)]


def gapped(codons: list[str], aligned: str) -> list[str]:
    """Codons laid out like the aligned amino acids, with three dashes in its gaps."""
    it = iter(codons)
    return ["---" if c == "-" else next(it) for c in aligned]


def silent_marked(ref: str, ref_codons: list[str], read: str, read_codons: list[str]) -> str:
    """The aligned read's amino acids, in lower case where another codon gives the reference's amino acid."""
    cells = zip(ref, gapped(ref_codons, ref), read, gapped(read_codons, read), strict=True)
    return "".join(s.lower() if r == s and r != "-" and a != b else s for r, a, s, b in cells)


def amino_alleles(alleles: DataFrame, keys: list[str], exon_start: int, length: int, cut: int, matrix: np.ndarray | None = None, weight: str = "n_reads") -> DataFrame:
    """(keys, aln_seq, aln_ref, unedited, n_deleted, n_inserted, n_mutated, silent, n_reads): alleles of ``length`` amino acids from the exon on.

    ``cut`` is the amino acid at which a gap is favoured; ``silent`` are the places of silent edits."""
    scores = identity_matrix() if matrix is None else matrix
    kept = [*keys, "read_status", "n_deleted", "n_inserted", "n_mutated", weight]
    types = dict(alleles.dtypes)

    def f(frames):
        for pdf in frames:
            made, by_ref = [], defaultdict(set)
            for aln_seq, aln_ref in zip(pdf["aln_seq"], pdf["aln_ref"], strict=True):
                at = [k for k, c in enumerate(aln_ref) if c != "-"]
                left = at[exon_start] if exon_start < len(at) else len(aln_ref)
                read, ref = (codons_of(s[left:].replace("-", "")) for s in (aln_seq, aln_ref))
                a, b = ("".join(AMINO.get(c, "X") for c in x) for x in (read, ref))
                made.append((read, ref, a, b))
                by_ref[b].add(a)
            aligned = {}
            for b, reads in by_ref.items():  # all proteins of a reference at once
                favour = np.zeros(len(b) + 1, int)
                if 0 <= cut < len(favour):
                    favour[cut] = 1
                ordered = sorted(reads)
                aligned |= {(a, b): found[:2] for a, found in zip(ordered, align(ordered, b, scores, favour, -1, -1), strict=True)}
            rows = []
            for own, (read, ref, a, b) in zip(pdf[kept].itertuples(index=False, name=None), made, strict=True):
                x, y = aligned[a, b]
                x = silent_marked(y, ref, x, read)
                rows.append((*own, x[:length].upper(), y[:length], [k for k, c in enumerate(x[:length]) if c.islower()]))
            yield pd.DataFrame(rows, columns=[*kept, "aln_seq", "aln_ref", "silent"])

    out = alleles.select(*kept, "aln_seq", "aln_ref").mapInPandas(f, ", ".join(f"`{k}` {types[k]}" for k in kept) + ", aln_seq string, aln_ref string, silent array<int>")
    out = out.withColumn("unedited", F.col("read_status") == "UNMODIFIED")
    return out.groupBy(*keys, "aln_seq", "aln_ref", "unedited", "n_deleted", "n_inserted", "n_mutated", "silent").agg(F.sum(weight).alias(weight))
