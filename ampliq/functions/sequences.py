"""Sequence functions as Spark columns: no Python runs on the executors."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, codons by amino acid ("*" is a stop).
CODONS = {
    "A": "GCT GCC GCA GCG", "R": "CGT CGC CGA CGG AGA AGG", "N": "AAT AAC", "D": "GAT GAC", "C": "TGT TGC", "Q": "CAA CAG", "E": "GAA GAG", "G": "GGT GGC GGA GGG",
    "H": "CAT CAC", "I": "ATT ATC ATA", "L": "TTA TTG CTT CTC CTA CTG", "K": "AAA AAG", "M": "ATG", "F": "TTT TTC", "P": "CCT CCC CCA CCG",
    "S": "TCT TCC TCA TCG AGT AGC", "T": "ACT ACC ACA ACG", "W": "TGG", "Y": "TAT TAC", "V": "GTT GTC GTA GTG", "*": "TAA TAG TGA",
}
AMINO = {codon: amino for amino, codons in CODONS.items() for codon in codons.split()} | {"---": "-"}


def letters(s: Column) -> Column:
    """The characters of a string as an array; none of an empty one."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def reverse_complement(s: Column) -> Column:
    """Upper case, reversed and complemented; other symbols (N, -, _) stay."""
    return F.reverse(F.translate(F.upper(s), "ACGT", "TGCA"))


def reverse(s: Column) -> Column:
    return F.reverse(F.upper(s))


def illegal_bases(s: Column) -> Column:
    """The distinct symbols other than A, C, G, T and N, in order."""
    return F.array_sort(F.array_except(F.array_distinct(letters(F.upper(s))), F.array(*map(F.lit, "ACGTN"))))


def capitalised(s: Column) -> Column:
    return F.upper(s)


def _folded() -> tuple[str, str, str]:
    """Letters of the basic plane that decompose to one ASCII character, and these; all that decompose to several, or lie beyond that plane, as pairs for ``str_to_map``."""
    one, single, several = [], [], []
    for k in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if ord(c) < 128)
        if len(plain) == 1 and k < 0x10000:
            one.append(chr(k))
            single.append(plain)
        elif plain:
            several.append(f"{chr(k)}\x02{plain}")
    return "".join(one), "".join(single), "\x01".join(several)


def slug(s: Column) -> Column:
    """A safe file name: accents, ligatures, fractions and the like fold to ASCII, other symbols beyond it go, and every run of unsafe ones is one underscore."""
    one, single, several = _folded()
    s = F.translate(s, one, single)
    table = F.str_to_map(F.lit(several), F.lit("\x01"), F.lit("\x02"))
    long = F.array_join(F.transform(letters(s), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    s = F.regexp_replace(F.when(s.rlike(r"[^\x00-\x7f]"), long).otherwise(s), r"[^\x00-\x7f]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(s), r"[^\w.\-]+", "_"), "_+", "_")


def codons(s: Column) -> Column:
    """Codons from the start; one or two bases at the end are dropped."""
    n = F.floor(F.length(s) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(s, 3 * k + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def translated(s: Column) -> Column:
    """Amino acids, one letter a codon; a codon with an unknown base is X."""
    table = F.create_map(*[F.lit(x) for pair in AMINO.items() for x in pair])
    return F.array_join(F.transform(codons(F.upper(s)), lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")


def homology(a: Column, b: Column) -> Column:
    """The share of columns at which two strings are equal."""
    same = F.aggregate(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return same / F.length(a)


def alignment_cigar(read: Column, ref: Column) -> Column:
    """The CIGAR string of an aligned pair: M, I (gap in the reference) and D (gap in the read), run-length coded.

    Letters are compared one by one only where both have gaps; else the runs of the one that has some tell all."""
    kinds = F.zip_with(letters(read), letters(ref), lambda q, r: F.when(q == "-", "D").when(r == "-", "I").otherwise("M"))
    runs = F.regexp_extract_all(F.array_join(kinds, ""), F.lit("M+|I+|D+"), F.lit(0))
    whole = F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")
    alone = lambda s, kind: F.array_join(F.transform(F.regexp_extract_all(s, F.lit("-+|[^-]+"), F.lit(0)), lambda r: F.concat(F.length(r).cast("string"), F.when(r.startswith("-"), kind).otherwise("M"))), "")
    # a pair whose lengths differ, or that lacks one, goes the long way
    usual, gaps = (F.length(read) == F.length(ref)) & (F.length(read) > 0), (read.contains("-"), ref.contains("-"))
    return F.when(usual & ~gaps[0] & ~gaps[1], F.concat(F.length(read).cast("string"), F.lit("M"))).when(usual & ~gaps[1], alone(read, "D")).when(usual & ~gaps[0], alone(ref, "I")).otherwise(whole)


def cigar_length(cigar: Column, kinds: str) -> Column:
    """The sum of a CIGAR's runs of the given kinds: MDN=X for the reference, MIS=X for the read."""
    runs = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def clip_extended(pos: Column, cigar: Column) -> tuple[Column, Column]:
    """Start and end (exclusive) of a mapped read with its soft clips laid beside it; hard clips and insertions take no room."""
    head = F.coalesce(F.nullif(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1), F.lit("")).cast("long"), F.lit(0))
    tail = F.coalesce(F.nullif(F.regexp_extract(cigar, r"[A-Z=](\d+)S(?:\d+H)?$", 1), F.lit("")).cast("long"), F.lit(0))
    return pos - head, pos + cigar_length(cigar, "MDN=X") + tail


def contains_inside(seq: Column, part: Column) -> Column:
    """Whether ``part`` or its reverse complement occurs in ``seq`` behind its first base."""
    return (F.instr(seq, part) > 1) | (F.instr(seq, reverse_complement(part)) > 1)


def contains_fragment(seq: Column, part: str) -> Column:
    """The same for the part without three bases at each end; null if it has six bases or fewer."""
    return contains_inside(seq, F.lit(part[3:-3])) if len(part) > 6 else F.lit(None).cast("boolean")


def values_at_reference(read: Column, ref: Column) -> Column:
    """What the read has at each reference position: the aligned base, and behind it the bases inserted there; those before the first base go to it."""
    columns = F.filter(F.transform(letters(ref), lambda c, k: F.when(c != "-", k)), lambda k: k.isNotNull())
    ends = F.concat(F.slice(columns, 2, F.greatest(F.size(columns) - 1, F.lit(0))), F.array(F.length(ref)))
    starts = F.transform(columns, lambda k, n: F.when(n == 0, 0).otherwise(k))
    return F.zip_with(starts, ends, lambda a, b: F.substring(read, a + 1, b - a))


def display_class(name: Column, modified: Column, first: str, hdr: str) -> Column:
    """Labels of read classes in experiments with a repair template."""
    return F.when((name == first) & ~modified, first).when(name == first, "NHEJ").when((name == hdr) & ~modified, hdr).when(name == hdr, f"Imperfect {hdr}").otherwise(name)


def edit_text(positions: Column, sizes: Column, bases: Column | None = None) -> Column:
    """Edits as pos(size), or pos(size+bases), joined by semicolons."""
    whole = F.transform(sizes, lambda n: n.cast("string")) if bases is None else F.zip_with(sizes, bases, lambda n, b: F.concat(n.cast("string"), F.lit("+"), b))
    return F.array_join(F.zip_with(positions, whole, lambda p, n: F.concat(p.cast("string"), F.lit("("), n, F.lit(")"))), ";")


def inserted_bases(read: Column, positions: Column, coordinates: Column, sizes: Column) -> Column:
    """The bases of each insertion, from the positions of the aligned reference's columns."""
    return F.zip_with(coordinates, sizes, lambda c, n: F.substring(read, F.array_position(positions, c["start"]).cast("int") + 1, n))


def annotation(edits: str = "edits", read: str = "aln_seq") -> dict[str, Column]:
    """The texts that annotate a read's edits in one reference: MODS, DEL, INS and SUB. A read of several references joins its texts by ``&``."""
    e = lambda n: F.col(f"{edits}.{n}")
    starts = lambda c: F.transform(c, lambda x: x["start"])
    return {
        "MODS": F.concat(F.lit("D"), e("deletion_n").cast("string"), F.lit(";I"), e("insertion_n").cast("string"), F.lit(";S"), e("substitution_n").cast("string")),
        "DEL": edit_text(starts(e("deletion_coordinates")), e("deletion_sizes")),
        "INS": edit_text(starts(e("insertion_coordinates")), e("insertion_sizes"), inserted_bases(F.col(read), e("ref_positions"), e("insertion_coordinates"), e("insertion_sizes"))),
        "SUB": F.array_join(F.transform(e("substitution_positions"), lambda p: p.cast("string")), ";"),
    }


def any_of(seq: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [seq.contains(p) for p in parts], F.lit(False))
