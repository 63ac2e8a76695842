import itertools
import random
import re
import time
from math import comb

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ampliq.functions import qualities as Q
from ampliq.functions import sequences as S
from ampliq.operators import alleles as A
from ampliq.operators import compare as C
from ampliq.operators import positions as P
from ampliq.operators import quantify as Z
from ampliq.operators import regions as R
from ampliq.operators.base_edits import base_edit_counts, combinations
from ampliq.operators.edits import with_edits
from ampliq.operators.pairs import Mates, bounds_of, consensus, consensus_of
from ampliq.sources import vcf


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1)).select(column).first()[0]


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.col("s")), s="aacgN-") == "-NCGTT"
    assert one(spark, S.illegal_bases(F.col("s")), s="ACXTB") == ["B", "X"]
    assert one(spark, S.translated(F.col("s")), s="ATGGCC---TAAC") == "MA-*"
    assert one(spark, S.codons(F.col("s")), s="AC") == []
    assert one(spark, S.alignment_cigar(F.col("a"), F.col("b")), a="AC-GTT", b="ACTG-T") == "2M1D1M1I1M"
    assert one(spark, S.cigar_length(F.col("c"), "MDN=X"), c="3S10M2I4D5M") == 19
    start, end = S.clip_extended(F.lit(100), F.col("c"))
    assert one(spark, F.struct(start, end), c="2H3S10M4S") == (97, 114)
    assert one(spark, S.contains_inside(F.col("s"), F.lit("ACG")), s="ACGAAA") is False
    assert one(spark, S.contains_inside(F.col("s"), F.lit("ACG")), s="TACGAAA") is True
    assert one(spark, S.slug(F.col("s")), s="a b/c__d") == "a_b_c_d"


def test_qualities(spark):
    reads = spark.createDataFrame([("ACGT", "IIII"), ("ACGT", "I!II"), ("ACGT", "5555")], "seq string, qual string")
    assert Q.filtered(reads, min_single=20).count() == 2 and Q.filtered(reads, min_mean=25).count() == 2
    assert {r.seq for r in Q.filtered(reads, mask_below=30).collect()} == {"ACGT", "ANGT", "NNNN"}
    assert Q.by_presence(reads, ["CG"], ["TT"]).count() == 3 and Q.by_presence(reads, ["CG"], ["GT"]).count() == 0


def test_positions_by_the_cut(spark):
    pairs = spark.createDataFrame([("r", "ACGGTACGT", "ACG-TACGT", 3), ("r", "AC--ACGT", "ACGTACGT", 2), ("r", "ACGTACGT", "ACGTACGT", 5)], "ref_name string, aln_seq string, aln_ref string, n_reads long")
    v = with_edits(pairs, {"r": [2, 3]})
    counts = {(r.kind, r.pos): r.n for r in P.edit_positions(v, ["ref_name"], True).collect()}
    assert counts == {("insertion", 2): 3, ("insertion", 3): 3, ("deletion", 2): 2, ("deletion", 3): 2}
    piles = {(r.pos, r.base): r.n for r in P.nucleotides(v, []).collect()}
    assert piles[(2, "-")] == 2 and piles[(2, "G")] == 8 and sum(n for (p, _), n in piles.items() if p == 5) == 10
    table = A.around_cut(A.allele_table(v, []), ["ref_name"], F.lit(2), 3, 3)
    assert {(r.aln_seq, r.aln_ref) for r in table.collect()} == {("ACGGTA", "ACG-TA"), ("AC--AC", "ACGTAC"), ("ACGTAC", "ACGTAC")}


def test_a_base_between_two_insertions_counts_once(spark):
    v = with_edits(spark.createDataFrame([("r", "ATCTG", "A-C-G", 1)], "ref_name string, aln_seq string, aln_ref string, n_reads long"), {"r": [0, 1, 2]})
    assert {(r.pos, r.n) for r in P.edit_positions(v, []).where("kind = 'insertion'").collect()} == {(0, 1), (1, 1), (2, 1)}


def test_fisher():
    assert abs(C.fisher_exact(1, 9, 11, 3) - 0.002759456185220083) < 1e-12
    assert C.fisher_exact(0, 0, 0, 0) == 1.0 and abs(C.fisher_exact(5, 5, 5, 5) - 1) < 1e-9


@settings(max_examples=400, deadline=None)
@given(st.tuples(*[st.integers(0, 60)] * 4))
def test_fisher_same_as_counting_tables(table):
    a, b, c, d = table
    rows, other, first = a + b, c + d, a + c
    ways = {k: comb(rows, k) * comb(other, first - k) for k in range(max(0, first - other), min(first, rows) + 1)}
    want = sum(w for w in ways.values() if w <= ways[a]) / sum(ways.values())
    assert abs(C.fisher_exact(*table) - want) <= 1e-11 * want


def test_fisher_of_many_reads_is_quick():
    assert abs(C.fisher_exact(0, 100_000, 30, 100_000) / 1.8586164995e-09 - 1) < 1e-6  # summed table by table
    start = time.process_time()
    for _ in range(50):
        C.fisher_exact(5_000_000, 5_000_000, 4_999_000, 5_001_000)
    assert (time.process_time() - start) / 50 < 0.01  # some 0.5 ms


def test_merged_alleles(spark):
    kind = "aln_seq string, n_reads long, pct_reads double"
    a, b = spark.createDataFrame([("A", 1, 50.0), ("B", 1, 50.0)], kind), spark.createDataFrame([("B", 3, 100.0)], kind)
    got = {r.aln_seq: (r.n_reads_1, r.n_reads_2) for r in C.merged_alleles(a, b, ["aln_seq"]).collect()}
    assert got == {"A": (1, 0), "B": (1, 3)}


def test_strands_merge_under_the_first_spelling(spark):
    reads = spark.createDataFrame([("AAC", 2, 5), ("GTT", 3, 1), ("ACGT", 4, 0)], "seq string, n_reads long, first_seen long")
    assert {(r.seq, r.n_reads) for r in A.strand_merged(reads, []).collect()} == {("GTT", 5), ("ACGT", 4)}


def test_regions(spark):
    reads = spark.createDataFrame([("a", "c", 5, "3S4M2D5M", "TTTACGTACGTA"), ("b", "c", 9, "4M", "ACGT")], "id string, chr string, pos long, cigar string, seq string")
    regions = spark.createDataFrame([("c", 7, 13, "r")], "chr string, bpstart long, bpend long, name string")
    (row,) = R.covering(reads, regions).collect()
    assert row.id == "a" and row.seq == "GTACG"
    big = spark.createDataFrame([("c", 1, 100_000)], "chr string, s long, e long")
    assert R.overlapping(big, spark.createDataFrame([("c", 5, 50_000), ("d", 1, 2)], "chr string, s2 long, e2 long"), "chr", ("s", "s2"), ("e", "e2")).count() == 1


def test_base_edit_codes(spark):
    a = spark.createDataFrame([("TCA-C", "CCACC", 2), ("CCAAC", "C-AAC", 1)], "aln_seq string, aln_ref string, n_reads long")
    assert {(r.combination, r.n_reads) for r in combinations(a, [], "C", "T").collect()} == {("TRDR", 2), ("IR", 1)}


def test_consensus():
    seq, qual, ref, score, settled = consensus(("ACGT----", "ACGTACGT", 90.0, "IIII"), ("------GT", "ACGTACGT", 80.0, "55"))
    assert (seq, qual, ref, settled) == ("ACGTNNGT", "IIII55", "ACGTACGT", True)
    seq, _, _, _, settled = consensus(("ACGA", "ACGT", 90.0, "III#"), ("ACGT", "ACGT", 80.0, "IIII"))
    assert seq == "ACGT" and not settled
    assert consensus(("ACA", "ACT", 90.0, "III"), ("ACG", "ACT", 95.0, "III"))[0] == "ACG"


@pytest.mark.parametrize(("ref", "pos", "size", "added", "want"), [("GCAAAT", 4, 1, "", (1, "CA", "C")), ("AAAT", 2, 1, "", (0, "AA", "A")), ("ACGT", 2, 1, "G", (1, "C", "CG")), ("ACACACG", 4, 2, "", (0, "ACA", "A")), ("GATATC", 5, 2, "AT", (0, "G", "GAT"))])
def test_vcf_left_alignment(spark, ref, pos, size, added, want):
    (row,) = spark.range(1).select(vcf.left_aligned(F.lit(ref), F.lit(pos), F.lit(size), F.lit(added)).alias("x")).select("x.*").collect()
    assert tuple(row) == want


def test_values_at_reference_positions(spark):
    value = lambda ref, read: spark.range(1).select(S.values_at_reference(F.lit(read), F.lit(ref)).alias("v")).first().v
    assert value("--A-TGC-", "GGAGTCGA") == ["GGAG", "T", "C", "GA"] and value("ACGT", "A-GT") == ["A", "-", "G", "T"]


def test_annotation_of_edits(spark):
    v = with_edits(spark.createDataFrame([("r", "ACGTTA-T", "AC--TACT")], "ref_name string, aln_seq string, aln_ref string"), {"r": [1, 2, 3, 4]})
    assert tuple(v.select(*S.annotation().values()).first()) == ("D1;I2;S0", "4(1)", "1(2+GT)", "")


def test_slug_folds_accents(spark):
    assert one(spark, S.slug(F.col("s")), s="Étude № ﬁ 3/日") == "Etude_3_" and spark.range(1).select(S.contains_fragment(F.lit("AACCGG"), "TTTCCGTTT")).first()[0] is True


def test_base_edit_tables(spark):
    a = spark.createDataFrame([("TCA-C", "CCACC", 1, 0, 2), ("CCAAC", "C-AAC", 0, 1, 1), ("TTATT", "CCACC", 0, 0, 4)], "aln_seq string, aln_ref string, n_deleted int, n_inserted int, n_reads long")
    t = base_edit_counts(a, [], "C", "T")
    assert {(r.has_indel, r.combination, r.n_reads) for r in t["precise"].collect()} == {(True, "T,C,-,C", 2), (True, "CC,C", 1), (False, "T,T,T,T", 4)}
    assert {(r.combination, r.n_reads) for r in t["binary"].collect()} == {("TXXX", 2), ("XX", 1), ("TTTT", 4)}
    assert tuple(t["reads"].first()) == (0, 0, 4, 0, 0, 3)
    assert {r.pos: (r.total, r.target, r.deletion, r.insertion) for r in t["positions"].collect()} == {0: (7, 6, 0, 1), 1: (6, 4, 0, 0), 3: (7, 4, 2, 0), 4: (6, 4, 0, 0)}


def test_allele_files_that_match(spark):
    kind = "sequence string, guides array<string>, cuts array<int>, files array<string>"
    one_run = spark.createDataFrame([("A", ["g"], [5], ["a1"]), ("C", ["g"], [5], ["c1"]), ("G", ["g", "h"], [5, 9], ["g1", "g2"])], kind)
    other = spark.createDataFrame([("A", ["g"], [6], ["a3"]), ("C", ["x"], [5], ["c3"]), ("G", ["h", "g"], [5, 9], ["g3"])], kind)
    assert [tuple(r) for r in C.matching_alleles(one_run, other).collect()] == [("G", "g1", "g3")]


def test_stored_alleles_in_another_window(spark):
    v = with_edits(spark.createDataFrame([("r", "ACGTACGT", "ACGTACGT", 3), ("AMBIGUOUS", "ACG-ACGT", "ACGTACGT", 1)], "ref_name string, aln_seq string, aln_ref string, n_reads long"), {"r": [2, 3], "AMBIGUOUS": [2, 3]})
    stored = A.allele_table(v, [])
    assert A.ambiguous(stored).agg(F.sum("n_reads")).first()[0] == 1
    got = {(r.ref_name, r.aln_seq, r.n_reads, r.pct_reads) for r in A.rewindowed(stored, None, 2, 2, [], center=3).collect()}
    assert got == {("r", "GTAC", 3, 75.0), ("AMBIGUOUS", "G-AC", 1, 25.0)}
    whole = A.around_cut(stored, ["ref_name"], F.lit(3), 1, 1, keep_whole=True).where("ref_name = 'r'").first()
    assert (whole.aln_seq, whole.whole_seq, whole.n_reads) == ("TA", "ACGTACGT", 3)


def test_guardrails_follow_the_published_directions(spark):
    stats = spark.createDataFrame([(20000, 20000, 99, 9901, 100, 10, 30, 60)], "n_total long, n_aligned long, mods_in_window long, mods_outside_window long, substitution_n long, substitutions_outside_window long, irregular_ends long, read_length int")
    counts = spark.createDataFrame([("a", 19000), ("b", 1000)], "ref_name string, n_reads long")
    rows = Z.guardrails(stats, counts, {"a": 100, "b": 45}, {"g": 18}).collect()
    got = {(r.check, r.subject): r.raised for r in rows}
    assert got == {
        ("total_reads", None): False, ("aligned_share", None): False, ("share_in_window", None): True, ("ends_modified", None): False, ("outside_window_substitutions", None): True, ("substitution_rate", None): False,
        ("amplicon_length", "a"): False, ("amplicon_length", "b"): True, ("guide_length", "g"): True, ("amplicon_to_read_length", "a"): True, ("amplicon_to_read_length", "b"): False, ("proportion", "a"): True, ("proportion", "b"): True,
    }
    assert Z.guardrails(stats.selectExpr(*[f"{c} * 0 AS {c}" for c in stats.columns]), counts, {"a": 100}, {}).where("check = 'share_in_window'").count() == 0


def test_places_of_bases_by_running_sums(spark):
    def plain(pos, cigar):
        out = []
        for n, op in re.findall(r"(\d+)([A-Z=])", cigar):
            out += list(range(pos, pos + int(n))) if op in "M=X" else [None] * int(n) if op in "SI" else []
            pos += int(n) if op in "M=XDN" else 0
        return out

    cigars = ["10M", "3S4M2I5M1D2M4S", "5H2S3=1X4N6M", "*", "2D3M", "4I", "1M1000000N1M"]
    df = spark.createDataFrame([(c, p) for c in cigars for p in (1, 5, 8, 12, 16, 1_000_006)], "cigar string, at int")
    for r in df.select("cigar", "at", R.read_offsets(F.lit(5), F.col("cigar")).alias("every"), R.read_offset(F.lit(5), F.col("cigar"), F.col("at")).alias("one")).collect():
        want = plain(5, r.cigar)
        assert r.every == want and r.one == (want.index(r["at"]) if r["at"] in want else None)


def test_batches_of_qualities_same_as_plain():
    rng = random.Random(4)
    rows = [("".join(rng.choice("ACGT") for _ in range(n)), "".join(chr(33 + rng.randrange(41)) for _ in range(n + rng.choice([0, 0, 0, -1, 2]) if n > 3 else n))) for n in rng.choices(range(9), k=200)] + [(None, "II"), ("AC", None), (None, None)]
    for some in (rows, [r for r in rows if r[0] is not None and r[1] is not None and len(r[0]) == len(r[1])], []):
        seq, qual = (pa.array(["x", *[r[k] for r in some]], pa.string())[1:] for k in (0, 1))
        for least, mean, below in ((0, 0, 10), (3, 0, 0), (0, 22.5, 20), (2, 15, 5)):
            want = []
            for s, q in some:
                values = [ord(c) - 33 for c in q or ""]
                keep = not (least or mean) or bool(values) and min(values) >= least and sum(values) / len(values) >= mean
                masked = s if s is None else "".join("N" if k < len(values) and values[k] < below else c for k, c in enumerate(s))
                want.append({"keep": keep, "seq": masked if below else s})
            assert Q.checked(seq, qual, least, mean, below).to_pylist() == want


def plain_consensus(first, second):
    """A walk along the columns of one pair."""
    def laid(read, ref, qual):
        out, pos, inserted, q = {}, 0, 0, iter(qual)
        for b, r in zip(read, ref, strict=True):
            pos, inserted = (pos + 1, 0) if r != "-" else (pos, inserted + 1)
            out[pos, inserted] = (b, r, next(q) if b != "-" else "")
        return out

    cells = [laid(x[0], x[1], x[3]) for x in (first, second)]
    spans = [[k for k, c in m.items() if c[0] != "-"] for m in cells]
    columns, settled = [], True
    for key in sorted(set(cells[0]) | set(cells[1])):
        at = [m.get(key) for m in cells]
        have = [c for c in at if c and c[0] != "-"]
        ref = next(c[1] for c in at if c)
        if len(have) == 2:
            settled &= have[0][0] == have[1][0]
            order = (have[0][2], first[2] >= second[2]), (have[1][2], first[2] < second[2])
            columns.append((*(have[0] if order[0] > order[1] else have[1])[::2], ref))
        elif have:
            columns.append((*have[0][::2], ref))
        elif not key[1]:
            columns.append(("-" if any(s and s[0] <= key <= s[-1] for s in spans) else "N", "", ref))
    kept = [k for k, c in enumerate(columns) if c[2] != "-"]
    columns = columns[kept[0] : kept[-1] + 1] if kept else columns
    seq, qual, ref = ("".join(c[k] for c in columns) for k in range(3))
    return seq, qual, ref, round(100 * sum(a == b for a, b in zip(seq, ref, strict=True)) / float(max(1, len(ref))), 3), settled


MATE = st.lists(st.sampled_from([x + y for x in "ACG-" for y in "ACG-" if x + y != "--"]), max_size=10)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(MATE, MATE, st.sampled_from([80.0, 90.0]), st.sampled_from([80.0, 90.0]), st.randoms(use_true_random=False)), min_size=1, max_size=5))
def test_consensus_of_batches_same_as_walking_along(rows):
    sides = [[], []]
    for one, two, a, b, rng in rows:
        for side, mate, score in zip(sides, (one, two), (a, b), strict=True):
            read = "".join(c[0] for c in mate)
            side.append((read, "".join(c[1] for c in mate), score, "".join(rng.choice("#5I") for c in read if c != "-")))
    found = consensus_of(*(Mates.of(*zip(*side, strict=True)) for side in sides))
    got = list(zip(found.texts(found.read), found.qualities(), found.texts(found.ref), found.score.tolist(), found.settled.tolist(), strict=True))
    assert got == [plain_consensus(*x) for x in zip(*sides, strict=True)]


def test_bounds_hold_whatever_the_qualities():
    rng, sides = random.Random(6), [[], []]
    for _ in range(300):
        ref = rng.choices("ACG", k=rng.randrange(1, 9))
        for side in sides:
            columns = [c for r in ref for c in [*(rng.choice("ACG") + "-" for _ in range(rng.choice([0, 0, 0, 2]))), rng.choice([r, r, "A", "-"]) + r]]
            read = "".join(c[0] for c in columns)
            side.append((read, "".join(c[1] for c in columns), rng.choice([80.0, 90.0]), "".join(rng.choice("#5I") for c in read if c != "-")))
    found = consensus_of(*(Mates.of(*zip(*side, strict=True)) for side in sides))
    low, high = bounds_of(*(Mates.of(*list(zip(*side, strict=True))[:3]) for side in sides))
    assert ((low <= found.score) & (found.score <= high)).all() and (low < high).any() and (low == high)[found.settled].all()


def test_cigars_of_all_kinds_of_pairs(spark):
    pairs = [("ACGT", "ACGT"), ("A--T", "ACGT"), ("ACGT", "A--T"), ("--GT", "ACGT"), ("ACG-", "A-GT"), ("-CGT", "A--T"), ("A-GT", "A-GT"), ("-", "A"), ("A", "-"), ("", ""), (None, "A"), ("A", None), ("ACG", "A"), ("NNac", "NN-c")]

    def plain(q, r):
        kinds = ["D" if a == "-" else "I" if b == "-" else "M" for a, b in itertools.zip_longest(q, r)]
        return "".join(f"{len(list(run))}{k}" for k, run in itertools.groupby(kinds))

    df = spark.createDataFrame(pairs, "q string, r string").select("q", "r", S.alignment_cigar(F.col("q"), F.col("r")).alias("cigar"))
    assert {(x.q, x.r): x.cigar for x in df.collect()} == {(q, r): None if q is None or r is None else plain(q, r) for q, r in pairs}
