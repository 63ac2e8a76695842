"""Whole analyses on small made-up experiments."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ampliq.operators import amino, guess, prime
from ampliq.operators import references as R
from ampliq.operators.align import alignments
from ampliq.plans import modes

RNG = np.random.default_rng(11)
A, B = ("".join(RNG.choice(list("ACGT"), 120)) for _ in range(2))
REFS = [R.build(n, s, [s[50:70]], skip_left=5, skip_right=5) for n, s in (("a", A), ("b", B))]
CUT = REFS[0].guides[0].cut


def edited(s, k):
    return s[: CUT - 1] + s[CUT - 1 + k :] if k else s


@pytest.fixture(scope="module")
def result(spark):
    rows = [("x", A)] * 6 + [("x", edited(A, 4))] * 3 + [("x", R.rc(edited(A, 4)))] + [("x", B)] * 2 + [("y", A)] * 5 + [("y", "ACGT" * 20)]
    return modes.batch(spark.createDataFrame(rows, "sample string, seq string"), REFS)


def test_batch(result):
    got = {(r["sample"], r.ref_name): (r.n_reads, r.modified, r.deletions) for r in result["editing"].collect()}
    assert got == {("x", "a"): (10, 4, 4), ("x", "b"): (2, 0, 0), ("y", "a"): (5, 0, 0)}
    assert {r.fraction for r in result["modifications"].where("sample = 'x' and kind = 'deletion'").collect()} == {0.4}


def test_compare(result):
    out = modes.compared(result["variants"], REFS, "x", "y")
    (row,) = out["editing"].where("ref_name = 'a'").collect()
    assert abs(row.modified_diff - 40) < 1e-9
    assert out["tests"].where("ref_name = 'a' and kind = 'deletion' and n_1 = 4").count() == 4
    assert out["alleles"].where("n_reads_1 = 6 and n_reads_2 = 5").count() == 1


def test_pooled(spark):
    reads = spark.createDataFrame([(A,)] * 5 + [(B,)] * 2, "seq string")
    got = {r.ref_name: (r.n_reads, r.modified) for r in modes.pooled(reads, REFS, 3)["editing"].collect()}
    assert got == {"a": (5, 0), "b": (2, None)}


def test_ambiguous_reads_are_set_apart(spark):
    twins = [REFS[0], R.build("c", A, [A[50:70]], skip_left=5, skip_right=5)]
    got = {r.ref_name: r.n_reads for r in modes.pooled(spark.createDataFrame([(A,)] * 3, "seq string"), twins)["editing"].collect()}
    assert got == {"AMBIGUOUS": 3}


def test_whole_genome(spark):
    genome = "".join(RNG.choice(list("ACGT"), 30)) + A + "TTTT"
    records = spark.createDataFrame([("r1", "c", 21, "140M", genome[20:160]), ("r2", "c", 21, "65M4D71M", genome[20:85] + genome[89:160]), ("r3", "c", 100, "20M", genome[99:119])], "id string, chr string, pos long, cigar string, seq string")
    regions = spark.createDataFrame([("c", 31, 150, "site")], "chr string, bpstart long, bpend long, name string")
    (row,) = modes.whole_genome(records, regions, {"site": REFS[0]})["editing"].collect()
    assert (row.region, row.n_reads, row.deletions) == ("site", 2, int(55 <= CUT <= 58 or 55 <= CUT + 1 <= 58))


def test_whole_genome_derives_a_record_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def cigar(note):
        seen.add(1)
        return note

    rows = [("120M", A)] * 30 + [(f"{CUT - 1}M4D{117 - CUT}M", edited(A, 4))] * 9 + [("100M", A[:100])]
    records = spark.createDataFrame(rows, "note string, seq string").select(F.lit("c").alias("chr"), F.lit(31).cast("long").alias("pos"), cigar("note").alias("cigar"), "seq")
    regions = spark.createDataFrame([("c", 31, 150, "site"), ("c", 31, 130, "b")], "chr string, bpstart long, bpend long, name string")
    out = modes.whole_genome(records, regions, {"site": REFS[0], "b": REFS[1]}, min_reads=40)
    assert [tuple(r) for r in out["depth"].collect()] == [("b", 40)] and seen.value == len(rows)
    out = modes.whole_genome(records, regions, {"site": REFS[0]})
    assert [(r.region, r.n_reads, r.deletions) for r in out["editing"].collect()] == [("site", 39, 9)]
    assert seen.value == 2 * len(rows)  # filters on what comes of it are not moved below it, and the depth is summed from the same reads


def _mapped(spark, reads, start):
    return spark.createDataFrame([("c", start + 1, c, s) for c, s in reads], "chr string, pos long, cigar string, seq string")


def test_pooled_on_a_genome(spark):
    genome = "".join(RNG.choice(list("ACGT"), 30)) + A + "TTTT" + B
    contigs = spark.createDataFrame([("c", genome)], "chr string, seq string")
    at_a = _mapped(spark, [("120M", A)] * 3 + [(f"{CUT - 1}M4D{117 - CUT}M", edited(A, 4))] * 2, 30)
    records = at_a.union(_mapped(spark, [("120M", B)] * 2, 154))
    out = modes.pooled_on_genome(records, contigs, [A[50:70]], min_reads=2, skip_left=5, skip_right=5)
    assert [(r.name, r.n_reads) for r in out["regions"].collect()] == [("REGION_c_31_151", 5)]
    assert [(r.region, r.n_reads, r.deletions) for r in out["editing"].collect()] == [("REGION_c_31_151", 5, 2)]
    places = spark.createDataFrame([("a", "c", 31, 150), ("none", "c", 900, 999)], "name string, chr string, bpstart long, bpend long")
    mixed = modes.pooled_mixed(records, places, REFS, min_reads=1)
    assert {r.name: r.n_reads for r in mixed["depth"].collect()} == {"a": 5, "none": 0}
    assert [(r.bpstart, r.n_reads) for r in mixed["unmatched"].collect()] == [(155, 2)] and [(r.region, r.deletions) for r in mixed["editing"].collect()] == [("a", 2)]


def test_regions_compared(result):
    out = modes.regions_compared(result["variants"], REFS, "x", "y")
    got = {r.ref_name: (r.unmodified_diff, r.n_reads_2) for r in out["difference"].collect()}
    assert abs(got["a"][0] + 40) < 1e-9 and got["b"] == (None, None)
    assert {r.ref_name for r in out["significant"].collect()} == {"a"}


def test_the_aligner_is_planned_once(spark):
    rows = spark.createDataFrame([("x", A), ("y", B)], "sample string, seq string")
    v = modes.called(rows, [r.as_row() for r in REFS], {r.name: r.window for r in REFS}, ["sample"])
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the aligner, and the calling of edits


def test_pairs(spark):
    pairs = spark.createDataFrame([(A[:80], A[40:], "I" * 80, "I" * 80)] * 2 + [(edited(A, 4)[:80], edited(A, 4)[40:], "I" * 80, "I" * 76)], "seq1 string, seq2 string, qual1 string, qual2 string")
    got = {r.aln_seq.replace("-", ""): (r.n_reads, r.edits.deletion_n) for r in modes.paired(pairs, REFS, []).collect()}
    assert got[A][0] == 2 and got[A][1] == 0 and got[edited(A, 4)] == (1, 4)


def test_guessing():
    site = A[:70] + "AGG" + A[73:]
    guide_seq = site[50:70]
    counts = [(site, 50)] + [(site[: 66 - k] + site[67:], 10) for k in range(3)]
    assert guess.amplicons([("A" * 30, 50), ("A" * 29 + "C", 40), ("CG" * 16, 30)], 100) == ["A" * 30, "CG" * 16]
    found, base_editor = guess.guide(site, counts)
    assert found is not None and len(found) == 20 and not base_editor and (found == guide_seq or found in site)
    assert guess.guide(site, [(site, 10)]) == (None, None)


def test_silent_edits(spark):
    assert amino.silent_marked("AG-S", ["GCT", "GGT", "AGT"], "AGTS", ["GCT", "GGT", "ACT", "AGC"]) == "AGTs"
    a = spark.createDataFrame([("TTGCTGGTAGC", "TTGCTGGTAGT", "MODIFIED", 0, 0, 1, 5)], "aln_seq string, aln_ref string, read_status string, n_deleted int, n_inserted int, n_mutated int, n_reads long")
    (row,) = amino.amino_alleles(a, [], 2, 10, 1).collect()
    assert (row.aln_seq, row.aln_ref, row.silent, row.n_reads) == ("AGS", "AGS", [2], 5)


def test_scaffold(spark):
    v = spark.createDataFrame([("p", "ACGTGG--AA", "ACGT--TTAA", 3), ("p", "ACGTTTAA", "ACGTTTAA", 2)], "ref_name string, aln_seq string, aln_ref string, n_reads long")
    assert prime.scaffold_search("ACGTTTAA", "ACGTTTAA", "CGT", "GGCC") == (4, "G")
    got = {r.ref_name: r.n_reads for r in prime.with_scaffold(v, "p", 4, "GG").collect()}
    assert got == {"Scaffold-incorporated": 3, "p": 2}
    assert {(r.matched, r.n_reads) for r in prime.scaffold_sizes(v, 4, "GGCC", []).collect()} == {(2, 3), (0, 2)}


def test_edits_from_the_first_reference(spark):
    reads = spark.createDataFrame([(edited(A, 4),)], "seq string")
    both = alignments(reads, [r.as_row() for r in REFS])
    out = prime.from_first(both, spark.createDataFrame([(edited(A, 4), "b", 7)], "seq string, ref_name string, n_reads long"), "a", REFS[0].window)
    (row,) = out.select("assigned_ref", "n_reads", F.col("edits.deletion_n").alias("d")).collect()
    assert (row.assigned_ref, row.n_reads, row.d) == ("b", 7, 4)


def test_pairs_find_the_best_of_all_references(spark):
    """The pruned candidates give what a consensus of every pair with every reference and strand gives."""
    from ampliq.operators.align import align, rc, scoring_matrix
    from ampliq.operators.pairs import consensus

    rows = []
    for k in range(60):
        s = edited((A, B, rc(A))[k % 3], k % 5)
        one, two = s[:80], s[30:]
        two = two[:10] + "".join(RNG.choice(list("ACGT"), 8)) + two[18:] if k % 2 else two
        rows.append((one, two, "".join(RNG.choice(list("#5I"), len(one))), "".join(RNG.choice(list("#5I"), len(two)))))
    want = {}
    for one, two, p, q in rows:
        per_ref = []
        for r in (x.as_row() for x in REFS):
            sides = []
            for x, y, u, v in ((one, two, p, q), (rc(one), rc(two), p[::-1], q[::-1])):
                a, b = (align([t], r["seq"], scoring_matrix(), r["incentive"])[0] for t in (x, y))
                sides.append(consensus((*a, u), (*b, v)))
            m = sides[1] if sides[1][3] > sides[0][3] else sides[0]
            per_ref.append((m[3], r["name"], m[0], m[2], float(r["min_score"])))
        top = max((x for x in per_ref if x[0] > x[4]), default=None, key=lambda x: x[0])
        if top:
            want[one, two, p, q] = top[1:4]
    df = spark.createDataFrame(rows, "seq1 string, seq2 string, qual1 string, qual2 string")
    got = {(r.seq1, r.seq2, r.qual1, r.qual2): (r.ref_name, r.aln_seq, r.aln_ref) for r in modes.paired(df, REFS, []).collect()}
    assert got == want and len(want) > 40


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["J08_pooled", "J05_batch_from_reads", "E02_best_reference", "E07_variants_by_alignment", "E08_paired_variants", "F14_from_first_reference"])
def test_queries_take_all_reads(spark, name):
    """Every read of the table is in the result, under the reference it was made from."""
    from ampliq.plans.derived import reads

    found = entry.queries()[name](spark, SF)
    column = "assigned_ref" if name.startswith("F14") else "ref_name"
    want = {r.ref_name: r["count"] for r in reads(spark, SF).groupBy("ref_name").count().collect()}
    assert {r[column]: r.n for r in found.groupBy(column).agg(F.sum("n_reads").alias("n")).collect()} == want and len(want) == 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_amino_acids_and_guesses_take_all_references(spark):
    from ampliq.plans.derived import reads, references

    q, seqs = entry.queries(), {r.ref_name: r.ref_seq for r in references(spark, SF).collect()}
    assert q["F19_amino_acid_alleles"](spark, SF).agg(F.sum("n_reads")).first()[0] == reads(spark, SF).count()
    counts = {r.read_seq: r["count"] for r in reads(spark, SF).groupBy("read_seq").count().collect()}
    share = 0.02 * sum(counts.values())
    assert {s for s in seqs.values() if counts[s] > share} <= {r.amplicon for r in q["E23_guessed_amplicons"](spark, SF).collect()}
    assert {r.ref_name for r in q["E24_guessed_guide"](spark, SF).collect()} == set(seqs)
