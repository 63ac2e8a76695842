"""The vectorised aligner against a plain triple loop, and edit calling."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from ampliq.operators.align import ALIGNED, DELETE, INSERT, MATCH, align, aligned_reads, best_alignments, best_references, common_length, rc, scoring_matrix
from ampliq.operators.edits import Windows, call_edits, edits_of


def plain(read, ref, matrix, favour, opening=-20, extension=-2):
    m, n = len(read), len(ref)
    low = opening * m * n
    s = {(MATCH, 0, 0): 0, (INSERT, 0, 0): low, (DELETE, 0, 0): low}
    came = {}
    for j in range(1, m + 1):
        s[MATCH, 0, j], s[DELETE, 0, j], s[INSERT, 0, j] = low, low, extension * j + favour[0]
        came[MATCH, 0, j] = came[INSERT, 0, j] = came[DELETE, 0, j] = INSERT
    for i in range(1, n + 1):
        s[MATCH, i, 0], s[INSERT, i, 0], s[DELETE, i, 0] = low, low, extension * i + favour[0]
        came[MATCH, i, 0] = came[INSERT, i, 0] = came[DELETE, i, 0] = DELETE
        for j in range(1, m + 1):
            o = extension if i == n or j == m else opening
            a, b = o + s[MATCH, i, j - 1] + favour[i], extension + s[INSERT, i, j - 1] + favour[i]
            s[INSERT, i, j], came[INSERT, i, j] = (a, MATCH) if a > b else (b, INSERT)
            a, b = o + s[MATCH, i - 1, j] + favour[i - 1], extension + s[DELETE, i - 1, j]
            s[DELETE, i, j], came[DELETE, i, j] = (a, MATCH) if a > b else (b, DELETE)
            best = max((s[INSERT, i - 1, j - 1], 3, INSERT), (s[DELETE, i - 1, j - 1], 2, DELETE), (s[MATCH, i - 1, j - 1], 1, MATCH))
            s[MATCH, i, j], came[MATCH, i, j] = best[0] + int(matrix[ord(ref[i - 1]), ord(read[j - 1])]), best[2]
    i, j = n, m
    layer = max((s[INSERT, i, j], 3, INSERT), (s[DELETE, i, j], 2, DELETE), (s[MATCH, i, j], 1, MATCH))[2]
    a, b = "", ""
    while i or j:
        layer = INSERT if i == 0 else DELETE if j == 0 else layer
        before = came[layer, i, j]
        a += read[j - 1] if layer != DELETE else "-"
        b += ref[i - 1] if layer != INSERT else "-"
        i, j, layer = i - (layer != INSERT), j - (layer != DELETE), before
    return a[::-1], b[::-1]


BASES = st.text("ACGTN", min_size=1, max_size=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(BASES, min_size=1, max_size=4), st.text("ACGT", min_size=1, max_size=14), st.integers(0, 14))
def test_same_as_plain_loops(reads, ref, cut):
    favour = np.zeros(len(ref) + 1, int)
    favour[min(cut, len(ref))] = 1
    matrix = scoring_matrix()
    for read, (a, b, score) in zip(reads, align(reads, ref, matrix, favour), strict=True):
        assert (a, b) == plain(read, ref, matrix, favour)
        assert a.replace("-", "") == read and b.replace("-", "") == ref
        assert score == round(100 * sum(x == y for x, y in zip(a, b, strict=True)) / float(len(a)), 3)


def test_reverse_complement():
    assert rc("AACGTN-") == "-NACGTT"


def test_edits_of_each_kind():
    e = call_edits("ACGTTACGT", "ACG-TACGT", {2, 3})
    assert e["insertion_coordinates"] == [{"start": 2, "end": 3}] and e["insertion_n"] == 1 and e["ref_positions"][:5] == [0, 1, 2, -3, 3]
    assert call_edits("ACGTTACGT", "ACG-TACGT", {3})["insertion_n"] == 0
    assert call_edits("ACGTTACGT", "ACG-TACGT", {3}, either_flank=True)["insertion_n"] == 1
    e = call_edits("A--TACGT", "ACGTACGT", {2})
    assert e["deletion_coordinates"] == [{"start": 1, "end": 3}] and e["deletion_n"] == 2 and not e["irregular_ends"]
    e = call_edits("ACGTACNA", "ACGTACGT", {7})
    assert e["all_substitution_positions"] == [7] and e["substitution_values"] == ["A"] and e["irregular_ends"]


def test_edits_at_the_ends():
    assert call_edits("TACGT", "-ACGT", {0})["all_insertion_positions"] == []
    assert call_edits("ACGTA", "ACGT-", {3})["all_insertion_positions"] == []
    assert call_edits("--GT", "ACGT", {0})["deletion_coordinates"] == [{"start": 0, "end": 2}]
    assert call_edits("AC--", "ACGT", {3})["deletion_coordinates"] == [{"start": 2, "end": 4}]


def test_deletion_that_meets_an_insertion_has_no_positions():
    e = call_edits("A-TTC", "AG--C", {0, 1, 2})
    assert len(e["all_deletion_coordinates"]) == 1 and e["all_deletion_positions"] == []


def plain_edits(read, ref, window, either_flank):
    """Edit calling by walking along the columns of one pair."""
    positions, seen = [], 0
    for c in ref:
        seen += c != "-"
        positions.append(seen - 1 if c != "-" else -seen if seen else -1)
    subs = [(p, x) for p, x, y in zip(positions, read, ref, strict=True) if y != "-" and x not in (y, "-", "N")]
    insertions, deletions, k = [], [], 0
    while k < len(ref):
        end = k
        while end < len(ref) and ref[end] == "-":
            end += 1
        if end > k:
            left = sum(c != "-" for c in ref[:k]) - 1
            insertions += [(left, end - k)] if left >= 0 and end < len(ref) else []
        k = max(end, k + 1)
    k = 0
    while k < len(read):
        end = k
        while end < len(read) and read[end] == "-":
            end += 1
        if end > k:
            deletions.append((positions[k] if k else 0, positions[end] if end < len(read) else positions[-1] + 1))
        k = max(end, k + 1)
    counted = [x for x in insertions if ((x[0] in window) + (x[0] + 1 in window)) >= (1 if either_flank else 2)]
    hit = [x for x in deletions if set(range(*x)) & window]
    subs_in = [x for x in subs if x[0] in window]
    pair = lambda found: [{"start": a, "end": b} for a, b in found]
    total = len(insertions) + sum(len(range(*x)) for x in deletions) + len(subs)
    inside = len(subs_in) + sum(b - a for a, b in hit) + sum(n for _, n in counted)
    return {
        "all_insertion_positions": [p for a, _ in insertions for p in (a, a + 1)], "all_insertion_left_positions": [a for a, _ in insertions], "insertion_positions": [p for a, _ in counted for p in (a, a + 1)],
        "insertion_coordinates": pair((a, a + 1) for a, _ in counted), "insertion_sizes": [n for _, n in counted], "insertion_n": sum(n for _, n in counted),
        "all_deletion_positions": [p for x in deletions for p in range(*x)], "all_deletion_coordinates": pair(deletions), "deletion_positions": [p for x in hit for p in range(*x)], "deletion_coordinates": pair(hit),
        "deletion_sizes": [b - a for a, b in hit], "deletion_n": sum(b - a for a, b in hit), "all_substitution_positions": [p for p, _ in subs], "substitution_positions": [p for p, _ in subs_in],
        "all_substitution_values": [x for _, x in subs], "substitution_values": [x for _, x in subs_in], "substitution_n": len(subs_in), "ref_positions": positions,
        "irregular_ends": bool(read) and (read[0] != ref[0] or read[0] == "-" or read[-1] != ref[-1] or read[-1] == "-"), "insertions_outside_window": len(insertions) - len(counted),
        "deletions_outside_window": len(deletions) - len(hit), "substitutions_outside_window": len(subs) - len(subs_in), "total_mods": total, "mods_in_window": inside, "mods_outside_window": total - inside,
    }


COLUMN = st.sampled_from([x + y for x in "ACGTN-" for y in "ACGT-" if x + y != "--"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(COLUMN, max_size=14), st.booleans()), max_size=6), st.sets(st.integers(0, 12), max_size=5), st.booleans())
def test_batches_of_edits_same_as_walking_along(pairs, window, either_flank):
    rows = [("".join(c[0] for c in p), "".join(c[1] for c in p), "w" if in_w else "none") for p, in_w in pairs]
    column = lambda k: pa.array(["x" * 3, *[r[k] for r in rows]], pa.string())[1:]
    got = edits_of(column(0), column(1), column(2), Windows({"none": [], "w": sorted(window)}), either_flank).to_pylist()
    assert got == [plain_edits(a, b, window if w == "w" else set(), either_flank) for a, b, w in rows]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=90), min_size=1, max_size=4), st.text("ACGT", max_size=150))
def test_common_length_in_bits(reads, ref):
    assert common_length(reads, ref).tolist() == [plain_common(r, ref) for r in reads]


def test_best_alignments_same_as_aligning_to_all(spark):
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("ACGT"), n))
    base = [letters(40), letters(48), letters(70)]
    refs = [{"name": f"r{k}", "seq": s, "incentive": [0] * 20 + [1] + [0] * (len(s) - 20), "min_score": m, "fw_seeds": [s[5:15]], "rc_seeds": [rc(s[5:15])]} for k, (s, m) in enumerate([(base[0], 60), (base[1], 60), (base[0][:-1] + "A", 60), (base[2], 90), (base[0], 60)])]
    reads = []
    for k in range(150):
        s = list(base[k % 3])
        for _ in range(k % 6):
            p = int(rng.integers(len(s)))
            s[p : p + 1] = [["A"], [], ["G", "T"]][int(rng.integers(3))]
        reads.append("".join(s) if k % 2 else rc("".join(s)))
    df = spark.createDataFrame([(k, s) for k, s in enumerate([*reads, "", "ACGT", None, letters(200)])], "id int, seq string")
    names = ["id", "seq", *ALIGNED.names, "n_best", "nth"]
    every = aligned_reads(df, refs)
    want = {tuple(r[c] for c in names) for r in best_references(every.select("id", "seq", F.explode("aligned").alias("x")).select("id", "seq", "x.*"), ["id", "seq"]).collect()}
    got = [tuple(r[c] for c in names) for r in best_alignments(df, refs).collect()]
    assert set(got) == want and len(got) == len(want) and any(x[-2] > 1 for x in want)
