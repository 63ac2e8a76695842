import numpy as np
import pytest

from ampliq.operators import references as R

REF = "ACGTTGCAATGCCATTGGACCTGATCGATCCGTAAGCTTAGGCATCCATGCAATGG"
GUIDE = REF[20:40]


def test_cut_and_window_of_a_forward_guide():
    (g,) = R.place_guides(REF, [GUIDE])
    assert (g.start, g.end, g.cut, g.window) == (20, 39, 36, [36, 37])


def test_cut_of_a_reverse_guide():
    (g,) = R.place_guides(REF, [R.rc(GUIDE)])
    assert (g.start, g.end, g.cut) == (20, 39, 22)


def test_every_match_counts_and_gets_its_own_name():
    found = R.place_guides("AAAACCCCAAAACCCC", ["AACC"], plot=2)
    assert [g.start for g in found] == [2, 10] and [g.name for g in found] == ["AACC_2", "AACC_10"]


def test_windows():
    guides = R.place_guides(REF, [GUIDE])
    assert R.quantification_window(REF, guides) == [36, 37]
    assert R.quantification_window(REF, guides, "3-5_10-10") == [3, 4, 5, 10]
    assert R.quantification_window(REF, [], skip_left=2) == list(range(2, len(REF)))
    with pytest.raises(ValueError):
        R.quantification_window(REF, guides, "3-5", skip_left=5)
    with pytest.raises(ValueError):
        R.parse_windows("5", 10)
    with pytest.raises(ValueError):
        R.parse_windows("5-10", 10)


def test_options_spans_and_seeds():
    assert R.option_list("1,2", 3, int) == [1, 2, 1] and R.spans([1, 2, 3, 7, 9, 10]) == [(1, 3), (7, 7), (9, 10)]
    fw, rv = R.seeds(REF, 5, 10, 5, 5)
    assert all(s in REF and s not in R.rc(REF) for s in fw) and rv == [R.rc(s) for s in fw]


def test_exons_and_splice_sites():
    inside, beside = R.exon_positions(REF, [REF[10:20]])
    assert inside == list(range(10, 20)) and beside == [8, 9, 20, 21]


def test_build():
    r = R.build("a", REF.lower(), [GUIDE], skip_left=2, skip_right=2)
    assert r.window == [36, 37] and np.flatnonzero(r.incentive).tolist() == [37]
    with pytest.raises(ValueError):
        R.build("a", "ACGU", [])


def test_cloned_positions():
    a = R.build("a", REF, [GUIDE], skip_left=0, skip_right=0)
    b = R.build("b", REF[:10] + REF[13:], [], skip_left=0, skip_right=0)
    assert R.cloned([20, 30], a, b) == [17, 27]
    (g,) = R.cloned_guides(a, b)
    assert g.cut == 33 and g.window == [33, 34]


def test_flexible_guide():
    near = GUIDE[:8] + ("A" if GUIDE[8] != "A" else "C") + GUIDE[9:]
    assert R.flexible_guide(REF, near) == (GUIDE, [8.0]) and R.flexible_guide(REF, "A" * 20) is None


def test_prime_editing():
    want = REF[:36] + "A" + REF[37:] if REF[36] != "A" else REF[:36] + "C" + REF[37:]
    assert R.prime_edited(REF, GUIDE, R.rc(want[30:46])) == want


def test_prime_editing_guides():
    first = REF
    edited = first[:41] + "TT" + first[41:]
    extension, nicking = R.rc(edited[34:50]), R.rc(first)[5:25]
    found = {name: (seq, center, size) for name, seq, center, size in R.prime_editing_guides(edited, first, edited, extension, GUIDE, nicking)}
    assert found["PE Extension"] == (edited[34:50], 0, 5) and found["PE spacer sgRNA"] == (GUIDE, -3, 1)
    on_first = {name: seq for name, seq, _, _ in R.prime_editing_guides(first, first, edited, extension, GUIDE, nicking)}
    assert on_first == {"PE Extension": first[34:48], "PE spacer sgRNA": GUIDE, "PE nicking sgRNA": nicking}
    with pytest.raises(ValueError):
        R.prime_editing_guides(first, first, edited, extension, "A" * 20)


def test_annotations_go_to_another_reference():
    a = R.build("a", REF, [GUIDE], coding=[REF[10:22]], skip_left=0, skip_right=0)
    b = R.build("b", REF[:14] + REF[16:], [], skip_left=0, skip_right=0)
    c = R.with_annotations_of(a, b)
    assert c.guides[0].cut == 34 and c.window == [34, 35] and np.flatnonzero(c.incentive).tolist() == [35]
    assert (len(c.exons), c.exon_change) == (10, -2) and R.with_annotations_of(a, R.build("d", "ACGT" * 10, [], skip_left=0, skip_right=0)).exons == []
