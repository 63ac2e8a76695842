"""Guides with mismatches against every place tried one by one; how a guide differs from its site; windows on another sequence."""

import unicodedata

import numpy as np
import pytest

from ampliq.functions import sequences
from ampliq.operators import guide_search as G
from ampliq.operators import references as R

REF = "ACGTTGCAATGCCATTGGACCTGATCGATCCGTAAGCTTAGGCATCCATGCAATGG"
GUIDE = REF[20:40]


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("most", [0, 2, 5])
def test_all_sites_are_found_once(spark, monkeypatch, most, shuffled):
    if shuffled:
        monkeypatch.setattr(G, "BROADCAST_PIECES", 0)
    rng = np.random.default_rng(most)
    refs = [(f"r{k}", "".join(rng.choice(list("ACGT"), n, p=[0.4, 0.2, 0.2, 0.2]))) for k, n in enumerate((60, 90, 7, 0))] + [("same", "A" * 40), ("none", None), ("lower", REF.lower())]
    guides = [("a", refs[0][1][5:15]), ("b", R.rc(refs[1][1][30:43])), ("c", "AAAAAAAAA"), ("c", "AAAAAAAAA"), ("d", "ACGTACGT"), ("short", "A" * most), ("null", None), ("e", GUIDE[:4] + "N" + GUIDE[5:])]
    want = []
    for name, guide in guides:
        for ref, seq in refs:
            if not guide or not seq or len(guide) <= most:
                continue
            seq = seq.upper()
            for strand, turn in (("+", lambda s: s), ("-", R.rc)):
                for at in range(len(seq) - len(guide) + 1):
                    site = turn(seq[at : at + len(guide)])
                    wrong = [i for i, (x, y) in enumerate(zip(site, guide, strict=True)) if x != y]
                    if len(wrong) <= most:
                        want.append((name, guide, ref, strand, at, site, len(wrong), wrong))
    found = G.sites(spark.createDataFrame(refs, "ref_name string, ref_seq string"), spark.createDataFrame(guides, "guide_name string, guide string"), most)
    assert sorted(map(tuple, found.collect())) == sorted(want) and want


def test_no_guides(spark):
    found = G.sites(spark.createDataFrame([("a", REF)], "ref_name string, ref_seq string"), spark.createDataFrame([], "guide_name string, guide string"))
    assert found.count() == 0


def test_mismatches_of_a_site():
    changed = GUIDE[:8] + ("A" if GUIDE[8] != "A" else "C") + GUIDE[9:]
    assert G.mismatches(GUIDE, GUIDE) == [] and G.mismatches(GUIDE, changed) == [8]
    place = G.best_place(changed, REF)
    assert (place["site"], place["start"], place["end"], place["mismatches"]) == (GUIDE, 20, 40, [8])


def test_mismatches_between_two_places():
    other = REF
    for seq, want in ((REF, []), (REF[:25] + ("A" if REF[25] != "A" else "C") + REF[26:], [5.0]), (REF[:26] + REF[28:], [5.5, 6.5]), (REF[:30] + "TT" + REF[30:], [10.0, 11.0])):
        to_seq, to_other = G.aligned_maps(seq, other, gap_extend=-2), G.aligned_maps(other, seq, gap_extend=-2)[0]
        found = G.span_mismatches(seq, other, 20, 40, to_seq, to_other)
        assert len(found) <= max(1, len(want)) + 1 and bool(found) == bool(want), (seq, found)
    assert G.span_mismatches("ACGT", "ACTT", 0, 4, ([0, 1, 2, 3], [0, 1, 2, 3]), [0, 1, 2, 3]) == [2.0]
    assert G.span_mismatches("ACT", "ACGT", 0, 4, ([0, 1, 1, 2], [0, 1, 2, 2]), [0, 1, 3]) == [1.5]
    assert G.span_mismatches("ACGGT", "ACGT", 0, 4, ([0, 1, 2, 4], [0, 1, 2, 4]), [0, 1, 2, 2, 3]) == [3.0]


def test_windows_on_another_sequence(spark):
    assert G.cloned_windows("2-4", [0, 1, 2, 3, 4, 5]) == [2, 3, 4]
    assert G.cloned_windows("2-4_6-7", [0, 1, 2, 5, 6, 7]) == [2, 4, 5]  # 3 and 4 are missing there
    assert G.cloned_windows("2-3", [0, 1, 2, 2, 2, 3, 4]) == [2, 3, 4, 5] and G.cloned_windows("8-9", [0, 1, 2]) == [] and G.cloned_windows(None, [0]) == []
    with pytest.raises(ValueError):
        G.cloned_windows("5", [0, 1])
    rows = [("a", REF, REF[:26] + REF[29:], "3-6_40-42"), ("b", None, REF, "1-2"), ("c", REF, REF, None), ("d", REF, REF, "0")]
    got = {r.name: r.window for r in G.with_cloned_windows(spark.createDataFrame(rows, "name string, source_seq string, target_seq string, coordinates string")).collect()}
    assert got == {"a": [3, 4, 5, 6, 37, 38, 39], "b": [], "c": [], "d": []}


def test_slugs_fold_like_unicode(spark):
    names = ["naïve ﬁle", "½ cup", "№5 ™", "Ⅷ", "𝐀bc", "plain name.txt", "日本", "㎏/㎡", "e\u0301"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "s string").coalesce(1).select(sequences.slug(sequences.F.col("s"))).collect()]
    plain = [unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in names]
    assert got == [sequences_like(p) for p in plain]


def sequences_like(s: str) -> str:
    out = "".join(c if c.isalnum() or c in "_.-" else "_" for c in s.strip())
    while "__" in out:
        out = out.replace("__", "_")
    return out
