"""Filter audit, ball k-means and language identification against plain versions."""

import hashlib
import os
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliq.llm import ball_kmeans as bk
from ampliq.llm import filter_audit as fa
from ampliq.llm import language_id as li

from .conftest import AWKWARD

SF = "/root/testdata/sf0.01"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_masks(rows):
    """(part, mask) of (doc_id, text, lang) rows by the definitions."""
    out = []
    for i, text, lang in rows:
        t = text or ""
        words = WORDS.findall(t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t))]
        fails.append(any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in rows))
        out.append((lang or "", fails))
    return out


def plain_audit(rows, labels):
    masks, found = plain_masks(rows), {}
    good, toxic = ({i for i, q, x in labels if i is not None and (q if k == 0 else x) == 1} for k in (0, 1))
    for part in {p for p, _ in masks}:
        docs = [(f, r[0]) for (p, f), r in zip(masks, rows, strict=True) if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [d for d in left if d[0][k]]
                left = [d for d in left if not d[0][k]]
                shapley[letter] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[k] for f, _ in docs) - len(gone), sum(f[k] and sum(f) == 1 for f, _ in docs), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)
                ]
        for (p, order, step), v in found.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def audit_rows():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(i, t, "en") for i, t in AWKWARD]
    for k in range(90):
        n = int(rng.choice([5, 150, 230, 400]))
        text = " ".join(rng.choice(words[: int(rng.choice([40, 400]))], n))
        text = text.upper() if k % 7 == 0 else text
        rows.append((100 + k, text + (" 5% of it" if k % 5 == 0 else ""), [None, "", "en", "de"][k % 4]))
    rows += [(300 + k, rows[20][1], "de") for k in range(15)] + [(11, rows[25][1], "en"), (None, rows[25][1], None), (None, rows[25][1], "fr"), (301, rows[20][1], "de"), (301, rows[20][1], "en")]
    return rows


def test_audit_is_what_applying_the_filters_gives(spark):
    rows = audit_rows()
    labels = [(i, q, x) for i, q, x in [(1, 1, 0), (1, 0, 1), (100, 1, None), (101, None, 1), (300, 1, 1), (5, 0, 0), (999, 1, 1), (None, 1, 1)]] + [(k, k % 2, (k // 2) % 2) for k in range(102, 190)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, mask string, good int")
    marks = spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, part int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in fa.filter_audit(docs.repartition(5), marks).collect()}
    assert got == plain_audit(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(docs, marks).count() == 0
    one = fa.filter_audit(spark.createDataFrame([(1, None, None)], docs.schema), marks)
    assert one.count() == 600 and one.agg(F.sum("shapley")).first()[0] == 120 * 120 and {r["part"] for r in one.collect()} == {""}


def test_parity_sums_invert_exactly():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 1 << 40, (3, 32))
    assert (fa.mask_counts(cells @ fa._signs()) == cells).all()
    with pytest.raises(ArithmeticError):
        fa.mask_counts(np.eye(32, dtype=np.int64)[:1])


def plain_kmeans(rows, k=8, rounds=10, dimensions=64):
    kept = [(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        centroids = [tuple(sum(x) // len(own) for x in zip(*own, strict=True)) if (own := [v for (_, v), j in zip(kept, of, strict=True) if j == c]) else centroids[c] for c in range(len(centroids))]
    last = [near(v) for _, v in kept]
    inertia = [sum(d for d, j in last if j == c) for c in range(len(centroids))]
    return sorted(((i is not None, i or 0), j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))


def clusters(spark, rows, dimensions=64, **more):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, own string").repartition(4)
    return sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in bk.clustered(df, dimensions=dimensions, **more).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_clusters_are_those_of_comparing_everything(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 64))
    rows = [(k, (centres[k % 5] + 0.3 * rng.normal(size=64)).tolist()) for k in range(180)]
    rows += [(1000 + k, rows[3][1]) for k in range(40)]  # copies
    rows += [(7, rows[8][1]), (7, rows[8][1]), (None, rows[9][1]), (2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] * 64), (2004, [float("inf")] + [0.0] * 63), (2005, [0.0] * 64)]
    assert clusters(spark, rows) == plain_kmeans(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(x) / 1024, float(y) / 1024]) for k, (x, y) in enumerate((x, y) for x in range(-4, 5) for y in range(-4, 5))]
    assert clusters(spark, rows, dimensions=2) == plain_kmeans(rows, dimensions=2)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [0.25, 0.0])], [(None, [0.25, 0.0])]])
def test_few_vectors(spark, rows):
    want = plain_kmeans(rows, dimensions=2) if any(i is not None for i, _ in rows) else []
    assert clusters(spark, rows, dimensions=2) == want


def test_components_whose_distances_fit_no_long_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        clusters(spark, [(1, [1e30, 0.0])], dimensions=2)


def test_stable_core_is_not_compared():
    rng = np.random.default_rng(3)
    centroids = (1000 * rng.normal(size=(8, 64))).astype(np.int64)
    own = rng.integers(0, 8, 4000)
    x = centroids[own] + (60 * rng.normal(size=(4000, 64))).astype(np.int64)
    near, least, computed = bk.move(x, own, centroids, bk._apart(centroids), [None] * 8)
    every = ((x[:, None] - centroids) ** 2).sum(2)
    assert (near == every.argmin(1)).all() and (least == every.min(1)).all() and computed == len(x)
    near, least, computed = bk.move(x, rng.integers(0, 8, 4000), centroids, bk._apart(centroids), [None] * 8)
    assert (near == every.argmin(1)).all() and (least == every.min(1)).all() and computed > len(x)


def folded(text):
    kept = "".join(c.lower() if c.isalpha() else " " for c in text)
    return " " + " ".join(kept.split()) + " "


def test_ngrams_are_the_distinct_ones_of_the_folded_text(monkeypatch):
    fold = li.folding()
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    for size in (li.SLICE, 5):
        monkeypatch.setattr(li, "SLICE", size)
        for text in ["Straße, 42 Äpfel!  naïve", "日本語 text", "a", "x" * 40, "éÉ \n\t z"]:
            f = folded(text)
            want = {code(f[k : k + n]) for n in (1, 2, 3) for k in range(len(f) - n + 1)} - {code(" ")}
            assert li.ngrams(text.encode(), fold).tolist() == sorted(want)
        assert not len(li.ngrams(b"12 -- 3", fold)) and not len(li.ngrams(b"", fold))


def test_decisions_are_sums_of_kernels():
    fold, rng = li.folding(), np.random.default_rng(4)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    texts = [make("abcdefgh") for _ in range(40)] + [make("efghijkl") for _ in range(40)]
    grams = [li.ngrams(t.encode(), fold) for t in texts]
    names, vocabulary, weights = li.fit(grams, ["a"] * 40 + ["b"] * 40, landmarks=20)
    assert names == ["a", "b"]
    sets = [set(g.tolist()) for g in grams]
    marks = [sets[i] for i in range(10)] + [sets[40 + i] for i in range(10)]
    k = li.kernel(grams, [np.array(sorted(m), np.uint64) for m in marks], vocabulary)
    assert np.allclose(k, [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in marks] for a in sets])
    d = li.decisions(grams, vocabulary, weights)
    assert (d.argmax(1) == [0] * 40 + [1] * 40).all()
    # a decision lies in the span of the landmarks' kernels and the constant
    basis = np.concatenate([k, np.ones((len(k), 1))], axis=1)
    assert np.allclose(basis @ np.linalg.lstsq(basis, d, rcond=None)[0], d, atol=1e-6)


def test_awkward_texts_of_unknown_language(spark):
    rows = [(i, t, lang) for (i, t), lang in zip(AWKWARD, [None, "en"] * 6, strict=False)] + [(50, "12 34 !", "en"), (None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = li.identified(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    answers = {(r["doc_id"], r["held_out"]) for r in got}
    assert answers == {(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows}
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "und") for r in got)
    silent = {i for i, t, _ in rows if not any(c.isalpha() for c in t or "")} - {None}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} - {None} == silent
    empty = li.identified(docs.limit(0))
    assert empty.count() == 0 and li.identified(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und' or score <> 0").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_held_out_languages_are_found_without_their_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in li.op13_string_kernel_language(spark, SF).collect()}
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2] and set(got) == set(langs)
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.98 * len(held)
    # neither labels of held-out documents nor ids and sources go into an answer
    other = docs.withColumn("lang", F.when(li.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert {r["doc_id"]: r["lang_pred"] for r in li.identified(other).collect()} == {i: r["lang_pred"] for i, r in got.items()}
