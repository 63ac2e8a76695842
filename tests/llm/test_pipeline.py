"""The pipeline against its stages done plainly, and each stage's effect."""

import collections

import numpy as np

import corpus_pipeline


def test_stages(spark, docs_of, tmp_path):
    rng = np.random.default_rng(8)
    body = lambda k: "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 5000, 12)) for _ in range(10))
    texts = {k: body(k) for k in range(80)}
    for k in range(0, 80, 3):
        texts[k] += "\nThis line is on every page of every site"
    texts[5] += " write to someone@mail.example.com"
    texts[100], texts[101] = texts[1], texts[3].replace("w1", "w2", 1)
    texts[102], texts[103] = "too short", "again and again and again " * 40
    docs = docs_of(list(texts.items())).drop("n_words")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema if name != "packing" else None)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "packing" or docs.columns == names
    kept = set(range(80)) | {100, 101}
    assert set(seen["quality_rules"]) == kept == set(seen["line_dedup"])
    assert all("every page" not in r.text and r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    assert set(seen["near_copies"]) == set(range(80)) == set(seen["personal_data"])
    assert all((r.text == seen["near_copies"][k].text) == (k != 5) for k, r in seen["personal_data"].items()) and "someone@" not in seen["personal_data"][5].text
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(r.doc_id for r in ran.collect()) == collections.Counter(r.doc_id for r in docs.collect())


def _plain(rows):
    """run() by plain loops: (doc_id, text, source) -> texts by id, for documents without personal data and with too few labels to certify a cutoff."""
    import xxhash

    def passes(t):
        w = (t or "").split()
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        return len(w) >= 20 and 100 * len(inside) <= 30 * len(w)

    rows = [r for r in rows if passes(r[1])]
    sites = collections.defaultdict(set)
    for _, t, s in rows:
        for line in t.split("\n"):
            if len(line.strip(" ")) >= 10:
                sites[line.strip(" ")].add(s)
    cleaned = []
    for i, t, _ in rows:
        lines = t.split("\n")
        gone = [len(sites.get(x.strip(" "), ())) >= 12 for x in lines]
        chars = [len(x.strip(" ")) for x in lines]
        over = sum(n for n, g in zip(chars, gone, strict=True) if g) > 0.5 * sum(chars)
        cleaned.append((i, t if over else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))

    def bits(t):
        w = t.lower().split()
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 5]), 42) for k in range(len(w) - 4)], np.uint64)
        odd = np.random.default_rng(42).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        words = [h] + [(x := (h ^ (h >> np.uint64(31))) * o) ^ (x >> np.uint64(32)) for o in odd[1:]]
        return np.concatenate([2 * np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) > len(h) for x in words])

    prints = np.array([bits(t) for _, t in cleaned])
    group = list(range(len(cleaned)))
    for a in range(len(cleaned)):
        for b in np.flatnonzero((prints[a] != prints).sum(axis=1) <= 96).tolist():
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    first = {}
    for (i, t), g in zip(cleaned, group, strict=True):
        first[g] = min(first.get(g, (i, t)), (i, t))
    return dict(first.values())


def test_run_is_what_plain_loops_give(spark, docs_of, tmp_path):
    from ampliq.llm.packing import VOCABULARY
    from ampliq.llm.shared import load_tokenizer, tokenizer_path

    rng = np.random.default_rng(18)
    body = lambda: "\n".join(" ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{chr(97 + x // 676)}" for x in rng.integers(0, 5000, 12)) for _ in range(int(rng.integers(3, 20))))
    rows = [(k, body()) for k in range(70)]
    rows = [(i, t + ("\nthis line is on every page of every site" if i % 3 == 0 else "")) for i, t in rows]
    rows += [(200 + k, rows[k][1]) for k in range(8)]
    rows += [(300 + k, " ".join("changed" if rng.random() < 0.02 else w for w in rows[k][1].split(" "))) for k in range(10, 30)]
    rows += [(400, None), (401, ""), (402, "too short"), (403, "again and again and again " * 40), (5, rows[5][1]), (404, "this line is on every page of every site\n" * 2 + "one two three four five six seven eight nine ten eleven twelve")]
    docs = docs_of(rows).withColumnRenamed("n_words", "fp")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = _plain([(r.doc_id, r.text, r.source) for r in docs.collect()])
    library = load_tokenizer(tokenizer_path(VOCABULARY))
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()} and 60 < len(want) < 100


def test_run_on_empty_tables(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_awkward_rows(spark, docs_of, tmp_path):
    from .conftest import AWKWARD

    rows = [*AWKWARD, *((i, " ".join(f"{c}{k * k % 997}" for k in range(60))) for i, c in ((None, "a"), (None, "a"), (11, "b"), (11, "c"), (11, "c"), (12, "c")))]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).where("piece = 0").collect())
    assert got == {None: 1, 11: 2}
