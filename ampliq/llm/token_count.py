"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

A pre-token is a maximal run without white space as the vocabulary sees it (Unicode's: ``str.split`` parts at U+001C to U+001F as well). The vocabulary's normaliser turns white space into one space and
its splitter drops it, so no piece and no composed character crosses such a run, and special strings hold no white space: a
text's count is the sum over its runs. The library itself counts the pieces of each distinct run, so special strings, case and
composition are handled as it handles them.

Pass one counts runs over all texts (per-task counts, then one sum per run). Each distinct run goes through the library once and
the table is written. Pass two gives each document's run frequencies: runs among the ``head`` most frequent ones (at most
that many, so their broadcast has a fixed bound) are added up in place, the rest go through a join on the run. Sums per document follow.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows, and rows that share a doc_id, are counted one by one: a row number
within the task tells them apart, so each input row gives one output row.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import load_tokenizer, steps, table, tokenizer_path, written

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Runs whose counts are broadcast; at about 60 bytes each they take 16 MB.
HEAD = 262_144
#: Runs longer than this are never among the broadcast ones.
HEAD_CHARS = 64
#: Distinct runs that a task holds before it hands its counts on.
FLUSH = 200_000
RUNS = re.compile("[^\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: What ``str.split`` takes for white space and the vocabulary does not.
CONTROLS = re.compile("[\x1c-\x1f]")


def _runs(text: str) -> list[str]:
    """The runs of ``RUNS``: by ``str.split``, which is faster, where the two agree."""
    return RUNS.findall(text) if CONTROLS.search(text) else text.split()


def _run_counts(batches):
    schema = pa.schema([("run", pa.string()), ("n", pa.int64())])

    def out(held):
        return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema)

    held: Counter = Counter()
    for _, texts in steps(batches):
        for t in texts:
            held.update(_runs(t.decode()))
        if len(held) >= FLUSH:
            yield out(held)
            held = Counter()
    if held:
        yield out(held)


def count_pieces(runs: DataFrame, path: str) -> DataFrame:
    """(run, ...) with ``pieces``: the library's count for each run, in batches."""

    def f(batches):
        tokenizer = load_tokenizer(path)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                found = [len(x) for x in tokenizer.encode_batch(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.record_batch([*part.columns, pa.array(found, pa.int64())], [*part.schema.names, "pieces"])

    return runs.mapInArrow(f, f"{', '.join(f'`{c}` {t}' for c, t in runs.dtypes)}, pieces long")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    runs = docs.select("text").mapInArrow(_run_counts, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))
    pieces = written(count_pieces(runs, path), spark, "pieces")
    # which frequencies the frequent runs have, from counts by steps of a logarithm (some two thousand rows at most)
    scale = pieces.where(F.length("run") <= HEAD_CHARS).withColumn("step", F.floor(32 * F.log2("n")))
    least, taken = None, 0
    for r in scale.groupBy("step").agg(F.count(F.lit(1)).alias("runs")).orderBy(F.desc("step")).collect():
        taken += r["runs"]
        if taken > head:
            break
        least = r["step"]
    frequent = scale.where(F.lit(False) if least is None else F.col("step") >= least).select("run", "pieces").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(frequent["run"].tolist(), frequent["pieces"].tolist(), strict=True)))

    def frequencies(batches):
        from pyspark import TaskContext

        get = known.value.get
        at = TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "n_bytes", "run", "n", "here"]
        for part, texts in steps(batches):
            ids = part.column(0).to_pylist()
            rows, keys, sizes, tail, n, here = [], [], [], [], [], []
            for doc_id, t in zip(ids, texts, strict=True):
                counts, total, at = Counter(_runs(t.decode())), 0, at + 1
                for run, k in counts.items():
                    found = get(run)
                    if found is None:
                        rows.append(at), keys.append(doc_id), sizes.append(0), tail.append(run), n.append(k), here.append(0)
                    else:
                        total += k * found
                rows.append(at), keys.append(doc_id), sizes.append(len(t)), tail.append(None), n.append(0), here.append(total)
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tail, pa.string()), pa.array(n, pa.int64()), pa.array(here, pa.int64())], names)

    split = docs.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, run string, n long, here long")
    return _summed(split, pieces, limit)


def _summed(split: DataFrame, pieces: DataFrame, limit: int) -> DataFrame:
    """Sums per row. Rows of the tail carry a run; each row's own line carries its bytes and what its frequent runs add up to."""
    salted = split.withColumn("run", F.coalesce("run", F.concat(F.lit(" "), F.col("row").cast("string"))))
    joined = salted.join(pieces.select("run", "pieces"), "run", "left")
    added = joined.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("here") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    return added.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
