"""How filters interact: what each of five filters removes in every order in which they can be applied, from one pass over the texts.

A document fails a set of the filters, its mask of five bits. Per part and label the documents are summed 32 times, each time with the sign of a parity of
the mask (a Walsh-Hadamard transform); applied once more and divided by 32 the transform gives the exact number of documents with each mask, and from
these 32 numbers come all 120 orders, and the Shapley numbers in closed form: of the orders, a filter comes first among the s failing ones in 120 / s.

Four filters read a document's own text. The fifth asks whether a smaller doc_id has the same text: texts are told apart by a 128-bit hash, rows
are summed by (text, part, labels) before they meet, and of each text only the rows with the smallest id pass, so no group of copies is gathered.

Null and empty texts have no words: they fail A, and are equal to each other. A null id is no smaller than any other, nor is any smaller than it: such a row never fails E
and has no labels. Rows that repeat an id and text are documents of their own, none of them a later copy of the other. A null part is the empty string. A document
has a label if any of its rows in the label table says so; labels of unknown documents have no effect. An empty table has no parts and gives no rows. Columns
of other names are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import SPACES, steps, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
MARKS = b"#$%&*|"
ORDERS = list(permutations(range(len(FILTERS))))

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def own_mask(text: bytes) -> int:
    """The bits of the filters that a text (UTF-8) fails by itself."""
    words = text.split()
    short, plain = len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    capitals, points = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _CONTINUED))
    return short | plain << 1 | (100 * capitals > MAX_CAPITALS_PERCENT * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def own_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, same, mask): a row per document with the hash of its text and the filters it fails by itself."""

    def f(batches):
        for rows, texts in steps(batches):
            same = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.record_batch([rows.column(0), rows.column(1), same, pa.array([own_mask(t) for t in texts], pa.int32())], ["doc_id", "part", "same", "mask"])

    return docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text").mapInArrow(f, "doc_id long, part string, same binary, mask int")


def labelled(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``masks`` with good and toxic (0 or 1), its equal rows counted in n."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    # rows without an id have no labels: the hash of their text spreads them
    spread = masks.withColumn("apart", F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(0))
    met = spread.join(marks.withColumn("apart", F.lit(0).cast("long")), ["doc_id", "apart"], "left")
    return met.groupBy("doc_id", "apart", "same", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def with_copies(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n) with the bit of E set for rows whose text a smaller id has."""
    numbered = F.col("doc_id").isNotNull()
    cells = rows.groupBy("same", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(numbered, F.struct("doc_id", "n"))).alias("least"), F.coalesce(F.sum(F.when(~numbered, F.col("n"))), F.lit(0)).alias("unnumbered")
    )
    first = F.min("least.doc_id").over(W.partitionBy("same"))
    cells = cells.withColumn("first", F.coalesce(F.when(F.col("least.doc_id") == first, F.col("least.n")), F.lit(0)) + F.col("unnumbered"))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(MASKS // 2).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    return cells.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.*")


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): for each of the 32 sets of filters, the documents that fail an even number of them less the others."""

    def signed(k: int) -> Column:
        return F.sum((1 - 2 * F.bit_count(F.col("mask").bitwiseAND(k)).bitwiseAND(1)).cast("long") * F.col("n"))

    found = rows.groupBy("part", "good", "toxic").agg(*[signed(k).alias(f"s{k}") for k in range(MASKS)])
    return found.select("part", "good", "toxic", F.array(*[f"s{k}" for k in range(MASKS)]).alias("sums"))


def _signs() -> np.ndarray:
    k = np.arange(MASKS)
    return 1 - 2 * (np.bitwise_count(k[:, None] & k) & 1).astype(np.int64)


def mask_counts(sums: np.ndarray) -> np.ndarray:
    """Documents with each mask, from their parity sums (any number of rows of 32)."""
    cells, rest = np.divmod(sums @ _signs(), MASKS)
    if rest.any() or (cells < 0).any():
        raise ArithmeticError("parity sums of no set of documents")
    return cells


def audit(cells: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Documents, good ones and toxic ones by mask -> each count for every order and step, 5 * 120 numbers."""
    masks, n = np.arange(MASKS), len(FILTERS)
    earlier, own = [], []
    for order in ORDERS:
        for k, f in enumerate(order):
            earlier.append(sum(1 << x for x in order[:k]))
            own.append(1 << f)
    earlier, own = np.array(earlier), np.array(own)
    gone, fails = (masks[:, None] & earlier) != 0, (masks[:, None] & own) != 0
    here = fails & ~gone
    first = np.array([len(ORDERS) // max(1, int(m).bit_count()) for m in masks])
    counted = {"kept": ~gone & ~fails, "removed": here, "redundant": fails & gone, "unique_fails": masks[:, None] == own, "shapley": fails * first[:, None]}
    found = {k: cells @ v.astype(np.int64) for k, v in counted.items()}
    assert n * len(ORDERS) == len(own)
    return found | {"good_lost": good @ here.astype(np.int64), "toxic_lost": toxic @ here.astype(np.int64)}


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts: 600 rows for each value of ``part``."""
    sums = parity_sums(with_copies(labelled(own_masks(docs, part), labels)))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "sums")).alias("cells"))  # four at most
    names, at = ["".join(FILTERS[f] for f in order) for order in ORDERS for _ in FILTERS], [k + 1 for _ in ORDERS for k in range(len(FILTERS))]

    def f(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cells = mask_counts(np.array([x["sums"] for x in row["cells"]], np.int64))
                good, toxic = (np.array([x[c] for x in row["cells"]], np.int64) @ cells for c in ("good", "toxic"))
                found = audit(cells.sum(0), good, toxic)
                yield pa.record_batch([pa.array([row["part"]] * len(at)), pa.array(names), pa.array(at, pa.int32()), *[pa.array(found[c], pa.int64()) for c in _COUNTS]], ["part", "filter_order", "step", *_COUNTS])

    return parts.mapInArrow(f, "part string, filter_order string, step int" + "".join(f", {c} long" for c in _COUNTS))


def op11_walsh_hadamard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SPACE_CLASS = "[" + "".join(f"\\x{ord(c):02X}" for c in SPACES) + "]+"

OP11_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    list_filter(string_split_regex(coalesce(text, ''), '{_SPACE_CLASS}'), lambda x: x <> '') AS words FROM documents),
firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (
  SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INTEGER)) AS good, max(CAST(coalesce(toxic, 0) = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(words) < {MIN_WORDS} AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(t.text) AS INTEGER)
    + 8 * CAST(regexp_matches(t.text, '[{MARKS.decode()}]') AS INTEGER) + 16 * CAST(coalesce(t.doc_id > first, FALSE) AS INTEGER) AS mask
  FROM texts t JOIN firsts f ON t.text = f.text LEFT JOIN marks m ON t.doc_id = m.doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
taken AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)),
counts AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN mask & CAST(earlier + own AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & CAST(earlier AS INTEGER) = 0 AND mask & own > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & CAST(earlier AS INTEGER) > 0 AND mask & own > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & CAST(earlier AS INTEGER) = 0 AND mask & own > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & CAST(earlier AS INTEGER) = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, taken GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
"""
