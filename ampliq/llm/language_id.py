"""Which language a text is in, by string kernels: blended-spectrum presence kernels, Nyström landmarks and kernel ridge regression.

Letters are lower-cased and everything else is a space, runs of which count once. The kernel of two texts is the number of distinct n-grams of one to
``SPECTRUM`` characters that both hold, over the root of the product of their own numbers. Landmarks are some of the training texts; their kernel matrix, inverted by its
eigenvalues, gives the Nyström features, on which one ridge regression per language separates it from the rest. The decision of a language is a weighted sum of
kernels with landmarks, and each kernel is an inner product of presence vectors, so the landmarks' presence matrix is multiplied with the weights once:
a batch of texts is then scored by its presence matrix (sparse) times the matrix of n-grams by languages.

The model is fitted on at most ``SAMPLE`` distinct training texts, dealt evenly over the languages and chosen by a hash of the text (of equal texts of a language, one). Only their
n-gram codes reach the driver. Training documents have a language, a text with a letter, and an id with crc32 of its decimal text not 2 modulo 4; the documents with 2 are held out.
Every text is read whole, in slices whose distinct n-grams are put together, so that a giant text needs memory for its distinct n-grams alone.

A null or empty text, and any without a letter, is ``und`` with score 0, as is everything where no language can be learned. A null id is neither held out nor learned from. A
null language is not learned. Repeated rows get the same answer; of equal decisions the first language in order wins. The score is the decision (-1 to 1 for what was learned) brought
to 0 to 1. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import steps, table, written

#: Longest n-gram, in characters. Three code points of 21 bits make one code of 63 bits, so that codes are exact.
SPECTRUM = 3
#: Training texts at most, and how many of these are landmarks.
SAMPLE = 3072
LANDMARKS = 384
#: Ridge penalty; eigenvalues of the landmarks' kernel below this share of the largest are left out.
PENALTY = 1e-3
SMALLEST = 1e-6
#: Characters of a text whose n-grams are made at a time.
SLICE = 1 << 20
#: Sampled keys are looked for among so many times as many rows as are wanted; more than enough but for a vanishing chance, in which fewer are learned from.
MARGIN = 4
#: Rows of the table of languages and of sampled texts that may be broadcast.
BROADCAST_ROWS = 10_000
UNKNOWN = "und"

_SPACE = 0x20
_BITS = 21


def folding() -> np.ndarray:
    """For every code point the lower-case letter it counts as, or a space."""
    out = np.full(0x110000, _SPACE, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: bytes, fold: np.ndarray, spectrum: int = SPECTRUM) -> np.ndarray:
    """The codes of the distinct n-grams of a text (UTF-8) in ascending order; none if it has no letter."""
    points = fold[np.frombuffer(text.decode().encode("utf-32-le"), "<u4")]
    points = np.concatenate([[_SPACE], points, [_SPACE]]).astype(np.uint64)  # words at either end look like those within
    points = points[np.concatenate([[True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)])]
    if len(points) < 2:
        return np.empty(0, np.uint64)
    found = []
    for start in range(0, len(points), SLICE):
        part = points[start : start + SLICE + spectrum - 1]
        codes = part
        each = [codes[codes != _SPACE]]
        for n in range(2, spectrum + 1):
            codes = (codes[:-1] << np.uint64(_BITS)) | part[n - 1 :]
            each.append(codes)
        found.append(np.unique(np.concatenate(each)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def crc_part() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))


def held_out() -> Column:
    return F.coalesce(crc_part() == 2, F.lit(False))


def sampled(docs: DataFrame, fold, sample: int = SAMPLE) -> DataFrame:
    """(lang, grams): the n-grams of at most ``sample`` distinct training texts, as evenly over the languages as these allow."""
    spark = docs.sparkSession
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_part() != 2) & F.col("text").rlike(r"\p{L}"))
    rows = train.select("doc_id", "lang", F.xxhash64("text").alias("h"))
    texts = written(rows.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")), spark, "texts")
    counts = written(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), spark, "languages")
    languages = counts.count()
    quota = max(1, sample // max(1, languages))
    counts = F.broadcast(counts) if languages <= BROADCAST_ROWS else counts
    near = texts.join(counts, "lang").where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) * F.col("n") < MARGIN * quota + 64)
    ranked = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("k") <= quota)
    chosen = ranked.orderBy("k", "lang").limit(sample).select("doc_id", "lang", "h")
    chosen = written(chosen, spark, "chosen")  # at most ``sample`` rows

    def f(batches):
        for part, bodies in steps(batches):
            yield pa.record_batch([part.column(0), part.column(1), pa.array([ngrams(t, fold.value).tobytes() for t in bodies], pa.binary())], ["lang", "h", "grams"])

    met = train.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "lang", "h"]).select("lang", "h", "text")
    return met.mapInArrow(f, "lang string, h long, grams binary").dropDuplicates(["lang", "h"])


def presence(grams: list[np.ndarray], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each n-gram of the texts that the vocabulary (ascending) holds."""
    n = np.array([len(g) for g in grams])
    every, row = np.concatenate([*grams, np.empty(0, np.uint64)]), np.repeat(np.arange(len(grams)), n)
    if not len(vocabulary):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(vocabulary, every), len(vocabulary) - 1)
    known = vocabulary[at] == every
    return row[known], at[known]


def kernel(grams: list[np.ndarray], landmarks: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    """Kernels of texts with landmarks, whose n-grams make up the vocabulary, by products of dense presence matrices of 256 texts."""
    marks = np.zeros((len(landmarks), len(vocabulary)), np.float32)
    marks[presence(landmarks, vocabulary)] = 1
    out = []
    for start in range(0, len(grams), 256):
        part = grams[start : start + 256]
        dense = np.zeros((len(part), len(vocabulary)), np.float32)
        dense[presence(part, vocabulary)] = 1
        out.append((dense @ marks.T).astype(np.float64))  # whole numbers below 2^24: exact
    own = np.array([len(g) for g in grams], np.float64)
    return np.concatenate(out) / np.sqrt(np.maximum(own, 1)[:, None] * np.array([len(g) for g in landmarks], np.float64))


def fit(grams: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, penalty: float = PENALTY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, vocabulary, weights of n-gram and language) from training texts; every language has its share of the landmarks."""
    names, of = np.unique(langs, return_inverse=True)
    rank = np.empty(len(of), np.int64)
    for j in range(len(names)):
        rank[of == j] = np.arange((of == j).sum())
    chosen = np.lexsort((of, rank))[:landmarks]
    marks = [grams[i] for i in chosen]
    vocabulary = np.unique(np.concatenate(marks))
    values, vectors = np.linalg.eigh(kernel(marks, marks, vocabulary))
    large = values > SMALLEST * values[-1]
    root = vectors[:, large] / np.sqrt(values[large])
    features = kernel(grams, marks, vocabulary) @ root
    features = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    target = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    even = (1 / np.bincount(of))[of][:, None] * len(of) / len(names)  # languages weigh alike
    solved = np.linalg.solve(features.T @ (even * features) + penalty * len(of) * np.eye(features.shape[1]), features.T @ (even * target))
    scale = (root @ solved[:-1]) / np.sqrt([len(g) for g in marks])[:, None]
    row, at = presence(marks, vocabulary)
    weights = np.zeros((len(vocabulary), len(names)))
    np.add.at(weights, at, scale[row])
    return names.tolist(), vocabulary, np.concatenate([weights, solved[-1:]])


def decisions(grams: list[np.ndarray], vocabulary: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Texts by languages: the presence matrix, row-scaled, times the weights, plus the constant."""
    row, at = presence(grams, vocabulary)
    out = np.zeros((len(grams), weights.shape[1]))
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(weights[at], first, axis=0)
    return out / np.sqrt(np.maximum([len(g) for g in grams], 1))[:, None] + weights[-1]


def identified(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    fold = spark.sparkContext.broadcast(folding())
    rows = sorted((r["lang"], r["h"], bytes(r["grams"])) for r in sampled(docs, fold, sample).collect())
    names, vocabulary, weights = fit([np.frombuffer(g, np.uint64) for _, _, g in rows], [x for x, _, _ in rows], landmarks, penalty) if rows else ([], np.empty(0, np.uint64), np.empty((1, 0)))
    model = spark.sparkContext.broadcast((names, vocabulary, weights))

    def f(batches):
        names, vocabulary, weights = model.value
        for part, texts in steps(batches):
            grams = [ngrams(t, fold.value) for t in texts]
            found = [UNKNOWN] * len(grams), [0.0] * len(grams)
            if names:
                d = decisions(grams, vocabulary, weights)
                best = d.argmax(1)
                score = np.clip((d.max(1) + 1) / 2, 0, 1)
                found = [names[j] if len(g) else UNKNOWN for j, g in zip(best.tolist(), grams, strict=True)], np.where([len(g) > 0 for g in grams], score, 0.0).tolist()
            yield pa.record_batch([part.column(0), part.column(1), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(f, "doc_id long, held_out boolean, lang_pred string, score double")


def op13_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
