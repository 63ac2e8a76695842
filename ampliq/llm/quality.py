"""Quality rules whose cutoffs come with a guarantee on false rejections.

Base statistics are counted over every whole text in batches. Five rules give a document's severities, integers from 0 to 100 on scales that are
fixed beforehand, so that 50 is where a rule alone is commonly set. A joint cutoff is one number for all rules: it rejects a document whose severity by any rule, that is its
worst one, is above. Cutoffs are certified by stratum (the document's language) with all its labelled good documents as the holdout; scales and grid are fixed, so nothing is fitted on
them. They are tested from the mildest on with an exact binomial test of "``risk`` of the good documents or more are rejected"; the first one that is not refuted ends the
sequence (fixed-sequence testing, no further correction), and the level of a stratum's sequence is ``level`` over the number of strata (Bonferroni): with
probability 1 - level the rules together reject less than ``risk`` of the good documents of every stratum. Without a false rejection 174 good labels certify a cutoff where there are
four strata. Among the certified cutoffs the one with the best balance of rejected bad and good labelled documents is used, the mildest of equals; where none helps, or too few labels
certify one, only the base rules reject.

Null and empty texts have no words and fail the base rules. A null language is a stratum of its own. A repeated row gets the
same answer as its twin; a label of an unknown document has no effect; an empty label table certifies nothing. Other columns are carried.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, fresh, set_aside, steps, table, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: False rejections of good documents that all rules together may cause in one stratum, and the chance that any bound fails.
RISK = 0.025
LEVEL = 0.05
#: A wrongly rejected good document weighs as much as so many rejected bad ones.
GOOD_WEIGHT = 10
TOP = 100
#: Rows of the cutoff table (stratum, rule) that may be broadcast; a larger table is joined by a shuffle.
BROADCAST_ROWS = 10_000

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACES = SPACES.encode()


def _repeated(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For texts laid end to end (word ids, first word, words): the words of each in windows that its text holds twice or more."""
    total = len(ids)
    covered = np.zeros(total + 1, np.int64)
    at = np.concatenate([np.arange(s, s + n - WINDOW + 1) for s, n in zip(starts.tolist(), counts.tolist(), strict=True) if n >= WINDOW] or [np.empty(0, np.int64)]).astype(np.int64)
    if len(at):
        of = np.repeat(np.arange(len(starts)), np.maximum(counts - WINDOW + 1, 0))
        span = 1  # hashes of pairs, fours, eights; windows with equal hashes are compared word by word below
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            while span < WINDOW:
                mixed = mixed[: len(mixed) - span] * np.uint64(0xD6E8FEB86659FD93) + (mixed[span:] ^ (mixed[span:] >> np.uint64(31)))
                span *= 2
            key = mixed[at] ^ (of.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        a, b = at[order[:-1][same]], at[order[1:][same]]
        true = np.ones(len(a), bool)
        for k in range(WINDOW):
            true &= ids[a + k] == ids[b + k]
        if not true.all() or (of[order[:-1][same]] != of[order[1:][same]]).any():
            seen: dict = {}
            for i, d in zip(at.tolist(), of.tolist(), strict=True):  # two different windows share a hash: compare all windows themselves
                seen.setdefault((d, *ids[i : i + WINDOW].tolist()), []).append(i)
            hit = np.array([i for v in seen.values() if len(v) > 1 for i in v], np.int64)
        else:
            hit = np.union1d(a, b)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return inside[starts + counts] - inside[starts]


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of its column text."""
    kept = [c for c in docs.columns if c not in STATISTICS]

    def f(batches):
        for part, texts in steps(batches):
            known: dict = {}
            ids, counts, chars, symbols, dups = [], [], [], [], []
            for t in texts:
                words = t.split()
                counts.append(len(words))
                ids += [known.setdefault(w, len(known)) for w in words]
                chars.append(len(t.translate(None, _SPACES).decode()))
                symbols.append(sum(map(t.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))))
                lines = [x for x in t.split(b"\n") if x.strip(_SPACES)]
                dups.append(len(lines) - len(set(lines)))
            n = np.array(counts, np.int64)
            repeat = _repeated(np.array(ids, np.int64), np.cumsum(n) - n, n)
            found = [pa.array(x, pa.int64()) for x in (counts, chars, symbols, dups, repeat)]
            yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in kept), *found], [*kept, *STATISTICS])

    types = dict(docs.dtypes)
    return docs.select(*kept).mapInArrow(f, ", ".join(f"`{c}` {types[c]}" for c in kept) + "".join(f", {c} long" for c in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """The severities, each an integer from 0 to TOP of the statistics. 50 is 10 symbols in 100 words, 15 % of words in repeated windows, an equal line for
    each 8 words, and words of 10 or of 3 characters on average."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    scaled = lambda c: F.least(F.lit(TOP), F.floor(c)).cast("int")
    return {
        "symbols": scaled(500 * F.col("n_symbols") / words),
        "repeats": scaled(1000 * F.col("n_repeat_words") / (3 * words)),
        "same_lines": scaled(400 * F.col("n_dup_lines") / words),
        "long_words": scaled(5 * F.col("word_chars") / words),
        "short_words": scaled(150 * words / F.greatest(F.col("word_chars"), F.lit(1))),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


def select_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, level: float, weight: float = GOOD_WEIGHT) -> int:
    """Of the labelled documents by statistic (0 to TOP): the cutoff to use; TOP rejects nothing."""
    n, best, gain = int(good.sum()), TOP, 0.0
    for cutoff in range(TOP - 1, -1, -1):
        wrong, right = int(good[cutoff + 1 :].sum()), int(bad[cutoff + 1 :].sum())
        if binomial_tail(wrong, n, risk) > level:
            break
        if right - weight * wrong > gain:
            best, gain = cutoff, right - weight * wrong
    return best


def certified_cutoffs(values: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, cut) from the labelled rows of ``values`` (doc_id, stratum, worst, base_failed)."""
    spark = values.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = values.where(~F.col("base_failed")).join(marks, "doc_id").select(F.col(stratum).alias("stratum"), "quality", "worst")
    bins = labelled.groupBy("stratum", "worst").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    bins = written(bins, spark, "bins")
    strata = max(1, bins.select("stratum").distinct().count())

    def f(pdf: pd.DataFrame) -> pd.DataFrame:  # at most TOP + 1 rows
        good, bad = np.zeros(TOP + 1), np.zeros(TOP + 1)
        good[pdf["worst"]], bad[pdf["worst"]] = pdf["good"], pdf["bad"]
        return pd.DataFrame([{"stratum": pdf["stratum"].iloc[0], "cut": select_cutoff(good, bad, risk, level / strata)}])

    return bins.groupBy("stratum").applyInPandas(f, "stratum string, cut int")


def with_rules(stats: DataFrame) -> DataFrame:
    """``stats`` with base_failed and worst, the largest severity."""
    return stats.withColumn("base_failed", base_failed()).withColumn("worst", F.greatest(*rule_values().values()))


def cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The table of certified cutoffs, written; broadcast where it has at most ``BROADCAST_ROWS`` rows."""
    values = with_rules(stats.select("doc_id", stratum, *STATISTICS))
    cut = written(certified_cutoffs(values, labels, stratum, risk, level), stats.sparkSession, "cutoffs")
    return F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut


def verdicts(stats: DataFrame, cut: DataFrame, stratum: str = "lang") -> DataFrame:
    """``stats`` with base_failed and kept."""
    worst, of, most = fresh(stats.columns, "_worst", "_stratum", "_cut")
    rejected = F.coalesce(F.col(worst) > F.col(most), F.lit(False))
    given = stats.withColumn(worst, F.greatest(*rule_values().values()))
    met = given.join(cut.select(F.col("stratum").alias(of), F.col("cut").alias(most)), F.col(stratum).eqNullSafe(F.col(of)), "left")
    return met.select(*stats.columns, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``docs`` without its text but with the statistics, base_failed and kept."""
    docs = docs.drop("base_failed", "kept")
    stats = written(text_statistics(docs).drop("text"), docs.sparkSession, "statistics")
    return verdicts(stats, cutoffs(stats, labels, stratum, risk, level), stratum)


def accepted(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` that are kept. Statistics are counted twice, which costs less than moving all texts to meet their verdicts."""
    apart, own = set_aside(docs, *STATISTICS, "base_failed", "kept")  # columns of the same names stay as they are
    cut = cutoffs(text_statistics(apart).drop("text"), labels, stratum, risk, level)
    return verdicts(text_statistics(apart), cut, stratum).where("kept").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def op6_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc_id", *STATISTICS, "base_failed", "kept")
