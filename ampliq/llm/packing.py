"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

A document is its token ids and an end token. A document longer than a sequence is cut into full pieces, the first one taking what is
left over. Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There the configuration program

    min sum_c x_c   with   sum_c c_l x_c >= b_l for every length l,   c: a multiset of lengths that fits one sequence

is solved by multiplicative weights: each round prices the lengths, finds the best configuration by an unbounded-knapsack dynamic
program, adds it and lowers the prices of what it holds. The averaged solution, scaled to cover the whole volume, is rounded down and placed. What is
left over (less than one sequence a configuration, and lengths that were priced too low) is placed in whole numbers: each dive finds, by a knapsack bounded by
the pieces there are, a configuration that fills its sequence, and places it for up to half of what they allow, at least once. After ``DIVES`` dives, or where no
configuration is full any more, the rest is placed by best fit, longest first, over groups of sequences with the same free room. Only where best fit of
the whole histogram needs fewer sequences is its plan taken.
The plan says how many sequences
have which configuration, so its size depends on the number of lengths, not on the corpus. Pieces of one length are then numbered in Spark (counts
per block, offsets, numbers within the block) and each number finds its sequence and place by a range of the plan.

Null and empty texts: the end token alone. Repeated rows and shared ids: each row is packed; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import load_tokenizer, steps, table, tokenizer_path, written

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: Rounds of multiplicative weights and their step, dives after them, and the lengths that a dive looks at: the largest, and those with most left.
ROUNDS = 200
STEP = 0.25
DIVES = 1500
DIVE_LARGEST, DIVE_MOST = 64, 128
#: Units whose ids a Python task remembers.
REMEMBERED = 600_000
#: Pieces of one length that are numbered together.
BLOCK_ROWS = 20_000


class UnitEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    Byte-level splitting puts a single space in front of the word that follows and leaves a single line end by itself, and letters never share
    a piece with the punctuation behind them. So a text falls into words with their space, line ends, and cores and tails of words, each encoded by
    itself. Where white space meets white space, the run and what touches it stay together. Units are remembered, up to ``REMEMBERED``. Cores of
    Latin letters are one piece each and go to the library's model at once, all else through the whole of the library."""

    def __init__(self, path: str):
        self.tokenizer, self.known = load_tokenizer(path), {}
        # what the vocabulary writes for the characters of such words, whose letters are one piece to its model
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x250)) if c == " " or WORD.fullmatch(c)}
        self.space = self.letters[ord(" ")]

    @classmethod
    def of_process(cls, path: str) -> UnitEncoder:
        """One for all tasks that this Python process runs, so that what it remembers lasts."""
        held = sys.__dict__.setdefault("_ampliq_unit_encoders", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def units(self, text: str) -> list[str]:
        spaces = [c for c in _SPACES if c in text]
        if not text or text[0].isspace() or text[-1].isspace() or any(a + b in text for a in spaces for b in spaces if " " in (a, b) or "\n" in (a, b)):
            return self._careful_units(text)
        out: list[str] = []
        for line in text.split("\n"):
            if out:
                out.append("\n")
            first, *rest = line.split(" ")
            out.append(first)
            out += [" " + w for w in rest]
        return out

    def _careful_units(self, text: str) -> list[str]:
        first, *rest = text.split(" ")
        out, last = [], first
        for p in rest:
            if last and p and not last[-1].isspace() and not p[0].isspace():
                out.append(last)
                last = " " + p
            else:
                last += " " + p
        out.append(last)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known, split = self.known, [self.units(t) for t in texts]
        found, gaps, missing = [], [], []
        for s in split:
            f = list(map(known.get, s))
            if None in f:
                at = [i for i, x in enumerate(f) if x is None]
                gaps.append((f, at, [s[i] for i in at]))
                missing += gaps[-1][2]
            found.append(f)
        if gaps:
            new = self._encoded(set(missing))
            for f, at, units in gaps:
                for i, u in zip(at, units, strict=True):
                    f[i] = new[u]
            if len(known) < REMEMBERED:
                known.update(new)
        return [b"".join(f) for f in found]

    def _encoded(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of units that aren't remembered: cores and tails of words apart, each part once."""
        known, split, words, others = self.known, [], set(), set()
        for u in missing:
            m = WORD.fullmatch(u)
            if m is None:
                others.add(u)
            elif m[2]:
                split.append((u, m[1], m[2]))
                words.add(m[1])
                others.add(m[2])
            else:
                words.add(u)
        new = {x: known[x] for x in (words | others) & known.keys()}
        tokenize, space, letters = self.tokenizer.model.tokenize, self.space, self.letters
        for u in words - new.keys():
            ids = [t.id for t in tokenize(u.replace(" ", space) if u.isascii() else u.translate(letters))]
            new[u] = struct.pack(f"<{len(ids)}I", *ids)
        listed = list(others - new.keys())
        for k in range(0, len(listed), 2000):
            part = listed[k : k + 2000]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = e.ids
                new[u] = struct.pack(f"<{len(ids)}I", *ids)
        for u, core, tail in split:
            new[u] = new[core] + new[tail]
        return new


#: Everything that Python or the vocabulary's pattern takes for white space.
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


#: A word of Latin letters, with or without a space before it, and its tail of punctuation.
WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@[-`{-~]*)")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with ``keep_ids`` the ids as bytes) for every piece of every row of ``docs``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def f(batches):
        encoder, tail = UnitEncoder.of_process(path), np.asarray([end], "<u4").tobytes()
        for part, texts in steps(batches, most=1 << 20):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode([t.decode() for t in texts]), strict=True):
                ids += tail
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    stop = start + ((n - start - 1) % capacity + 1)
                    held = ids[4 * start : 4 * stop]
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(held), held)[: len(names)])
                    start, piece = stop, piece + 1
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def _best_configuration(price: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[int, int]:
    """Unbounded knapsack: the multiset of sizes within the capacity that is worth most."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes[0])
    for room in range(least, capacity + 1):
        n = int(np.searchsorted(sizes, room, side="right"))
        worth = best[room - sizes[:n]] + price[:n]
        k = int(worth.argmax())
        if worth[k] > best[room - 1]:
            best[room], took[room] = worth[k], k
        else:
            best[room], took[room] = best[room - 1], -1
    held, room = defaultdict(int), capacity
    while room >= least:
        if took[room] < 0:
            room -= 1
        else:
            held[int(took[room])] += 1
            room -= int(sizes[took[room]])
    return held


def _fractional(left: np.ndarray, sizes: np.ndarray, capacity: int, rounds: int, step: float) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often each is taken, scaled to the volume of what is left."""
    need = left.astype(float)
    log_price, used, picked = np.log(sizes / capacity), np.zeros(len(sizes)), defaultdict(float)
    for _ in range(rounds):
        # worth of one piece of a length in the covering program, per unit of its demand
        held = _best_configuration(np.exp(log_price - log_price.max()), sizes, capacity)
        take = min(need[k] / n for k, n in held.items()) / 8
        for k, n in held.items():
            used[k] += n * take
            log_price[k] -= step * n * take / need[k]
        picked[tuple(sorted(held.items()))] += take
    scale = (need @ sizes) / max(used @ sizes, 1e-12)
    return [(dict(held), take * scale) for held, take in picked.items()]


def _full_configuration(left: np.ndarray, sizes: np.ndarray, capacity: int, most: int) -> dict[int, int]:
    """Bounded knapsack: pieces that fill a sequence, worth a little more by length the larger they are, so that small ones stay for the last gaps.
    Looked at are the largest lengths, and ``most`` with the most left."""
    some = np.flatnonzero(left)
    some = np.union1d(some[-DIVE_LARGEST:], some[np.argsort(-(left[some] * sizes[some]), kind="stable")[:most]])
    items = []
    for k in some[::-1].tolist():
        n, part = min(int(left[k]), capacity // int(sizes[k])), 1
        while n > 0:
            items.append((k, min(part, n)))
            n, part = n - part, part * 2
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for i, (k, n) in enumerate(items):
        weight = n * int(sizes[k])
        worth = best[:-weight] + weight * (1 + 1e-3 * int(sizes[k]) / capacity)
        took[i, weight:] = worth > best[weight:]
        best[weight:] = np.maximum(best[weight:], worth)
    out, room = defaultdict(int), capacity
    for i in range(len(items) - 1, -1, -1):
        if took[i, room]:
            k, n = items[i]
            out[k] += n
            room -= n * int(sizes[k])
    return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP, dives: int = DIVES) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(number of sequences, ((length, times), ...)), ...] that hold every piece of the histogram exactly once."""
    whole = {int(k): int(v) for k, v in histogram.items() if v}
    if not whole:
        return []
    plan, _ = _program_plan(whole, capacity, rounds, step, dives)
    alone = _best_fit(dict(whole), capacity)
    return sorted((times, c) for c, times in min(plan, alone, key=lambda p: sum(p.values())).items())


def _program_plan(whole: dict[int, int], capacity: int, rounds: int, step: float, dives: int) -> tuple[dict[tuple, int], int]:
    """The program's plan with its residue by best fit, and how many pieces the program placed."""
    plan: dict[tuple, int] = defaultdict(int)
    sizes = np.array(sorted(whole), np.int64)
    left = np.array([whole[int(s)] for s in sizes], np.int64)

    def place(held: dict[int, int], times: int) -> None:
        plan[tuple(sorted((int(sizes[k]), n) for k, n in held.items()))] += times
        for k, n in held.items():
            left[k] -= times * n

    for held, take in sorted(_fractional(left, sizes, capacity, rounds, step), key=lambda x: -x[1]):
        times = min(int(take), *(int(left[k]) // n for k, n in held.items()))
        if times:
            place(held, times)
    total = int(left @ sizes)
    slack = -total % capacity  # what as few sequences as can be leave empty
    for _ in range(dives if total else 0):
        for most in (DIVE_MOST, 4 * DIVE_MOST):
            held = _full_configuration(left, sizes, capacity, most)
            waste = capacity - sum(int(sizes[k]) * n for k, n in held.items())
            if not waste:
                break
        if not held or waste > slack:
            break
        times = max(1, min(int(left[k]) // n for k, n in held.items()) // 2)
        times = min(times, slack // waste) if waste else times
        slack -= waste * times
        place(held, times)
    placed = sum(whole.values()) - int(left.sum())
    for c, times in _best_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}, capacity).items():
        plan[c] += times
    return plan, placed


def _best_fit(left: dict[int, int], capacity: int) -> dict[tuple, int]:
    """Best fit, longest first, where sequences with the same content are one group with a count."""
    by_room: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for size in sorted((s for s in left if left[s]), reverse=True):
        n = left[size]
        while n:
            room = next((r for r in range(size, capacity + 1) if by_room.get(r)), None)
            if room is None:
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    by_room[capacity - each * size][((size, each),)] += full
                if rest:
                    by_room[capacity - rest * size][((size, rest),)] += 1
                n = 0
                continue
            group = by_room[room]
            c, count = next(iter(group.items()))
            each = min(room // size, n)
            times = min(count, n // each)
            if count == times:
                del group[c]
            else:
                group[c] -= times
            by_room[room - each * size][tuple(sorted([*c, (size, each)]))] += times
            n -= each * times
    out: dict[tuple, int] = defaultdict(int)
    for group in by_room.values():
        for c, times in group.items():
            out[c] += times
    return out


def _places(plan: list[tuple[int, tuple[tuple[int, int], ...]]]) -> pd.DataFrame:
    """For each length: ranges of piece numbers, with the first sequence of the range, pieces a sequence and the offset of the first."""
    rows, taken, first = [], defaultdict(int), 0
    for times, held in plan:
        offset = 0
        for size, n in held:
            rows.append((size, taken[size], taken[size] + times * n, first, n, offset))
            taken[size] += times * n
            offset += size * n
        first += times
    return pd.DataFrame(rows, columns=["length", "low", "high", "first_sequence", "each", "base"]).astype("int64")


def pack(found: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``found`` (doc_id, piece, length, ...) with sequence_id and offset."""
    spark, names = found.sparkSession, found.columns
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length: at most ``capacity``
    places = _places(plan_sequences(histogram, capacity, rounds))
    key = [F.col(c) for c in names]
    blocks = -(-max(histogram.values(), default=1) // BLOCK_ROWS)
    blocked = found.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(blocks)))
    counts = blocked.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_block")) - F.col("_n")).drop("_n")
    numbered = blocked.withColumn("_in", F.row_number().over(W.partitionBy("length", "_block").orderBy("doc_id", "piece")) - 1)
    numbered = numbered.join(before, ["length", "_block"]).withColumn("_number", F.col("_before") + F.col("_in"))
    if not len(places):
        return found.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    # the plan has a range per length and configuration, at most some ten thousand rows whatever the corpus
    lows, by_length = spark.sparkContext.broadcast({k: (g["low"].to_numpy(), g.to_numpy()) for k, g in places.groupby("length")}), [c for c in names if c not in ("sequence_id", "offset")]

    def f(batches):
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    low, ranges = lows.value[int(length[rows[0]])]
                    r = ranges[np.searchsorted(low, number[rows], side="right") - 1]
                    k = number[rows] - r[:, 1]
                    sequence[rows] = r[:, 3] + k // r[:, 4]
                    offset[rows] = r[:, 5] + k % r[:, 4] * length[rows]
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in by_length), pa.array(sequence), pa.array(offset)], [*by_length, "sequence_id", "offset"])

    types = dict(found.dtypes)
    return numbered.select(*by_length, "_number").mapInArrow(f, ", ".join(f"`{c}` {types[c]}" for c in by_length) + ", sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of ``docs`` (doc_id, text)."""
    return pack(written(pieces(docs, path, capacity), docs.sparkSession, "pieces"), capacity)


def op9_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
