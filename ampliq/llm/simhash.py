"""SimHash near copies found with pivot distance tables.

A text's fingerprint has ``words`` 64-bit words; a bit is the majority of that bit over the hashes of its word shingles, repeats
included. Texts with one fingerprint are one class; all work is on distinct fingerprints.

Pivot table: the Hamming distances of every distinct fingerprint to reference fingerprints, computed once, written, and carried with the
fingerprint. A link of at most ``radius`` bits changes no distance by more than ``radius``, so a pair whose largest coordinate
difference exceeds it is discarded; survivors are verified on the fingerprints. Further references are zero outside a few bits: their
coordinates' differences to that of the all-zero reference depend on those bits alone, and fingerprints meet where such differences agree.

Two ways to meet. ``Scheme`` is exact: the references lie in blocks of bits, ``radius`` changed bits leave all but ``radius`` blocks as
they were, and fingerprints meet where ``together`` blocks agree (five blocks, three together, for two bits). ``Sampled`` is for radii too wide for
that: each of its tables takes some bits at random (references with a single bit). The number of bits follows the number of fingerprints, so that some
32 to 64 unrelated ones meet in a place at any size, and the number of tables follows the bits, so that a pair whose bits differ with the
probability ``changed`` meets with the probability ``recall``. Work and rows grow with the power 1.24 of the fingerprints.

A place with more than BIG fingerprints is crowded and is dealt in chunks of some BIG. With an exact scheme its members go through a finer one
(sixteen blocks of four bits, fourteen together), where a place has at most 2^8 distinct fingerprints by construction. With a sampled one
each chunk also gets the place's LEADERS, so that a crowd of near copies becomes one component at once; then the members that don't
belong to the place's largest component are compared to all of its chunks. So no link between two fingerprints that meet is lost, and only
crowds that have no link to each other cost the product of their sizes (of the smaller ones and the place), dealt over chunks.
Verified links within a chunk shrink to one per member before they leave the task. Components follow in DataFrame operations.

Null and empty texts have fingerprint zero and link like others. Repeated rows each get their line. A null doc_id is passed over as
a component's smallest id; a component of only such rows has none. An empty table gives no rows. Other columns are carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import fresh, steps, table, written

SEED = 42
BIG = 256
#: Members of a crowded place that are dealt to each of its chunks, about.
LEADERS = 64
#: Crowded places up to which the table of their keys is broadcast (16 MB).
BROADCAST_KEYS = 1_000_000
BLOCK_REFERENCES = 10
_BITS = np.array([[v >> k & 1 for k in range(8)] for v in range(256)], np.float32)


@dataclass(frozen=True)
class Scheme:
    """Which blocks of a fingerprint are keys: ``blocks`` of (word, first bit, bits), ``together`` of them at a time."""

    blocks: tuple[tuple[int, int, int], ...]
    together: int
    radius: int

    exact = True


@dataclass(frozen=True)
class Sampled:
    """Keys of ``bits`` random bits in as many tables as ``recall`` asks for."""

    radius: int
    changed: float
    recall: float
    bits: int = 8

    exact = False

    @property
    def tables(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - (1 - self.changed) ** self.bits))

    def sized(self, n: int) -> Sampled:
        """The scheme for ``n`` fingerprints: 32 to 64 unrelated ones in a place."""
        return Sampled(self.radius, self.changed, self.recall, max(self.bits, math.ceil(math.log2(max(n, 1))) - 6))


#: Two of 64 bits, exactly.
EXACT = Scheme(((0, 0, 13), (0, 13, 13), (0, 26, 13), (0, 39, 13), (0, 52, 12)), 3, 2)
FINE = Scheme(tuple((0, 4 * k, 4) for k in range(16)), 14, 2)
#: A Jaccard similarity of 0.8 changes 15.15 of 100 bits: 77.6 of 512, with a deviation of 8.1. 99 in a hundred such pairs lie within 96 bits, and 98 in a hundred meet.
WIDE = Sampled(radius=96, changed=0.1515, recall=0.98)


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """``docs`` without its text, with ``fp``: the fingerprint's words, each 8 bytes, most significant first."""
    kept = [c for c in docs.columns if c not in ("text", "fp")]
    types = dict(docs.dtypes)
    odd = np.random.default_rng(SEED).integers(0, 2**63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def f(batches):
        digest = xxhash.xxh64_intdigest
        for part, texts in steps(batches):
            hashes, counts = [], []
            for t in texts:
                w = t.lower().split()
                line = b" ".join(w)
                if len(w) <= shingle:
                    found = [digest(line, SEED)] if w else []
                else:
                    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
                    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
                    found = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
                hashes += found
                counts.append(len(found))
            h, n = np.array(hashes, np.uint64), np.array(counts, np.int64)
            base = np.repeat(np.arange(len(n)) * 2048, n)
            columns = []
            for k in range(words):
                with np.errstate(over="ignore"):
                    x = h if k == 0 else (h ^ (h >> np.uint64(31))) * odd[k]
                    x = x if k == 0 else x ^ (x >> np.uint64(32))
                at = base.copy()
                tally = np.zeros(2048 * len(n), np.int64)
                for byte in range(8):
                    at2 = at + 256 * byte + ((x >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
                    tally += np.bincount(at2, minlength=len(tally))
                ones = tally.reshape(len(n), 8, 256).astype(np.float64) @ _BITS
                bits = (2 * ones > n[:, None, None]).astype(np.uint8)
                columns.append(np.packbits(bits, axis=2, bitorder="little").reshape(len(n), 8)[:, ::-1])
            fp = np.concatenate(columns, axis=1) if len(n) else np.empty((0, 8 * words), np.uint8)
            yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array([r.tobytes() for r in fp], pa.binary())], [*kept, "fp"])

    return docs.select(*kept, "text").mapInArrow(f, "".join(f"`{c}` {types[c]}, " for c in kept) + "fp binary")


def _numbers(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of unsigned words."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), ">u8").reshape(len(held), -1).astype(np.uint64)


def _references(words: int) -> np.ndarray:
    """The reference fingerprints of the pivot table. Distances between wide fingerprints tell little, so they have few."""
    return np.random.default_rng(SEED + 2).integers(0, 2**64, (16 if words == 1 else 4, words), dtype=np.uint64)


def pivot_table(distinct: DataFrame, words: int) -> DataFrame:
    """``distinct`` (fp, ...) with ``far``: the distances to the reference fingerprints, two bytes each."""

    def f(batches):
        references = _references(words)
        for b in batches:
            fps = _numbers(b.column(b.schema.get_field_index("fp")))
            far = np.stack([_distance(fps, r) for r in references], axis=1).astype("<u2") if len(fps) else np.empty((0, 1))
            yield pa.record_batch([*b.columns, pa.array([r.tobytes() for r in far], pa.binary())], [*b.schema.names, "far"])

    return distinct.mapInArrow(f, ", ".join(f"`{c}` {t}" for c, t in distinct.dtypes) + ", far binary")


def _mixed(number: int, parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of several numbers."""
    k = np.full(len(parts[0]), number + 1, np.uint64)
    with np.errstate(over="ignore"):
        for x in parts:
            k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x * np.uint64(0x94D049BB133111EB)
        k ^= k >> np.uint64(32)
    return k


def _keys(fps: np.ndarray, scheme: Scheme | Sampled) -> np.ndarray:
    """One column of keys per choice of blocks or per table, from the differences of pivot distances."""
    rng = np.random.default_rng(SEED + 1)
    if not scheme.exact:
        # the distance to a reference with one bit, less that to zero, says that bit
        bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
        out = []
        for number in range(scheme.tables):
            taken = np.packbits(bits[:, rng.choice(bits.shape[1], min(scheme.bits, bits.shape[1]), replace=False)], axis=1)
            padded = np.zeros((len(fps), -(-taken.shape[1] // 8) * 8), np.uint8)
            padded[:, : taken.shape[1]] = taken
            out.append(_mixed(number, list(padded.view(np.uint64).T)))
        return np.stack(out, axis=1).view(np.int64)
    plain = np.bitwise_count(fps).astype(np.int64)
    mixed = []
    for word, first, bits in scheme.blocks:
        m = np.zeros(len(fps), np.uint64)
        inside = rng.integers(1, 1 << bits, BLOCK_REFERENCES, dtype=np.uint64) if bits > 8 else np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for reference in inside << np.uint64(first):
            moved = np.bitwise_count(fps[:, word] ^ reference).astype(np.int64) - plain[:, word]
            with np.errstate(over="ignore"):
                m = m * np.uint64(131) + (moved + 64).astype(np.uint64)
        mixed.append(m)
    return np.stack([_mixed(number, [mixed[b] for b in choice]) for number, choice in enumerate(combinations(range(len(mixed)), scheme.together))], axis=1).view(np.int64)


def meeting_places(pivots: DataFrame, scheme: Scheme | Sampled) -> DataFrame:
    """(key, fp, far): every distinct fingerprint at each of its meeting places."""

    def f(batches):
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                keys = _keys(_numbers(part.column(0)), scheme)
                rows = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.record_batch([pa.array(keys.reshape(-1)), part.column(0).take(rows), part.column(1).take(rows)], ["key", "fp", "far"])

    return pivots.select("fp", "far").mapInArrow(f, "key long, fp binary, far binary")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(place: np.ndarray, fps: np.ndarray, far: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows numbered by place, in order -> (row, smaller row it is linked to), through pairs within a place."""
    a, b = [], []
    row, shift = np.arange(len(place) - 1), 1
    while len(row):
        row = row[place[row] == place[row + shift]]
        if len(row):
            near = np.abs(far[row] - far[row + shift]).max(axis=1) <= radius  # the pivot table
            r = row[near]
            r = r[_distance(fps[r], fps[r + shift]) <= radius]
            a.append(r), b.append(r + shift)
        shift += 1
        row = row[row + shift < len(place)]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = _labels(len(place), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(len(place)))
    return moved, label[moved]


def _places(batches, names: list[str]):
    """Whole (key, chunk) groups of a sorted stream, several at a time: a number for each row's group, and the columns of ``names``."""
    held: list[pa.Table] = []
    waiting = 0
    for b in batches:
        held.append(pa.Table.from_batches([b])), (waiting := waiting + b.num_rows)
        if waiting < 4000:
            continue
        whole = pa.concat_tables(held)
        key, chunk = whole.column("key").to_numpy(), whole.column("chunk").to_numpy()
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(chunk) != 0))
        if not len(new):
            continue
        cut = int(new[-1]) + 1
        yield np.searchsorted(new, np.arange(cut), side="left"), *(whole.column(c).slice(0, cut) for c in names)
        held, waiting = [whole.slice(cut)], len(key) - cut
    if waiting:
        whole = pa.concat_tables(held)
        key, chunk = whole.column("key").to_numpy(), whole.column("chunk").to_numpy()
        yield np.cumsum(np.concatenate([[0], (np.diff(key) != 0) | (np.diff(chunk) != 0)])), *(whole.column(c) for c in names)


def _coordinates(column: pa.ChunkedArray) -> np.ndarray:
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), "<u2").reshape(len(held), -1).astype(np.int32)


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _gathered(met: DataFrame, *order: str) -> DataFrame:
    """Each (key, chunk) in one partition, in order. The hash keeps this exchange apart from a join on the key, whose partitions Spark may split."""
    return met.repartition(F.hash("key", "chunk")).sortWithinPartitions("key", "chunk", *order)


def _matched(met: DataFrame, radius: int) -> DataFrame:
    """(a, b): verified links of the meeting places ``met`` (key, chunk, fp, far)."""

    def f(batches):
        for place, fp, far in _places(batches, ["fp", "far"]):
            moved, to = _links(place, _numbers(fp), _coordinates(far), radius)
            held = fp.to_pylist()
            yield _pairs([held[i] for i in moved], [held[i] for i in to])

    return _gathered(met.select("key", "chunk", "fp", "far"), "fp").mapInArrow(f, "a binary, b binary")


def _across(met: DataFrame, radius: int) -> DataFrame:
    """(a, b): roots that a member outside its place's largest component (``asks``) links to, from ``met`` (key, chunk, asks, fp, far, root)."""

    def f(batches):
        for place, asks, fp, far, root in _places(batches, ["asks", "fp", "far", "root"]):
            asks, fps, far, root = asks.to_numpy(zero_copy_only=False), _numbers(fp), _coordinates(far), np.array(root.to_pylist(), object)
            number = {r: k for k, r in enumerate(dict.fromkeys(root.tolist()))}
            of, found = np.array([number[r] for r in root], np.int64), set()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                rows = np.arange(low, high)
                asking, asked = rows[asks[low:high]], rows[~asks[low:high]]
                for k in range(0, len(asking), 128):
                    part = asking[k : k + 128]
                    x, y = np.nonzero((np.abs(far[part][:, None] - far[asked][None]).max(axis=2) <= radius) & (of[part][:, None] != of[asked][None]))
                    x, y = part[x], asked[y]
                    near = _distance(fps[x], fps[y]) <= radius
                    found.update(zip(of[x[near]].tolist(), of[y[near]].tolist(), strict=True))
            names = list(number)
            yield _pairs([names[a] for a, _ in found], [names[b] for _, b in found])

    return _gathered(met, "fp").mapInArrow(f, "a binary, b binary")


def rooted_fingerprints(pivots: DataFrame, scheme: Scheme | Sampled) -> DataFrame:
    """(node, root) of all fingerprints of ``pivots`` (fp, far) that have a link: components of the links within the scheme's radius."""
    spark = pivots.sparkSession
    if not scheme.exact:
        scheme = scheme.sized(pivots.count())
    met = meeting_places(pivots, scheme)
    sizes = written(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BIG), spark, "crowded")
    crowds = sizes.count()
    if not crowds:
        return components(_matched(met.withColumn("chunk", F.lit(0)), scheme.radius))
    marked = met.join(F.broadcast(sizes) if crowds <= BROADCAST_KEYS else sizes, "key", "left")
    plain = marked.where("n IS NULL").select("key", F.lit(0).alias("chunk"), "fp", "far")
    crowded = marked.where("n IS NOT NULL")
    if scheme.exact:
        finer = meeting_places(written(crowded.select("fp", "far").distinct(), spark, "crowd"), FINE)
        return components(_matched(plain, scheme.radius).union(_matched(finer.withColumn("chunk", F.lit(0)), scheme.radius)))
    crowded = written(crowded, spark, "crowd").withColumn("chunks", F.ceil(F.col("n") / BIG).cast("int"))
    own, every = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.sequence(F.lit(0), F.col("chunks") - 1)
    leads = F.pmod(F.xxhash64(F.lit("leads"), "key", "fp"), F.col("n")) < LEADERS
    dealt = crowded.withColumn("chunk", F.explode(F.when(leads, every).otherwise(F.array(own)))).select("key", "chunk", "fp", "far")
    roots = written(components(_matched(plain.union(dealt), scheme.radius)), spark, "roots")
    rooted = crowded.join(roots, crowded["fp"] == roots["node"], "left").select("key", "fp", "far", "chunks", F.coalesce("root", "fp").alias("root"))
    of_place = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    largest = written(of_place.groupBy("key").agg(F.max(F.struct("members", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main"), spark, "largest")
    left = rooted.join(largest, "key")
    asking = left.where("root <> main").select("key", F.explode(every).alias("chunk"), F.lit(True).alias("asks"), "fp", "far", "root")
    more = components(_across(left.select("key", own.alias("chunk"), F.lit(False).alias("asks"), "fp", "far", "root").union(asking), scheme.radius))
    # roots that lead on to another, and nodes that had no link before
    after = more.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    settled = roots.join(after, roots["root"] == after["_from"], "left").select("node", F.coalesce("_to", "root").alias("root"))
    return settled.union(more.join(roots, "node", "left_anti").select("node", "root"))


def near_copies(docs: DataFrame, shingle: int = 3, words: int = 1, scheme: Scheme | Sampled = EXACT, with_root: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) without its text, with fp and component_id: the smallest doc_id that links lead to. ``with_root`` adds root, the
    component's own fingerprint, as components whose rows share an id share a component_id."""
    spark = docs.sparkSession
    marked = written(fingerprints(docs.drop("component_id", "root"), shingle, words), spark, "fingerprints")
    distinct = written(pivot_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), words), spark, "pivots")
    roots = rooted_fingerprints(distinct, scheme)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select(*marked.columns, "component_id", *(["root"] if with_root else []))


def one_of_each(docs: DataFrame, shingle: int = 5, words: int = 8, scheme: Sampled = WIDE) -> DataFrame:
    """Of each group of near copies the row of ``docs`` with the smallest doc_id (and, of rows that share it, the smallest hash of its text). Rows without an
    id come behind all that have one, by their texts' hashes. Rows that share an id but not a group are kept apart by their texts."""
    names = docs.columns
    key = fresh(names, "_unnumbered", "_number", "_text")
    keyed = docs.withColumns(dict(zip(key, [F.col("doc_id").isNull(), F.coalesce("doc_id", F.xxhash64("text")), F.xxhash64("text")], strict=True)))
    unnumbered, number, text = key
    found = near_copies(keyed.select(F.col(number).alias("doc_id"), "text", F.col(unnumbered).alias("unnumbered"), F.col(text).alias("hash")), shingle, words, scheme, with_root=True)
    first = found.groupBy("root").agg(F.min(F.struct("unnumbered", "doc_id", "hash")).alias("least"))
    first = first.select(*[F.col(f"least.{c}").alias(k) for c, k in zip(("unnumbered", "doc_id", "hash"), key, strict=True)])
    return keyed.join(first, key, "left_semi").dropDuplicates(key).select(*names)


def op3_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
