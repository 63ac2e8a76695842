"""Removal of repeated passages: Rabin-Karp hashes of every window of ``window`` words, matched over the whole corpus.

Every window of every text gets a polynomial hash modulo 2^64 of its words' 64-bit hashes, computed for a whole text by doubling. A task
keeps, of windows that its texts share, only the first (smallest doc_id, then start), which bounds any hash to one entry per
task however often a passage occurs; the later ones are already known to be repeats. Entries are dealt by hash to buckets, packed as hashes,
gaps between starts and a list of documents, about ten bytes a window. A bucket sorts its hashes, finds the first occurrence of each
and returns the starts of all others, packed per group of documents. Starts and texts of a group meet, overlapping windows merge into maximal
intervals and their words are removed. Everything is judged on the input, whatever is removed elsewhere.

Two different windows share a 64-bit hash with probability 2^-64; among n windows n^2 / 2^65 such pairs are expected.

Null and empty texts: no words, nothing removed. A document is known by its id and a hash of its text, so rows that share an id but not their text are
documents of their own, in the order of that hash, and rows that repeat both are one document, of which none is an earlier copy of the other. A null doc_id
counts as smaller than any other (its place is taken by a number from the text's hash, below -2^61). Other columns are carried.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import steps, table, text_bytes

WINDOW = 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Text bytes per bucket: about a million windows, some 50 MB while it is sorted.
BUCKET_TEXT = 6 << 20
#: Text bytes per group of documents, in which starts and texts meet.
GROUP_TEXT = 8 << 20
#: Windows that a task holds before it hands them on.
HELD = 1_000_000
NO_ID = -(1 << 63)


def window_hashes(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The hash of every window of consecutive words, by start."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    out, at, power = None, 0, BASE
    span = 1
    with np.errstate(over="ignore"):
        while True:  # h: hashes of windows of ``span`` words; power: BASE ** span
            if window & span:
                part = h[window - at - span : window - at - span + n]
                out = part.copy() if out is None else part * scale + out
                at += span
                scale = power if at == span else scale * power
            if span * 2 > window:
                break
            h = h[:-span] * power + h[span:]
            power, span = power * power, span * 2
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def _narrow(values: np.ndarray, kind: str) -> list[bytes]:
    """Whole numbers in a short type; what doesn't fit follows at full length."""
    most = np.iinfo(kind).max
    wide = (values >= most) | (values < 0)
    return [np.where(wide, most, values).astype(kind).tobytes(), struct.pack("<I", int(wide.sum())), values[wide].astype("<i8").tobytes()]


def _widened(held: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    out = np.frombuffer(held, kind, n, at).astype(np.int64)
    at += n * np.dtype(kind).itemsize
    (k,) = struct.unpack_from("<I", held, at)
    out[out == np.iinfo(kind).max] = np.frombuffer(held, "<i8", k, at + 4)
    return out, at + 4 + 8 * k


def _key(doc_id: int | None, text: bytes) -> tuple[int, int]:
    """A document's number and the hash of its text that tells it from others with this number."""
    h = xxhash.xxh64_intdigest(text)
    return (NO_ID + (h >> 2) if doc_id is None else doc_id), h & 0xFFFFFFFF


def _packed(hashes: np.ndarray, docs: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> bytes:
    """Windows ordered by document and start, as hashes, gaps between starts, and the documents with their numbers of windows."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(docs) != 0) | (np.diff(tags) != 0)]))
    gaps = np.diff(starts, prepend=0)
    gaps[new] = starts[new]
    counts = np.diff(np.append(new, len(docs)))
    ids = docs[new]
    return b"".join([struct.pack("<IIIq", len(docs), len(hashes), len(new), ids[0]), hashes.astype("<u8").tobytes(), *_narrow(gaps, "<u2"), *_narrow(np.diff(ids), "<u4"), *_narrow(counts, "<u2"), tags[new].astype("<u4").tobytes()])


def _unpacked(held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, with_hash, d, first_id = struct.unpack_from("<IIIq", held)
    at = struct.calcsize("<IIIq")
    hashes = np.frombuffer(held, "<u8", with_hash, at)
    gaps, at = _widened(held, at + 8 * with_hash, n, "<u2")
    steps, at = _widened(held, at, d - 1, "<u4")
    counts, at = _widened(held, at, d, "<u2")
    tags = np.frombuffer(held, "<u4", d, at).astype(np.int64)
    with np.errstate(over="ignore"):
        ids = first_id + np.concatenate([[0], np.cumsum(steps)])
    sums = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    return hashes, np.repeat(ids, counts), np.repeat(tags, counts), sums - np.repeat(sums[first] - gaps[first], counts)


def _later(hashes: np.ndarray, docs: np.ndarray, tags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True for each window with the hash of one that starts earlier."""
    order = np.lexsort((starts, tags, docs, hashes))
    h, d, t, s = hashes[order], docs[order], tags[order], starts[order]
    head = np.maximum.accumulate(np.where(np.diff(h, prepend=h[:1] + np.uint64(1)) != 0, np.arange(len(h)), 0)) if len(h) else np.empty(0, np.int64)
    out = np.zeros(len(h), bool)
    out[order] = (d != d[head]) | (t != t[head]) | (s != s[head])
    return out


def _by_group(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, groups: int) -> tuple[list[int], list[bytes]]:
    """Starts packed per group of documents, in the order of documents and starts."""
    if not len(docs):
        return [], []
    group = _group(docs, tags, groups)
    order = np.lexsort((starts, tags, docs, group))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(docs)]])
    none = np.empty(0, np.uint64)
    return group[order][cuts[:-1]].tolist(), [_packed(none, docs[order[a:b]], tags[order[a:b]], starts[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _group(docs: np.ndarray, tags: np.ndarray, groups: int) -> np.ndarray:
    """The group of each document, by its id and its text's hash."""
    with np.errstate(over="ignore"):
        x = (docs.astype(np.int64).view(np.uint64) ^ (tags.astype(np.uint64) << np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def repeated_starts(docs: DataFrame, buckets: int, groups: int, window: int = WINDOW) -> DataFrame:
    """(group, held): per group of documents, the packed starts of windows of ``docs`` (doc_id, text) whose words also start earlier."""
    schema = pa.schema([("bucket", pa.int32()), ("held", pa.binary()), ("group", pa.int32()), ("starts", pa.binary())])

    def scatter(batches):
        def out(hashes, ids, tags, starts):
            hashes, ids, tags, starts = np.concatenate(hashes), np.concatenate(ids), np.concatenate(tags), np.concatenate(starts)
            later = _later(hashes, ids, tags, starts)
            known, where = _by_group(ids[later], tags[later], starts[later], groups)
            hashes, ids, tags, starts = hashes[~later], ids[~later], tags[~later], starts[~later]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.lexsort((starts, tags, ids, bucket))
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = [g for g in np.split(order, cuts) if len(g)]
            n, m = len(parts), len(known)
            yield pa.record_batch([
                pa.array([int(bucket[g[0]]) for g in parts] + [x % buckets for x in range(m)], pa.int32()), pa.array([_packed(hashes[g], ids[g], tags[g], starts[g]) for g in parts] + [None] * m, pa.binary()),
                pa.array([None] * n + known, pa.int32()), pa.array([None] * n + where, pa.binary())], schema=schema)

        held, hashes, ids, tags, starts = 0, [], [], [], []
        for part, texts in steps(batches):
            for doc_id, t in zip(part.column(0).to_pylist(), texts, strict=True):
                h = window_hashes(t.split(), window)
                if len(h):
                    number, tag = _key(doc_id, t)
                    hashes.append(h), ids.append(np.full(len(h), number, np.int64)), tags.append(np.full(len(h), tag, np.int64)), starts.append(np.arange(len(h)))
                    held += len(h)
                if held >= HELD:
                    yield from out(hashes, ids, tags, starts)
                    held, hashes, ids, tags, starts = 0, [], [], [], []
        if held:
            yield from out(hashes, ids, tags, starts)

    def match(bucket: pa.Table) -> pa.Table:
        held, group, starts = (bucket.column(c).to_pylist() for c in ("held", "group", "starts"))
        found = [_unpacked(x) for x in held if x is not None]
        to = [d for d, x in zip(group, starts, strict=True) if x is not None]
        where = [x for x in starts if x is not None]
        if found:
            hashes, ids, tags, at = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            later = _later(hashes, ids, tags, at)
            more, at = _by_group(ids[later], tags[later], at[later], groups)
            to, where = to + more, where + at
        return pa.table([pa.array(to, pa.int32()), pa.array(where, pa.binary())], ["group", "held"])

    dealt = docs.select("doc_id", "text").mapInArrow(scatter, "bucket int, held binary, group int, starts binary")
    return dealt.groupBy("bucket").applyInArrow(match, "group int, held binary")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` but for text, with n_words, n_removed, and kept_text: the words that stay, joined by one space."""
    from zstandard import ZstdCompressor, ZstdDecompressor

    total = docs.select(F.sum(text_bytes("text"))).first()[0] or 0
    buckets, groups = max(1, math.ceil(total / BUCKET_TEXT)), max(1, math.ceil(total / GROUP_TEXT))
    kept = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_text")]
    types = dict(docs.dtypes)
    columns = ", ".join(f"`{c}` {types[c]}" for c in kept)

    def compress(batches):
        for part, texts in steps(batches):
            z = ZstdCompressor(level=1)
            keys = [_key(i, t) for i, t in zip(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts, strict=True)]
            ids, tags = (np.array(x, np.int64) for x in zip(*keys, strict=True))
            yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(_group(ids, tags, groups), pa.int32()), pa.array([z.compress(t) for t in texts], pa.binary())], [*kept, "_group", "_z"])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        z, by_id = ZstdDecompressor(), {}
        found = [_unpacked(x)[1:] for x in right.column("held").to_pylist()]
        if found:
            ids, tags, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((tags, ids))
            ids, tags, at = ids[order], tags[order], at[order]
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(tags) != 0)) + 1, [len(ids)]])
            by_id = {(int(ids[a]), int(tags[a])): at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
        counts, gone, texts = [], [], []
        for doc_id, packed in zip(left.column("doc_id").to_pylist(), left.column("_z").to_pylist(), strict=True):
            text = z.decompress(packed) if packed else b""
            words = text.split()
            starts = by_id.get(_key(doc_id, text))
            if starts is not None:
                inside = np.zeros(len(words) + 1, np.int64)
                starts = starts[starts + window <= len(words)]
                np.add.at(inside, starts, 1)
                np.add.at(inside, starts + window, -1)
                stay = (np.cumsum(inside)[:-1] == 0).tolist()
            held = words if starts is None else [w for w, ok in zip(words, stay, strict=True) if ok]
            counts.append(len(words)), gone.append(len(words) - len(held)), texts.append(b" ".join(held).decode())
        return pa.table([*(left.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], [*kept, "n_words", "n_removed", "kept_text"])

    starts = repeated_starts(docs, buckets, groups, window).withColumnRenamed("group", "_group")
    packed = docs.mapInArrow(compress, f"{columns}, _group int, _z binary")
    return packed.groupBy("_group").cogroup(starts.groupBy("_group")).applyInArrow(remove, f"{columns}, n_words long, n_removed long, kept_text string")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
