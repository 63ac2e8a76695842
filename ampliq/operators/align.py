"""Global alignment with affine gaps and an incentive for gaps at each reference position.

Reads of about one length are aligned together; shorter ones are padded, and what is computed behind their ends is not used. The recurrences of the match and deletion layers look at the row above, so a row is one vector step. The
insertion layer is linear along the row: with c its cost per base, I[j] - c j is a running maximum, one ``maximum.accumulate``. Layers
and ties: a gap is extended rather than opened at equal scores; insertion wins over deletion, and either over a match, as the layer
before and as the layer to start from at the end. Gaps at the ends cost extension only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH, INSERT, DELETE = 1, 2, 3
GAP_OPEN, GAP_EXTEND, GAP_INCENTIVE, MIN_SCORE = -20, -2, 1, 60.0
SEED_MIN = 2
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s.upper().translate(_COMPLEMENT)[::-1]


def scoring_matrix(match: int = 5, mismatch: int = -4, n_match: int = -2, n_mismatch: int = -1) -> np.ndarray:
    """Scores by character code: A, C, G, T against each other, and N against a base and against itself."""
    m = np.zeros((128, 128), np.int32)
    for a in "ACGT":
        for b in "ACGT":
            m[ord(a), ord(b)] = match if a == b else mismatch
        m[ord(a), ord("N")] = m[ord("N"), ord(a)] = n_match
    m[ord("N"), ord("N")] = n_mismatch
    return m


def parse_matrix(text: str) -> np.ndarray:
    """A matrix in the common text format: comments, a header of symbols, a row for each symbol."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    m = np.zeros((128, 128), np.int32)
    for row in lines[1:]:
        for symbol, value in zip(lines[0], row[1:], strict=True):
            m[ord(row[0]), ord(symbol)] = int(value)
    return m


def align(reads: list[str], ref: str, matrix: np.ndarray, incentive: np.ndarray, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> list[tuple[str, str, float]]:
    """(aligned read, aligned reference, score) for each of ``reads``; score = 100 * equal columns / columns, to 3 places."""
    out: list = [None] * len(reads)
    order = sorted(range(len(reads)), key=lambda k: len(reads[k]))
    for k in order:
        if not reads[k] or not ref:
            out[k] = ("-" * len(ref), ref, 0.0) if ref else (reads[k], "-" * len(reads[k]), 0.0)
    order = [k for k in order if out[k] is None]
    while order:
        # as many as fit into about 16 MB of pointers, no more than an eighth longer than the first
        widest = len(reads[order[0]]) * 9 // 8 + 4
        most = max(1, 16_000_000 // ((widest + 1) * (len(ref) + 1)))
        part = [k for k in order[:most] if len(reads[k]) <= widest]
        order = order[len(part) :]
        lengths = np.array([len(reads[k]) for k in part])
        width = int(lengths.max())
        q = np.frombuffer("".join(reads[k].ljust(width, "N") for k in part).encode(), np.uint8).reshape(len(part), width)
        for k, found in zip(part, _aligned(q, lengths, np.frombuffer(ref.encode(), np.uint8), matrix, incentive, gap_open, gap_extend), strict=True):
            out[k] = found
    return out


def _aligned(q: np.ndarray, lengths: np.ndarray, r: np.ndarray, matrix: np.ndarray, incentive: np.ndarray, gap_open: int, gap_extend: int):
    (count, m), n = q.shape, len(r)
    never = np.maximum(gap_open * lengths * n, -(2**30)).astype(np.int32)
    columns = np.arange(m + 1, dtype=np.int32)
    g = incentive.astype(np.int32)
    match = np.repeat(never[:, None], m + 1, axis=1)
    delete = match.copy()
    match[:, 0] = 0
    insert = np.broadcast_to(gap_extend * columns + g[0], (count, m + 1)).astype(np.int32)
    insert[:, 0] = never
    # a gap behind a read's last base only costs extension
    inner = np.where(columns == lengths[:, None], gap_extend, gap_open).astype(np.int32)
    # two bits a layer: from which layer each cell of the layer came
    came = np.zeros((n + 1, count, m + 1), np.uint8)
    came[0] = INSERT | INSERT << 2 | INSERT << 4
    for i in range(1, n + 1):
        opening = inner if i < n else np.full((1, m + 1), gap_extend, np.int32)
        opened = match + (opening + g[i - 1])
        extended = delete + gap_extend
        from_match = opened > extended
        new_delete = np.where(from_match, opened, extended)
        new_delete[:, 0] = gap_extend * i + g[0]
        from_match[:, 0] = False
        before = np.where(match > delete, np.where(match > insert, MATCH, INSERT), np.where(delete > insert, DELETE, INSERT)).astype(np.uint8)
        best = np.maximum(np.maximum(match, insert), delete)
        new_match = np.empty_like(match)
        new_match[:, 0] = never
        new_match[:, 1:] = best[:, :-1] + matrix[r[i - 1]][q]
        cost = gap_extend + g[i]
        start = new_match[:, :-1] + (opening[:, 1:] + g[i])
        run = np.empty_like(match)
        run[:, 0] = never
        run[:, 1:] = start - cost * columns[1:]
        new_insert = np.maximum.accumulate(run, axis=1) + cost * columns
        new_insert[:, 0] = never
        inserted = start > new_insert[:, :-1] + cost
        code = np.full((count, m + 1), DELETE | INSERT << 2, np.uint8)
        code[:, 1:] = before[:, :-1] | np.where(inserted, MATCH, INSERT).astype(np.uint8) << 2
        came[i] = code | np.where(from_match, MATCH, DELETE).astype(np.uint8) << 4
        match, insert, delete = new_match, new_insert, new_delete
    rows = np.arange(count)
    a, b, c = match[rows, lengths], insert[rows, lengths], delete[rows, lengths]
    layer = np.where(a > c, np.where(a > b, MATCH, INSERT), np.where(c > b, DELETE, INSERT))
    i, j = np.full(count, n), lengths.copy()
    read, ref, live = np.zeros((n + m, count), np.uint8), np.zeros((n + m, count), np.uint8), np.ones(count, bool)
    gap, step = ord("-"), 0
    while live.any():
        layer = np.where(i == 0, INSERT, np.where(j == 0, DELETE, layer))
        down, right = live & (layer != INSERT), live & (layer != DELETE)
        read[step] = np.where(live, np.where(right, q[rows, np.maximum(j - 1, 0)], gap), 0)
        ref[step] = np.where(live, np.where(down, r[np.maximum(i - 1, 0)], gap), 0)
        code = came[i, rows, j]
        layer = np.where(layer == MATCH, code & 3, np.where(layer == INSERT, code >> 2 & 3, code >> 4 & 3))
        i, j = i - down, j - right
        live, step = (i > 0) | (j > 0), step + 1
    equal = ((read == ref) & (read > 0)).sum(axis=0).tolist()
    lengths = (read > 0).sum(axis=0).tolist()
    for k in range(count):
        w = lengths[k]
        yield read[:w, k][::-1].tobytes().decode(), ref[:w, k][::-1].tobytes().decode(), round(100 * equal[k] / float(w), 3)


ALIGNED = T.StructType([T.StructField("ref_name", T.StringType()), T.StructField("ref_idx", T.IntegerType()), T.StructField("aln_seq", T.StringType()), T.StructField("aln_ref", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("min_score", T.DoubleType()), T.StructField("strand", T.StringType())])


def _spread(reads: DataFrame, seq: str) -> DataFrame:
    """Few bytes but much work: a fixed number of partitions isn't merged into one for its size."""
    spark = reads.sparkSession
    return reads.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), seq)


def _wanted(seqs: list[str], ref: dict, seed_min: int) -> tuple[list[bool], list[bool]]:
    """Which reads are aligned forward, and which turned: with more than ``seed_min`` seeds of one strand and none of the other only that one is."""
    fw = [sum(x in s for x in ref.get("fw_seeds", ())) for s in seqs]
    rv = [sum(x in s for x in ref.get("rc_seeds", ())) for s in seqs]
    return [not (b > seed_min and a == 0) for a, b in zip(fw, rv, strict=True)], [not (a > seed_min and b == 0) for a, b in zip(fw, rv, strict=True)]


def aligned_reads(reads: DataFrame, refs: list[dict], gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, seq: str = "seq", matrix: np.ndarray | None = None, seed_min: int = SEED_MIN) -> DataFrame:
    """``reads`` with ``aligned``: an array with an entry for every reference, in their order, with the better strand (forward at equal scores).

    ``refs`` are tens of rows that were built on the driver: name, sequence, incentive, min_score, fw_seeds, rc_seeds. With more than
    ``seed_min`` seeds of one strand and none of the other, only that strand is aligned. Reads should be distinct: the work is per row.
    """
    names, types = [c for c in reads.columns if c != "aligned"], reads.drop("aligned").schema
    spark = reads.sparkSession
    reads = _spread(reads.select(*names), seq)
    given = spark.sparkContext.broadcast((refs, scoring_matrix() if matrix is None else matrix))

    def f(batches):
        refs, matrix = given.value
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                seqs = [(s or "").upper() for s in part.column(part.schema.get_field_index(seq)).to_pylist()]
                turned, cells = [rc(s) for s in seqs], []
                for idx, ref in enumerate(refs):
                    ahead, back = _wanted(seqs, ref, seed_min)
                    incentive = np.asarray(ref["incentive"])
                    found: list = [None] * len(seqs)
                    for side, wanted, strand in ((seqs, ahead, "+"), (turned, back, "-")):
                        rows = [k for k, w in enumerate(wanted) if w]
                        for k, (s, t, score) in zip(rows, align([side[k] for k in rows], ref["seq"], matrix, incentive, gap_open, gap_extend), strict=True):
                            if found[k] is None or score > found[k][4]:
                                found[k] = (ref["name"], idx, s, t, score, float(ref.get("min_score", MIN_SCORE)), strand)
                    cells.append(found)
                flat = list(zip(*[cells[r][k] for k in range(len(seqs)) for r in range(len(refs))], strict=True)) or [[] for _ in kinds]
                entries = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds, strict=True)], ALIGNED.names)
                offsets = pa.array(np.arange(0, len(seqs) * len(refs) + 1, len(refs)) if refs else np.zeros(len(seqs) + 1), pa.int32())
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(offsets, entries)], [*names, "aligned"])

    return reads.mapInArrow(f, T.StructType([*types.fields, T.StructField("aligned", T.ArrayType(ALIGNED))]))


def alignments(reads: DataFrame, refs: list[dict], gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, seq: str = "seq", matrix: np.ndarray | None = None, seed_min: int = SEED_MIN) -> DataFrame:
    """A row for every row of ``reads`` and every reference (see ``aligned_reads``)."""
    found = aligned_reads(reads, refs, gap_open, gap_extend, seq, matrix, seed_min)
    return found.withColumn("_x", F.explode("aligned")).select(*[c for c in found.columns if c != "aligned"], "_x.*")


def _best(per: DataFrame, key: list[str]) -> DataFrame:
    """Of each row's alignments (array ``aligned``, in reference order) those that count, a row each."""
    counts = F.filter("aligned", lambda x: x["score"] > x["min_score"])
    per = per.withColumn("_best", F.array_max(F.transform(counts, lambda x: x["score"]))).where("_best IS NOT NULL")
    per = per.withColumn("_first", F.array_min(F.transform(F.filter(counts, lambda x: x["score"] == F.col("_best")), lambda x: x["ref_idx"])))
    tied = F.filter("aligned", lambda x: (x["score"] == F.col("_best")) & (x["ref_idx"] >= F.col("_first")))
    rows = per.select(*key, tied.alias("_tied")).select(*key, F.size("_tied").alias("n_best"), F.posexplode("_tied").alias("nth", "_x"))
    return rows.select(*key, "_x.*", "n_best", "nth")


def common_length(reads: list[str], ref: str) -> np.ndarray:
    """The length of each read's longest common subsequence with the reference, in bits of 64-bit words for all reads at once.

    One bit a reference base; a base of the reads clears the bits at which the subsequence grows (an addition whose carries run to the next free base)."""
    n, words = len(ref), -(-len(ref) // 64) or 1
    holds = np.zeros((256, words), np.uint64)
    for k, c in enumerate(ref.encode()):
        holds[c, k // 64] |= np.uint64(1 << k % 64)
    width = max(map(len, reads), default=0)
    q = np.frombuffer("".join(s.ljust(width, "\0") for s in reads).encode("latin-1", "replace"), np.uint8).reshape(len(reads), width)
    free = np.full((words, len(reads)), ~np.uint64(0))
    for j in range(width):
        here = holds[q[:, j]]
        carry = np.zeros(len(reads), bool)
        for w in range(words):
            v, m = free[w], here[:, w]
            added = v + (v & m)
            over = added < v
            added += carry
            carry = over | (carry & (added == 0))
            free[w] = added | (v & ~m)
    used = np.array([(1 << min(64, n - 64 * w)) - 1 for w in range(words)], np.uint64)
    return np.bitwise_count(~free & used[:, None]).sum(0).astype(np.int64)


def best_alignments(reads: DataFrame, refs: list[dict], gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND, seq: str = "seq", matrix: np.ndarray | None = None, seed_min: int = SEED_MIN) -> DataFrame:
    """``best_references`` of the rows of ``reads``, aligned and chosen in one step, so that only what counts leaves it.

    Equal columns of an alignment are a common subsequence, and it has no fewer columns than the longer of its two sequences has bases. This bounds a score before anything is
    aligned: each read is aligned where its bound is highest, and then only where the bound reaches the score that was found."""
    names, types = [c for c in reads.columns if c not in (*ALIGNED.names, "n_best", "nth")], dict(reads.dtypes)
    spark = reads.sparkSession
    reads = _spread(reads.select(*names), seq)
    given = spark.sparkContext.broadcast((refs, scoring_matrix() if matrix is None else matrix))
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", ref_name string, ref_idx int, aln_seq string, aln_ref string, score double, min_score double, strand string, n_best int, nth int"

    def f(batches):
        refs, matrix = given.value
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            for start in range(0, batch.num_rows if refs else 0, 512):
                part = batch.slice(start, 512)
                seqs = [(s or "").upper() for s in part.column(part.schema.get_field_index(seq)).to_pylist()]
                sides = seqs, [rc(s) for s in seqs]
                lengths, found = np.array([len(s) for s in seqs]), [{} for _ in seqs]
                bound = np.full((2 * len(refs), len(seqs)), -np.inf)
                for idx, ref in enumerate(refs):
                    for t, wanted in enumerate(_wanted(seqs, ref, seed_min)):
                        rows = np.flatnonzero(wanted)
                        if len(rows):
                            most = common_length([sides[t][k] for k in rows.tolist()], ref["seq"])
                            bound[2 * idx + t, rows] = 100 * most / np.maximum(np.maximum(lengths[rows], len(ref["seq"])), 1) + 0.001

                def run(asked, sides=sides, found=found):
                    for at in np.flatnonzero(asked.any(1)).tolist():
                        idx, t, rows = at // 2, at % 2, np.flatnonzero(asked[at]).tolist()
                        ref = refs[idx]
                        for k, (s, u, score) in zip(rows, align([sides[t][k] for k in rows], ref["seq"], matrix, np.asarray(ref["incentive"]), gap_open, gap_extend), strict=True):
                            known = found[k].get(idx)
                            if known is None or score > known[4] or (score == known[4] and not t):
                                found[k][idx] = (ref["name"], idx, s, u, score, float(ref.get("min_score", MIN_SCORE)), "+-"[t])

                highest = np.arange(len(bound))[:, None] == bound.argmax(0)
                run(highest & (bound > -np.inf))
                sure = np.array([max((x[4] for x in cells.values() if x[4] > x[5]), default=-np.inf) for cells in found])
                run((bound >= sure) & (bound > -np.inf) & ~highest)
                rows, kept = [], []
                for k, cells in enumerate(found):
                    counted = [x for x in cells.values() if x[4] > x[5]]
                    if counted:
                        best = max(x[4] for x in counted)
                        first = min(x[1] for x in counted if x[4] == best)
                        tied = [cells[i] for i in sorted(cells) if cells[i][4] == best and i >= first]
                        rows += [(*x, len(tied), nth) for nth, x in enumerate(tied)]
                        kept += [k] * len(tied)
                if rows:
                    chosen = part.take(pa.array(kept))
                    yield pa.record_batch([*chosen.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [*names, *ALIGNED.names, "n_best", "nth"])

    return reads.mapInArrow(f, schema)


def best_references(aligned: DataFrame, key: list[str]) -> DataFrame:
    """Of each read's alignments those with its best score, if that is above the minimum; ``n_best`` tells how many references tie, ``nth`` which of
    them (from 0, in reference order) a row is.

    A reference counts if its score exceeds its own minimum; once one does, later ones (in reference order) with the same score join it.
    """
    rest = [c for c in aligned.columns if c not in (*key, "ref_idx")]
    return _best(aligned.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ref_idx", *rest))).alias("aligned")), key)
