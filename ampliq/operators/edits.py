"""Edit calling on aligned pairs, and classes of reads.

Positions are 0-based on the reference. A deletion is a half-open range; an insertion is the pair of reference positions beside it;
a base read as N is no substitution. Insertions before the first and behind the last reference base are not called. A deletion that
an insertion follows at once ends at that insertion's negative mark, so it has a coordinate pair but no positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS, _PAIRS, _TEXTS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])), T.ArrayType(T.StringType())
EDITS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("all_insertion_positions", _INTS), ("all_insertion_left_positions", _INTS), ("insertion_positions", _INTS), ("insertion_coordinates", _PAIRS), ("insertion_sizes", _INTS), ("insertion_n", T.IntegerType()),
        ("all_deletion_positions", _INTS), ("all_deletion_coordinates", _PAIRS), ("deletion_positions", _INTS), ("deletion_coordinates", _PAIRS), ("deletion_sizes", _INTS), ("deletion_n", T.IntegerType()),
        ("all_substitution_positions", _INTS), ("substitution_positions", _INTS), ("all_substitution_values", _TEXTS), ("substitution_values", _TEXTS), ("substitution_n", T.IntegerType()), ("ref_positions", _INTS),
        ("irregular_ends", T.BooleanType()), ("insertions_outside_window", T.IntegerType()), ("deletions_outside_window", T.IntegerType()), ("substitutions_outside_window", T.IntegerType()),
        ("total_mods", T.IntegerType()), ("mods_in_window", T.IntegerType()), ("mods_outside_window", T.IntegerType()),
    )]
)

#: Rows whose edits are called at a time.
ROWS = 2048


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings end to end, and where each begins (one more at the end)."""
    column = column.cast(pa.string())
    if column.null_count:
        raise ValueError("an aligned sequence is missing")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _marked_runs(mark: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the runs of true values; ``first`` and ``last`` are the columns at which rows begin and end, so that none goes on over them."""
    before, behind = np.concatenate([[False], mark[:-1]]), np.concatenate([mark[1:], [False]])
    before[first] = False
    behind[last] = False
    return np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~behind) + 1


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The whole numbers of the ranges, end to end; a range whose end isn't above its start has none."""
    n = np.maximum(end - start, 0)
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class Windows:
    """Windows of references as one array of marks, and their running counts."""

    def __init__(self, windows: dict[str, list[int]]):
        self.at = {k: n for n, k in enumerate(windows)}
        sizes = [max(w, default=-1) + 1 for w in windows.values()]
        self.start, self.size = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)[:-1], np.array(sizes, np.int64)
        self.mark = np.zeros(sum(sizes) + 1, bool)
        for start, w in zip(self.start.tolist(), windows.values(), strict=True):
            self.mark[[start + p for p in w if p >= 0]] = True
        self.upto = np.concatenate([[0], np.cumsum(self.mark)])

    def holds(self, ref: np.ndarray, pos: np.ndarray) -> np.ndarray:
        size = self.size[ref]
        inside = (pos >= 0) & (pos < size)
        return inside & self.mark[self.start[ref] + np.clip(pos, 0, np.maximum(size - 1, 0))]

    def touched(self, ref: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (self.start[ref] + np.clip(x, 0, self.size[ref]) for x in (start, end))
        return self.upto[np.maximum(a, b)] > self.upto[a]


def edits_of(reads: pa.Array, refs: pa.Array, names: pa.Array, windows: Windows, either_flank: bool = False) -> pa.Array:
    """The edits of a batch of aligned pairs, all rows at once: their columns lie end to end, edits are runs of marks in them, and each list is made from
    flat values and the number of values a row."""
    (q, offsets), (r, other) = _flat(reads), _flat(refs)
    if not np.array_equal(offsets, other):
        raise ValueError("the sequences of an aligned pair differ in length")
    n, gap = len(reads), ord("-")
    length = np.diff(offsets)
    row = np.repeat(np.arange(n), length)
    first, last = offsets[:-1][length > 0], offsets[1:][length > 0] - 1
    coded = names.dictionary_encode()
    ref = np.array([windows.at[k] for k in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if n else np.empty(0, np.int64)

    based = r != gap
    count = np.concatenate([[0], np.cumsum(based)])
    seen = count[1:] - count[offsets[row]]
    at = np.where(based, seen - 1, np.where(seen > 0, -seen, -1))

    def many(values, rows, kind=pa.int32(), each=1):
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n) * each)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values, kind))

    def pairs(a, b, rows):
        return many(pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["start", "end"]), rows)

    def sums(values, rows):
        return np.bincount(rows, weights=values, minlength=n).astype(np.int64)

    sub = np.flatnonzero(based & (q != r) & (q != gap) & (q != ord("N")))
    sub_row, sub_in = row[sub], windows.holds(ref[row[sub]], at[sub])
    letters = pa.array(list(q[sub].tobytes().decode("latin-1")), pa.string())

    start, end = _marked_runs(~based, first, last)
    called = (seen[start] > 0) & (end < offsets[row[start] + 1])
    start, end = start[called], end[called]
    ins_row, left, ins_size = row[start], seen[start] - 1, end - start
    flanks = windows.holds(ref[ins_row], left), windows.holds(ref[ins_row], left + 1)
    ins_in = flanks[0] | flanks[1] if either_flank else flanks[0] & flanks[1]

    start, end = _marked_runs(q == gap, first, last)
    del_row = row[start]
    begins, ends = offsets[del_row], offsets[del_row + 1]
    a = np.where(start > begins, at[start], 0)
    b = np.where(end < ends, at[np.minimum(end, max(len(at) - 1, 0))], at[ends - 1] + 1) if len(start) else start
    del_in = windows.touched(ref[del_row], a, b)
    del_size = np.maximum(b - a, 0)

    edges = np.zeros(n, bool)
    full = length > 0
    edges[full] = (q[first] != r[first]) | (q[first] == gap) | (q[last] != r[last]) | (q[last] == gap)
    twice = lambda x: np.stack([x, x + 1], 1).reshape(-1)
    inserted, deleted = sums(ins_size[ins_in], ins_row[ins_in]), sums((b - a)[del_in], del_row[del_in])
    replaced = np.bincount(sub_row[sub_in], minlength=n)
    n_sub, n_ins, n_del = (np.bincount(x, minlength=n) for x in (sub_row, ins_row, del_row))
    total = n_ins + sums(del_size, del_row) + n_sub
    inside = replaced + deleted + inserted
    out = {
        "all_insertion_positions": many(twice(left), ins_row, each=2), "all_insertion_left_positions": many(left, ins_row),
        "insertion_positions": many(twice(left[ins_in]), ins_row[ins_in], each=2), "insertion_coordinates": pairs(left[ins_in], left[ins_in] + 1, ins_row[ins_in]),
        "insertion_sizes": many(ins_size[ins_in], ins_row[ins_in]), "insertion_n": inserted,
        "all_deletion_positions": many(_ranges(a, b), np.repeat(del_row, del_size)), "all_deletion_coordinates": pairs(a, b, del_row),
        "deletion_positions": many(_ranges(a[del_in], b[del_in]), np.repeat(del_row[del_in], del_size[del_in])), "deletion_coordinates": pairs(a[del_in], b[del_in], del_row[del_in]),
        "deletion_sizes": many((b - a)[del_in], del_row[del_in]), "deletion_n": deleted,
        "all_substitution_positions": many(at[sub], sub_row), "substitution_positions": many(at[sub][sub_in], sub_row[sub_in]),
        "all_substitution_values": many(letters, sub_row), "substitution_values": many(letters.filter(pa.array(sub_in)), sub_row[sub_in]), "substitution_n": replaced,
        "ref_positions": many(at, row), "irregular_ends": edges,
        "insertions_outside_window": n_ins - np.bincount(ins_row[ins_in], minlength=n), "deletions_outside_window": n_del - np.bincount(del_row[del_in], minlength=n),
        "substitutions_outside_window": n_sub - replaced, "total_mods": total, "mods_in_window": inside, "mods_outside_window": total - inside,
    }
    fields = [pa.field(f.name, _arrow(f.dataType)) for f in EDITS.fields]
    return pa.StructArray.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in fields], fields=fields)


def call_edits(read: str, ref: str, window: set[int], either_flank: bool = False) -> dict:
    """The edits of one aligned pair. ``either_flank``: an insertion counts with one of its flanks in the window (the older rule)."""
    return edits_of(pa.array([read]), pa.array([ref]), pa.array([""]), Windows({"": sorted(window)}), either_flank)[0].as_py()


def with_edits(pairs: DataFrame, windows: dict[str, list[int]] | str, either_flank: bool = False) -> DataFrame:
    """``pairs`` (aln_seq, aln_ref, ref_name, ...) with the column ``edits``. Windows by reference, built on the driver; or the column that has each row's own,
    the same for all rows of a reference, which is left out then."""
    own = windows if isinstance(windows, str) else None
    names = [c for c in pairs.columns if c not in ("edits", own)]
    pairs = pairs.select(*names, *([own] if own else []))
    given = None if own else pairs.sparkSession.sparkContext.broadcast(Windows(windows))

    def f(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                read, ref, name = (b.column(b.schema.get_field_index(c)) for c in ("aln_seq", "aln_ref", "ref_name"))
                if own:
                    coded, held = name.dictionary_encode(), b.column(b.schema.get_field_index(own))
                    _, firsts = np.unique(coded.indices.to_numpy(zero_copy_only=False), return_index=True)
                    known = Windows({k: held[at].as_py() for k, at in zip(coded.dictionary.to_pylist(), firsts.tolist(), strict=True)})
                else:
                    known = given.value
                yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in names), edits_of(read, ref, name, known, either_flank)], [*names, "edits"])

    return pairs.mapInArrow(f, T.StructType([*pairs.select(*names).schema.fields, T.StructField("edits", EDITS)]))


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in t.fields])
    return {T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}[type(t)]


def modified(ignore: tuple[str, ...] = ()):
    """Whether a row's edits make it a modified read; ``ignore`` names kinds that don't count."""
    out = F.lit(False)
    for kind in ("deletion", "insertion", "substitution"):
        if kind not in ignore:
            out = out | (F.col(f"edits.{kind}_n") > 0)
    return out
