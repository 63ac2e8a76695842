"""Nearest neighbours by additive quantisation.

A vector's direction is approximated by a multiple of the sum of one code vector from each of ``BOOKS`` codebooks over all dimensions. Codebooks are fitted
on a bounded sample (at most ``SAMPLE`` vectors, those with the smallest hashes of their ids) by residual k-means, each on what the ones before leave.
Every vector is encoded by beam search and stored as its codes, its length, the multiple that comes nearest to it and how far that stays away from it.

Equal vectors form one class with its smallest ids, so that copies don't fill a query's list. Codes are packed into blocks with their vectors, queries into
blocks of fixed size, and every block of queries meets every block of codes: tables of inner products of query and code vectors, summed by lookup, estimate
all scores. By Cauchy and Schwarz an estimate is off by no more than the query's length times what the approximation leaves. Classes that can't reach the last place
of a query's list within that bound are passed over; the others are scored in double precision on the original vectors. So the result
doesn't depend on how well the codebooks fit (only the work does), and the index, the scan and the lists of a task are bounded by the sizes of its two splits. The lists of
all tasks are merged and the best classes expanded to their ids.

Vectors that are null, zero, of another length than most, or hold null or non-finite components, and rows without an id take no part, as
query or candidate. An id that occurs with several vectors is a candidate with each and a query with the smallest. Repeated rows count once. An
empty table gives no rows; a query with fewer candidates than asked for gets them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import table, written

BOOKS, CODES, BEAM = 24, 256, 4
SAMPLE = 16384
TOP = 20
#: Vectors in a block and bytes that they may take, classes that a step scores, queries in a block, blocks of queries in a split.
CODE_BLOCK, BLOCK_BYTES, STEP = 8192, 4 << 20, 2048
QUERY_BLOCK, QUERY_SPLIT = 256, 16
#: Pairs whose products are added up together.
PAIRS = 65536


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The codes of each row of ``x`` by beam search over the codebooks in turn."""
    books, size, _ = codebooks.shape
    n = len(x)
    norms = (codebooks**2).sum(axis=2)
    residual, codes, cost = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
    for m in range(books):
        b = residual.shape[1]
        after = cost[:, :, None] + norms[m] - 2 * (residual.reshape(n * b, -1) @ codebooks[m].T).reshape(n, b, size)
        flat = after.reshape(n, b * size)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        cost = np.take_along_axis(flat, best, 1)
        parent, code = best // size, best % size
        rows = np.arange(n)[:, None]
        residual = residual[rows, parent] - codebooks[m][code]
        codes = np.concatenate([codes[rows, parent], code[:, :, None]], axis=2)
    return codes[np.arange(n), cost.argmin(axis=1)]


def fit(x: np.ndarray, books: int = BOOKS, size: int = CODES, seed: int = 7) -> np.ndarray:
    """Codebooks (books, size, dimensions) for the rows of ``x``."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    size = min(size, max(1, len(x)))
    residual, found = x.copy(), []
    for _ in range(books):
        c = residual[rng.choice(len(x), size, replace=False)].copy()
        for _ in range(8):
            near = ((c**2).sum(1) - 2 * residual @ c.T).argmin(1)
            n = np.bincount(near, minlength=size)
            sums = np.zeros_like(c)
            np.add.at(sums, near, residual)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], residual[rng.integers(len(x), size=size)])
        near = ((c**2).sum(1) - 2 * residual @ c.T).argmin(1)
        residual = residual - c[near]
        found.append(c)
    return np.stack(found)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, each once."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite).select("vec_id", v.alias("vector"))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (common["n"] if common else 0)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``x`` at length one, and their lengths."""
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1, keepdims=True)
    x = x / most
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / norm, (most * norm)[:, 0]


def encoded(classes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Blocks of the classes (class, members, vector): numbers, first and second ids (alike if there is one), codes, lengths, multiples, errors of unit vectors, vectors."""
    books = classes.sparkSession.sparkContext.broadcast(codebooks)

    def f(batches):
        for b in batches:
            if not b.num_rows:
                continue
            kept = _matrix(b.column(3))
            size = max(STEP // 8, min(CODE_BLOCK, BLOCK_BYTES // (kept.itemsize * kept.shape[1])))
            for start in range(0, b.num_rows, size):
                x = kept[start : start + size]
                u, norm = _directions(x)
                codes = np.concatenate([encode(u[k : k + 1024].astype(np.float32), books.value) for k in range(0, len(u), 1024)])
                rebuilt = sum(books.value[m][codes[:, m]].astype(np.float64) for m in range(codes.shape[1]))
                ratio = (u * rebuilt).sum(1) / np.maximum((rebuilt**2).sum(1), 1e-24)
                error = np.linalg.norm(u - ratio[:, None] * rebuilt, axis=1)
                ids = [b.column(c).slice(start, size).to_numpy().astype("<i8") for c in range(3)]
                columns = [*ids, codes.astype("<u2"), norm.astype("<f8"), ratio.astype("<f8"), error.astype("<f8"), x.astype(x.dtype.newbyteorder("<"))]
                yield pa.record_batch([pa.array([c.tobytes()]) for c in columns], _INDEX)

    narrow = dict(classes.dtypes)["vector"] == "array<float>"
    second = F.coalesce(F.try_element_at("members", F.lit(2)), F.element_at("members", 1))
    vector = F.col("vector") if narrow else F.col("vector").cast("array<double>")
    return classes.select("class", F.element_at("members", 1), second, vector).mapInArrow(f, ", ".join(f"{c} binary" for c in _INDEX))


_INDEX = ["classes", "firsts", "seconds", "codes", "lengths", "ratios", "errors", "vectors"]


def asked_blocks(queries: DataFrame) -> DataFrame:
    """Blocks (qb, asked, q) of the queries (query_id, query)."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("qb"), "query_id", F.col("query").cast("array<double>").alias("q"))
    rows = rows.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("query_id", "q"))).alias("asked"))

    def f(batches):
        for b in batches:
            for qb, asked in zip(b.column(0), b.column(1), strict=True):
                ids, q = asked.values.field("query_id").to_numpy(), _matrix(asked.values.field("q"))
                yield pa.record_batch([pa.array([qb.as_py()]), pa.array([ids.astype("<i8").tobytes()]), pa.array([q.astype("<f8").tobytes()])], ["qb", "asked", "q"])

    return rows.mapInArrow(f, "qb long, asked binary, q binary").repartition(-(-blocks // QUERY_SPLIT))


class _Lists:
    """The best classes so far of a block of queries: numbers of queries, scores, smallest other ids and classes, in order; and the score that a class needs."""

    def __init__(self, n: int, top: int):
        self.top, self.least = top, np.full(n, -np.inf)
        self.held = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, *found: np.ndarray) -> None:
        query, score, first, number = (np.concatenate(x) for x in zip(self.held, found, strict=True))
        order = np.lexsort((number, first, -score, query))
        starts = np.searchsorted(query[order], np.arange(len(self.least)))
        place = np.arange(len(order)) - starts[query[order]]
        last = order[place == self.top - 1]
        self.least[query[last]] = score[last]
        order = order[place < self.top]
        self.held = query[order], score[order], first[order], number[order]


class _Block:
    """A block of queries with its tables."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, books: np.ndarray):
        self.ids, self.q, self.columns = ids, q, np.ascontiguousarray(q.T)
        unit, self.lengths = _directions(q)
        m, k, d = books.shape
        self.tables = np.ascontiguousarray((unit.astype(np.float32) @ books.reshape(-1, d).T).reshape(len(q), m, k).transpose(1, 2, 0))
        # what single precision can add to an estimate before it is multiplied
        self.rounding = (d + m + 8) * np.finfo(np.float32).eps * float(np.linalg.norm(books, axis=2).max(axis=1).sum())

    def meet(self, lists: _Lists, classes, firsts, seconds, codes, lengths, ratios, errors, x) -> None:
        """Adds the classes that can reach the lists."""
        estimate = sum(self.tables[m][codes[:, m]] for m in range(codes.shape[1])).T * ratios
        off = errors + np.abs(ratios) * self.rounding + 1e-9
        scale = self.lengths[:, None] * lengths
        alone = (self.ids[:, None] == firsts) & (firsts == seconds)  # nothing but the query itself
        need = lists.least
        if len(classes) >= lists.top and np.isneginf(need).any():
            low = np.where(alone, -np.inf, (estimate - off) * scale)
            need = np.maximum(need, np.partition(low, len(classes) - lists.top, axis=1)[:, len(classes) - lists.top])
        able = ~((estimate + off) * scale < need[:, None]) & ~alone
        some = np.flatnonzero(able.any(axis=0))
        if not len(some):
            return
        x = x[some].astype(np.float64)
        near = self.q @ x.T
        able = able[:, some] & ~(near + 4 * x.shape[1] * np.finfo(float).eps * scale[:, some] < need[:, None])
        query, row = np.nonzero(able)
        x, found = np.ascontiguousarray(x.T), []
        for k in range(0, len(query), PAIRS):  # products are added in the order of the components
            i, j = query[k : k + PAIRS], row[k : k + PAIRS]
            score = np.zeros(len(i))
            for d in range(len(x)):
                score += self.columns[d][i] * x[d][j]
            found.append(score)
        if found:
            row = some[row]
            lists.add(query, np.concatenate(found), np.where(firsts[row] == self.ids[query], seconds[row], firsts[row]), classes[row])


def search(index: DataFrame, asked: DataFrame, codebooks: np.ndarray, top: int = TOP, narrow: bool = True) -> DataFrame:
    """(query_id, class, first, score): the ``top`` classes of each split of ``index`` with the largest inner products for each query of the blocks ``asked``;
    ``first`` is a class's smallest id but the query's own, smaller ones are nearer at the same score."""
    books = index.sparkSession.sparkContext.broadcast(codebooks)

    def f(batches):
        lists: dict[int, tuple[np.ndarray, _Lists]] = {}
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["asked"], "<i8")
                block = _Block(ids, np.frombuffer(row["q"], "<f8").reshape(len(ids), -1), books.value)
                held = lists.setdefault(row["qb"], (ids, _Lists(len(ids), top)))[1]
                types = ["<i8", "<i8", "<i8", "<u2", "<f8", "<f8", "<f8", "<f4" if narrow else "<f8"]
                parts = [np.frombuffer(row[c], t) for c, t in zip(_INDEX, types, strict=True)]
                parts = [p.reshape(len(parts[0]), -1) if c in ("codes", "vectors") else p for c, p in zip(_INDEX, parts, strict=True)]
                for k in range(0, len(parts[0]), STEP):
                    block.meet(held, *(p[k : k + STEP] for p in parts))
        for ids, held in lists.values():
            query, score, first, number = held.held
            yield pa.record_batch([pa.array(ids[query]), pa.array(number), pa.array(first), pa.array(score)], ["query_id", "class", "first", "score"])

    return index.crossJoin(asked).mapInArrow(f, "query_id long, class long, first long, score double")


def neighbours(vectors: DataFrame, asked: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) that meets ``asked``, its nearest others."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), spark, "vectors")
    first = W.partitionBy("vector").orderBy("vec_id")
    classes = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= top + 1).groupBy("vector").agg(F.min("vec_id").alias("least"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    # an id with several vectors is the least of each: classes are told apart by a number made of id and vector
    classes = written(classes.select(F.xxhash64("least", "vector").alias("class"), "vector", "members"), spark, "classes")
    queries = rows.where(asked).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query"))
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("vector").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codebooks = fit(_directions(np.array([r["vector"] for r in sample]))[0])
    index = written(encoded(classes, codebooks), spark, "index")
    narrow = dict(classes.dtypes)["vector"] == "array<float>"
    found = written(search(index, asked_blocks(queries), codebooks, top, narrow), spark, "found")
    near = found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "first", "class"))).where(F.col("n") <= top)
    near = near.join(classes.select("class", "members"), "class").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)
