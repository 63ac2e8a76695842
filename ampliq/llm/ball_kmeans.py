"""Exact k-means by balls: each cluster is its centroid and a radius, and only clusters whose balls can reach a member are compared with it.

Vectors are turned into integers, so that all distances and sums are exact. They lie in blocks of a table; a round reads the blocks, moves members and
writes the blocks anew with their assignments, and beside each block the count, sum and largest distance of its members by cluster, from which the next centroids
are summed reading those columns alone. Only k centroids and radii reach the driver, whatever the number of vectors.

In a round the members of cluster i lie within a radius of its centroid that is at most the largest distance found in the round before plus the centroid's shift.
Clusters whose centroid is within twice that radius are its neighbours; all others are never looked at. The neighbours' distances cut the ball into a stable core, whose members are
nearer to i than half the distance of any neighbour and stay, and annuli around it: members of the k-th annulus are compared exactly with the k nearest
neighbours. All tests are on integers and leave ties in, so the result is that of comparing everything.

A vector takes part if it has the asked number of components, none null or non-finite. A row without an id takes part but is no seed. Rows that repeat an id are vectors of their
own (of equal hashes the smaller vector is the earlier seed). With fewer vectors than clusters there are fewer clusters; of equal seeds the later stay empty; an empty table
gives no rows. Components beyond ``LARGEST`` as integers are refused: their squared distances need not fit a long. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, table, written

K = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = "3"
BLOCK = 1024
#: Four times 64 squared differences of numbers within it fit a long.
LARGEST = 1 << 26

_BLOCKS = "ids array<long>, x binary, own binary, distances binary, parts array<struct<cluster int, n long, farthest long, sums array<long>>>"


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers floor(scale * x)."""
    v = F.col("embedding")
    whole = (F.size(v) == dimensions) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    # a component too large for a long would be cut by the cast; it is refused here
    fits = lambda x: F.when(F.abs(x) <= LARGEST, x).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}: its distances need not fit a long")))
    rows = vectors.where(v.isNotNull() & F.coalesce(whole, F.lit(False)))
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(fits(x.cast("double") * scale)).cast("int")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _block(ids: pa.Array, x: np.ndarray, own: np.ndarray, distances: np.ndarray, parts: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([
        ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("own", pa.binary()), ("distances", pa.binary()),
        ("parts", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("farthest", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
    ])
    row = [[ids], [x.astype("<i4").tobytes()], [own.astype("<i4").tobytes()], [distances.astype("<i8").tobytes()], [parts]]
    return pa.record_batch([pa.array(c, t) for c, t in zip(row, schema.types, strict=True)], schema=schema)


def in_blocks(rows: DataFrame) -> DataFrame:
    """The vectors in blocks, all in the ball of the first cluster."""

    def f(batches):
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                n = part.num_rows
                yield _block(part.column(0).to_pylist(), _matrix(part.column(1)), np.zeros(n, np.int64), np.zeros(n, np.int64), [])

    return rows.mapInArrow(f, _BLOCKS)


def move(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, apart: np.ndarray, reach: list[int | None]) -> tuple[np.ndarray, np.ndarray, int]:
    """Members ``x`` of the clusters ``own`` -> nearest cluster (ties: the smaller number), squared distance, and how many distances were computed.

    apart: squared distances of the centroids; reach: a bound of four times each ball's squared radius (None: any)."""
    near, least, computed = own.copy(), np.zeros(len(x), np.int64), len(x)
    for i in np.unique(own).tolist():
        members = np.flatnonzero(own == i)
        d = ((x[members] - centroids[i]) ** 2).sum(1)
        order = np.argsort(apart[i], kind="stable")
        neighbours = np.array([j for j in order.tolist() if j != i and (reach[i] is None or apart[i][j] <= reach[i])], np.int64)
        annulus = np.searchsorted(apart[i][neighbours], 4 * d, side="right")  # 0: the stable core
        best, at = d, np.full(len(members), i)
        for k, j in enumerate(neighbours.tolist()):
            inside = np.flatnonzero(annulus > k)
            if not len(inside):
                break
            other = ((x[members[inside]] - centroids[j]) ** 2).sum(1)
            computed += len(inside)
            wins = (other < best[inside]) | ((other == best[inside]) & (j < at[inside]))
            best[inside[wins]], at[inside[wins]] = other[wins], j
        near[members], least[members] = at, best
    return near, least, computed


def moved(blocks: DataFrame, centroids: np.ndarray, apart: np.ndarray, reach: list[int | None]) -> DataFrame:
    """The blocks with their members in the nearest clusters, and what each adds to these."""
    dimensions = centroids.shape[1]

    def f(batches):
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["x"], "<i4").astype(np.int64).reshape(-1, dimensions)
                near, least, _ = move(x, np.frombuffer(row["own"], "<i4").astype(np.int64), centroids, apart, reach)
                parts = [{"cluster": j, "n": int(m.sum()), "farthest": int(least[m].max()), "sums": x[m].sum(0).tolist()} for j in np.unique(near).tolist() for m in [near == j]]
                yield _block(row["ids"], x, near, least, parts)

    return blocks.mapInArrow(f, _BLOCKS)


def _totals(blocks: DataFrame) -> tuple[dict[int, tuple[int, int]], dict[int, list[int]]]:
    """Of each cluster the count and largest squared distance, and the sums of its components: k rows and k rows a dimension."""
    parts = blocks.select(F.explode("parts").alias("p")).select("p.*")
    sized = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("farthest").alias("farthest"))
    sums = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("sum")).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "sum"))).alias("sums"))
    rows = sized.join(sums, "cluster").collect()
    return {r["cluster"]: (r["n"], r["farthest"]) for r in rows}, {r["cluster"]: [s["sum"] for s in r["sums"]] for r in rows}


def _apart(centroids: np.ndarray) -> np.ndarray:
    return ((centroids[:, None] - centroids[None]) ** 2).sum(2)


def _four_squares(radius: int, shift: int) -> int:
    """An integer no less than (2 * (sqrt(radius) + sqrt(shift))) ** 2."""
    return 4 * (math.isqrt(radius) + math.isqrt(shift) + 2) ** 2


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """The vectors in blocks, assigned to the centroids after ``rounds`` rounds, and these centroids.

    Rounds end early where no centroid moves any more, as nothing would change. Each round's blocks are a written table; the one before it is deleted then."""
    spark = vectors.sparkSession
    rows = written(integers(vectors, dimensions, scale), spark, "integers")
    named = rows.where(F.col("vec_id").isNotNull())
    seeds = named.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in seeds], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        return in_blocks(rows.limit(0)), centroids
    blocks, reach = in_blocks(rows), [None] * len(centroids)
    for _ in range(rounds):
        last, blocks = blocks, written(moved(blocks, centroids, _apart(centroids), reach), spark, "balls")
        discard(last)
        sized, sums = _totals(blocks)
        now = np.array([[s // sized[j][0] for s in sums[j]] if j in sized else centroids[j] for j in range(len(centroids))], np.int64)
        shift = ((now - centroids) ** 2).sum(1).tolist()
        reach = [_four_squares(sized[j][1], shift[j]) if j in sized else 0 for j in range(len(centroids))]
        centroids = now
        if not any(shift):
            break
    last, blocks = blocks, written(moved(blocks, centroids, _apart(centroids), reach), spark, "balls")
    discard(last)
    return blocks, centroids


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    blocks, centroids = ball_kmeans(vectors, k, rounds, dimensions, scale, seed)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def f(batches):
        for b in batches:
            for row in b.select(["ids", "own", "distances"]).to_pylist():
                own, distances = np.frombuffer(row["own"], "<i4"), np.frombuffer(row["distances"], "<i8")
                yield pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(own), pa.array(distances), pa.array([names[j] for j in own.tolist()], pa.string())], ["vec_id", "cluster", "distance", "centroid_sha256"])

    rows = blocks.select("ids", "own", "distances").mapInArrow(f, "vec_id long, cluster int, distance long, centroid_sha256 string")
    sums = {r["cluster"]: r["total"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    of_cluster = F.element_at(F.create_map(*[F.lit(x) for pair in sums.items() for x in pair]), F.col("cluster")) if sums else F.lit(0)
    return rows.select("vec_id", "cluster", "distance", of_cluster.cast("long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every round compares every vector with every centroid."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
x AS MATERIALIZED (
  SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM kept),
seeds AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {K}),
c0 AS MATERIALIZED (
  SELECT c, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM seeds)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS (
  SELECT x.i, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c ON x.p = c.p GROUP BY x.i, c.c),
a{r} AS MATERIALIZED (
  SELECT i, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, c) = 1)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (
  SELECT a.c, x.p, sum(x.x) AS s, count(*) AS n FROM a{r} a JOIN x ON a.i = x.i GROUP BY a.c, x.p),
c{r + 1} AS MATERIALIZED (
  SELECT c.c, c.p, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - (((m.s % m.n) + m.n) % m.n)) / m.n AS BIGINT) END AS x FROM c{r} c LEFT JOIN m{r} m ON c.c = m.c AND c.p = m.p)""")
    return f"""
WITH {",".join(steps)},
names AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS name FROM c{ROUNDS} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, n.name AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k ON a.i = k.i JOIN names n ON a.c = n.c
"""


OP12_SQL = _sql()
