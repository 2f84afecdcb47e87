"""Exact k-means over whole numbers, with annulus search for the nearest centroid.

Centroids are sorted by norm.  A vector's distance to the centroid nearest in
norm bounds its distance to the nearest one from above; by the triangle
inequality only centroids whose norm lies within that bound of the vector's
norm can be as near.  Binary search finds this annulus, widened by more than the
rounding error of the norms, so that ties on its edge stay inside; all in it
are compared by exact squared distances, ties going to the smaller number.

A round is one pass over the vectors: every task holds the centroids, keeps
exact sums of its vectors by cluster, and gives them away once, at its end.
Spark adds them up.  No vector is shuffled or written; vectors are read and
rounded anew in each round, and a lost task is simply run again.

Defined results: vectors that are null, of another length, or hold null, NaN or
infinite components take no part; vectors without vec_id do, but seed only after
all others; seeds with the same hash, that is, of one vec_id, go by their
components; with fewer vectors than ``k`` there are fewer centroids; whole
numbers of any size are compared and summed exactly, but a distance or inertia beyond
64 bits is given as the largest of 64 bits; repeated rows each count and get a
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialised, table
from .vectors import SUMS, ExactSums, finite, matrix, total

LARGEST = (1 << 63) - 1


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit numbers where all fit, else as Python's."""
    x = x.astype(np.float64)
    if np.abs(x).max(initial=0) * scale < 1 << 52:
        return np.floor(x * scale).astype(np.int64)
    exact = np.frompyfunc(lambda v: int(v) * scale if abs(v) >= 1 << 52 else math.floor(v * scale), 1, 1)
    return exact(x).astype(object)


class Annulus:
    """Centroids sorted by norm."""

    def __init__(self, centroids: list[list[int]]):
        squares = [sum(v * v for v in c) for c in centroids]
        self.number = sorted(range(len(centroids)), key=lambda j: (squares[j], j))
        self.centroids = [centroids[j] for j in self.number]
        self.squares = [squares[j] for j in self.number]
        self.largest = max((abs(v) for c in centroids for v in c), default=0)
        self.roots = [math.isqrt(s) for s in self.squares]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid."""
        most = max(self.largest, int(np.abs(x).max(initial=0)))
        size = 4 * x.shape[1] * most * most  # no term or sum below is larger
        if x.dtype == object or size >= 1 << 62:
            found = [self._nearest_of(list(map(int, row))) for row in x]
            return np.array([f[0] for f in found], np.int64), np.array([min(f[1], LARGEST) for f in found], np.int64)
        x = x.astype(np.float64 if size < 1 << 52 else np.int64)  # whole numbers below 2^52 are exact as floats
        centroids = np.array(self.centroids).astype(x.dtype)
        squares = np.array(self.squares).astype(x.dtype)
        own, norms = (x * x).sum(1), np.sqrt(np.array(self.squares, np.float64))
        norm = np.sqrt(own.astype(np.float64))
        above = np.minimum(np.searchsorted(norms, norm), len(norms) - 1)
        below = np.maximum(above - 1, 0)
        start = np.where(norm - norms[below] <= np.abs(norms[above] - norm), below, above)
        numbers = np.array(self.number)
        best, distance = numbers[start], own + squares[start] - 2 * (x * centroids[start]).sum(1)
        bound = np.sqrt(distance.astype(np.float64))
        slack = 1e-9 * (norm + bound + 1)  # far more than the norms' rounding error
        low = np.searchsorted(norms, norm - bound - slack, "left")
        high = np.searchsorted(norms, norm + bound + slack, "right")
        for j in range(len(norms)):
            rows = np.flatnonzero((low <= j) & (j < high) & (start != j))
            if len(rows):
                d = own[rows] + squares[j] - 2 * (x[rows] @ centroids[j])
                better = (d < distance[rows]) | ((d == distance[rows]) & (numbers[j] < best[rows]))
                rows = rows[better]
                distance[rows], best[rows] = d[better], numbers[j]
        return best, distance.astype(np.int64)

    def _nearest_of(self, row: list[int]) -> tuple[int, int]:
        """The same for one row of numbers of any size; whole roots are at most one too small."""
        to = lambda j: sum((a - b) * (a - b) for a, b in zip(row, self.centroids[j], strict=True))
        norm = math.isqrt(sum(v * v for v in row))
        at = min(bisect_left(self.roots, norm), len(self.roots) - 1)
        bound = math.isqrt(to(at)) + 3
        inside = range(bisect_left(self.roots, norm - bound), bisect_right(self.roots, norm + bound))
        distance, number = min((to(j), self.number[j]) for j in inside)
        return number, distance


def seeds(vectors: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The whole-number components of the ``k`` vectors whose salted ids have the smallest hashes."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    rows = hashed.orderBy(F.col("hash").asc_nulls_last(), "embedding").limit(k).collect()
    return [whole(np.array([r.embedding]), scale)[0].tolist() for r in rows]


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each of ``vectors``, which has vec_id and embedding."""
    spark = vectors.sparkSession
    bounded_batches(spark, 8192)
    fine = finite() & (F.size("embedding") == width)
    vectors = vectors.filter(fine).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    centroids = seeds(vectors, k, scale, salt)

    def summed(search: Annulus):
        def run(batches):
            sums = ExactSums(len(search.centroids), width + 1)  # the last column counts
            for batch in batches:
                x = whole(matrix(batch.column(0), width), scale)
                best, _ = search.nearest(x)
                x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
                for j in np.unique(best).tolist():
                    sums.add(j, x[best == j])
            yield sums.batch()

        return run

    for _ in range(rounds if centroids else 0):
        sums = total(vectors.select("embedding").mapInArrow(summed(Annulus(centroids)), SUMS))
        for j in range(len(centroids)):
            if n := sums.get((j, width), 0):
                centroids[j] = [sums.get((j, d), 0) // n for d in range(width)]

    def assigned(batches):
        for batch in batches:
            best, distance = search.nearest(whole(matrix(batch.column(1), width), scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    search = Annulus(centroids)
    found = materialised(vectors.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "assigned")
    capped = lambda c: F.least(c, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    exact = F.col("distance").cast("decimal(19,0)")
    by_cluster = found.groupBy("cluster").agg(F.sum(exact).cast("decimal(38,0)").alias("s")).collect()  # a row for each centroid
    rows = [(r.cluster, int(r.s), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in by_cluster]
    whole_sum = min(sum(r[1] for r in rows), LARGEST)
    facts = spark.createDataFrame([(j, min(s, LARGEST), whole_sum, h) for j, s, h in rows], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows are broadcast


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of 40 centroids over all vectors of 64 components."""
    return clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _rounds(rounds: int) -> str:
    """SQL of the rounds' centroids."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
    SELECT row, vec_id, x, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
        SELECT row, vec_id, x, c, CAST(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM fine, c{i})
    GROUP BY row, vec_id, x)""")
        if i < rounds:
            out.append(f"""c{i + 1} AS MATERIALIZED (
    SELECT c, coalesce(any_value(m), any_value(y)) AS y FROM c{i} LEFT JOIN (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
            SELECT cluster, i, sum(v) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY cluster, i)
        GROUP BY cluster) ON cluster = c GROUP BY c)""")
    return ",\n".join(out)


OP13_SQL = f"""
WITH fine AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS INTEGER) AS c, x AS y FROM fine QUALIFY c < 40
), {_rounds(5)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c = cluster
"""
