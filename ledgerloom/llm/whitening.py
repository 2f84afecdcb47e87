"""Embedding whitening by LOBPCG with distributed covariance products.

Entries become whole numbers.  Statistics are those of the fit list, every
distinct vector once: equal vectors are merged before they are shuffled, so
copies cost nothing.  Each iteration of ``lobpcg.largest`` is one pass over the fit list: a
task centres its rows exactly, as n * x - S over whole numbers, multiplies
them with the block, and gives one block of sums away; Spark adds the
blocks.  The covariance itself is never formed.  The driver holds a few blocks of
one column for each component and guard vector.  A last pass measures the covariance of the whitened
fit list against the identity.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped; rows without vec_id stay; a shorter vector, an empty one too,
counts as padded with entries of zero; entries beyond 2^62 after scaling
become 2^62; deviations are exact, those beyond 64 bits are
given as the largest of 64 bits; components with an eigenvalue of zero, to
rounding, cannot be scaled and have no rows, so a table with one distinct vector gives none;
repeated rows each get theirs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialised, table
from .lobpcg import largest
from .vectors import SUMS, ExactSums, finite, matrix, total

LARGEST = (1 << 63) - 1
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and whole numbers floor(scale * c) of the rows that take part."""
    most = F.lit(float(1 << 62))
    x = F.transform("embedding", lambda c: F.floor(F.greatest(-most, F.least(most, c.cast("double") * scale))).cast("long"))
    return vectors.filter(finite()).select(F.col("vec_id").cast("long"), x.alias("x"))


class Centre:
    """Rows less their mean: n * x - S exactly, divided by n where floats are wanted."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.most = max(map(abs, sums), default=0)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as 64-bit numbers, or Python's where they need more."""
        if self.n * int(np.abs(x).max(initial=0)) + self.most < LARGEST:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, exact: np.ndarray) -> np.ndarray:
        """The sum of squares of each row."""
        if exact.dtype != object and int(np.abs(exact).max(initial=0)) ** 2 * exact.shape[1] < LARGEST:
            return (exact * exact).sum(1)
        return np.array([min(sum(int(v) ** 2 for v in row), LARGEST) for row in exact], np.int64)

    def floats(self, exact: np.ndarray) -> np.ndarray:
        return (exact / self.n).astype(np.float64)


def whitened(vectors: DataFrame, count: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Rows of WHITENED for each row of ``vectors``, which has vec_id and embedding, and each component up to ``count``.

    ``shift`` is what is added to each whole number; it moves no result, so sums are kept without it.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 4096)
    rows = scaled(vectors, scale)
    fit = materialised(rows.select("x").distinct(), "fit")
    width = fit.agg(F.max(F.size("x"))).first()[0] or 0

    def summed(batches):
        sums = ExactSums(1, width + 1)  # the last column counts
        for batch in batches:
            x = matrix(batch.column(0), width)
            sums.add(0, np.concatenate((x, np.ones((len(x), 1), np.int64)), 1))
        yield sums.batch()

    padded = width and fit.filter(F.size("x") < width).limit(1).count()
    if padded:  # vectors that padding makes equal are one
        zeros = F.greatest(F.lit(width) - F.size("x"), F.lit(0))
        fit = materialised(fit.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), zeros)).alias("x")).distinct(), "fit")
    sums = total(fit.mapInArrow(summed, SUMS)) if width else {}
    centre = Centre(sums.get((0, width), 0), [sums.get((0, d), 0) for d in range(width)])

    def added(block: np.ndarray, inner) -> np.ndarray:
        """Sums over the fit list of what ``inner`` makes of each batch's centred rows."""

        def run(batches):
            out = 0.0
            for batch in batches:
                if batch.num_rows:
                    out = out + inner(centre.floats(centre.exact(matrix(batch.column(0), width))), block)
            flat = np.ravel(out) if np.ndim(out) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "value"])

        found = fit.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(found))
        for r in found:
            out[r.place] = r.value
        return out

    def product(block: np.ndarray) -> np.ndarray:
        return added(block, lambda c, b: c.T @ (c @ b)).reshape(width, -1) / centre.n

    values, basis, trace, error = np.zeros(0), np.zeros((width, 0)), 0.0, 0.0
    if width and centre.n:
        trace = float(added(np.zeros(0), lambda c, _: (c * c).sum(0)).sum()) / centre.n
        if trace > 0:
            values, basis = largest(product, width, min(count, width))
            keep = values > 1e-12 * values[0]
            values, basis = values[keep], basis[:, keep]
            basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(len(values))] < 0, -1, 1)  # the largest entry is positive
    scaled_basis = basis / np.sqrt(values)
    k = len(values)
    if not k:
        return spark.createDataFrame([], WHITENED)
    inner = added(scaled_basis, lambda c, b: (c @ b).T @ (c @ b)).reshape(k, k) / centre.n
    error = float(np.abs(inner - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            n = batch.num_rows
            exact = centre.exact(matrix(batch.column(1), width))
            every = lambda a: np.repeat(a, k)
            columns = [
                batch.column(0).take(pa.array(every(np.arange(n)))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, centre.n, np.int64)),
                pa.array(every(centre.deviation(exact))),
                pa.array((centre.floats(exact) @ scaled_basis).ravel()),
                pa.array(np.tile(values / trace, n)),
                pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, WHITENED)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every finite vector."""
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
