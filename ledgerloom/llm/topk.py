"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to whole numbers.  A block of up to about ``block_rows``
rows holds, for each component, one bitmap over its rows for each bit.  A query
adds the slices that its own components' bits pick, weight by weight, with
carry-save adders over bitmaps.  From the sum's most significant slice downward
a set of rows that are surely among the best, and one of rows still level with
the k-th, are narrowed down.  Rows that stay level to the last slice have the
same score and go by vec_id.

Each block's slices are made once and written.  Queries form chunks of
``block_queries``; every chunk goes to every block of the index and brings back
its k best there; a query's best over all blocks are found last.  While there
are fewer blocks than ``tasks``, a block's slices go to several lanes, which
share the chunks.  What is shuffled is the index, and chunks times blocks.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows without vec_id; whole numbers beyond 2^56 count as
2^56; ranks follow exact scores, and a score beyond 64 bits is given as the
largest or smallest of 64 bits; a
shorter vector counts as padded with zeros; a candidate with the query's own
vec_id does not count; repeated query rows with equal vectors give one answer;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialised, table
from .vectors import matrix as dense

LARGEST = sys.float_info.max
INDEX = "block long, ids binary, low binary, bits binary, slices binary"


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and components of the rows that take part, whole numbers kept as doubles, which have them exactly."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # A double of 2^52 or more is whole already.
    whole = lambda v: F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)
    return rows.filter(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: whole(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v * scale)))).alias("x"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of lists as a matrix of whole numbers, padded with zeros; Python's where 64 bits are too few."""
    rows = dense(column, max(column.combine_chunks().value_lengths().to_pylist(), default=0)) if len(column) else np.zeros((0, 0))
    if np.abs(rows).max(initial=0) < 1 << 61:
        return rows.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(rows).astype(object)


def order_key(score: int) -> str:
    """A text that sorts as scores of any size do."""
    digits = f"{abs(score):x}"
    if score >= 0:
        return f"1{len(digits):04x}{digits}"
    return f"0{0xFFFF - len(digits):04x}{16 ** len(digits) - 1 + score:0{len(digits)}x}"


class BitSlices:
    """The index of one block; rows are in order of vec_id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], x[order]
        self.low = x.min(0) if len(x) else np.zeros(x.shape[1], x.dtype)
        spread = x - self.low  # below 2^62 unless Python's numbers
        self.bits = [int(v).bit_length() for v in spread.max(0)] if len(x) else [0] * x.shape[1]
        self._sizes()
        plain = np.zeros((self.first[-1], self.words * 8), np.uint8)
        for j, n in enumerate(self.bits):
            for b in range(n):
                row = np.packbits((spread[:, j] >> b & 1).astype(bool), bitorder="little")
                plain[self.first[j] + b, : len(row)] = row
        self._both(plain.view(np.uint64))

    def _sizes(self) -> None:
        self.words, self.first = -(-len(self.ids) // 64), np.cumsum([0, *self.bits])

    def _both(self, plain: np.ndarray) -> None:
        self.slices = np.concatenate((plain, ~plain))  # the second half holds the complements

    def packed(self) -> list[bytes]:
        """ids, low, bits and slices as bytes."""
        low = ",".join(map(str, self.low.tolist())).encode()
        return [self.ids.tobytes(), low, np.array(self.bits, np.int64).tobytes(), self.slices[: self.first[-1]].tobytes()]

    @classmethod
    def of(cls, ids: bytes, low: bytes, bits: bytes, slices: bytes) -> BitSlices:
        own = cls.__new__(cls)
        own.ids, own.bits = np.frombuffer(ids, np.int64), np.frombuffer(bits, np.int64).tolist()
        own.low = [int(v) for v in low.split(b",") if v]
        own._sizes()
        own._both(np.frombuffer(slices, np.uint64).reshape(int(own.first[-1]), own.words))
        return own

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of every row's score less a constant, least significant first, and the constant."""
        n = min(len(query), len(self.bits))
        weights: dict[int, list[int]] = {}
        constant, half = 0, int(self.first[-1])
        for j in range(n):
            q = int(query[j])
            constant += q * int(self.low[j])
            if q < 0:  # -a * u is a * (top - u) - a * top, and top - u has complemented slices
                constant += q * ((1 << self.bits[j]) - 1)
            for s in range(abs(q).bit_length()):
                if abs(q) >> s & 1:
                    for b in range(self.bits[j]):
                        weights.setdefault(s + b, []).append(self.first[j] + b + half * (q < 0))
        out, carried, at = [], np.zeros((0, self.words), np.uint64), 0
        while at <= max(weights, default=-1) or len(carried):
            rows = np.concatenate((self.slices[weights.get(at, [])], carried))
            carries = []
            while len(rows) > 2:
                k = len(rows) // 3
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                odd = a ^ b
                carries.append((a & b) | (c & odd))
                rows = np.concatenate((odd ^ c, rows[3 * k :]))
            if len(rows) == 2:
                carries.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else np.zeros(self.words, np.uint64))
            carried = np.concatenate(carries) if carries else carried[:0]
            at += 1
        return out, constant

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k best rows, unordered."""
        slices, constant = self.scores(query)
        level = np.zeros(self.words * 64, bool)
        level[: len(self.ids)] = self.ids != query_id
        level = np.packbits(level, bitorder="little").view(np.uint64)
        sure = np.zeros_like(level)
        count = lambda rows: int(np.bitwise_count(rows).sum())
        if count(level) > k:
            for s in reversed(slices):
                upper = level & s
                n = count(sure | upper)
                if n > k:
                    level = upper
                else:
                    sure |= upper
                    level = level & ~s
                    if n == k:
                        level = np.zeros_like(level)
                        break
        rows = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
        chosen = rows(sure)
        chosen = np.concatenate((chosen, rows(level)[: k - len(chosen)]))
        kind = np.int64 if len(slices) < 62 and abs(constant) < 1 << 62 else object  # whole numbers of any size
        scores = np.full(len(chosen), constant, kind)
        for b, s in enumerate(slices):
            scores += (s[chosen // 64] >> (chosen % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64).astype(kind) << b
        return self.ids[chosen], scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 16_384, block_queries: int = 256, tasks: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of ``vectors`` for each of ``queries``, both quantised."""
    bounded_batches(vectors.sparkSession)
    size = lambda n, each: int(max(1, -(-n // each)))
    blocks, chunks = size(vectors.count(), block_rows), size(queries.count(), block_queries)
    lanes = min(chunks, size(tasks, blocks))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))

    def build(own: pa.Table) -> pa.Table:
        packed = BitSlices(own["vec_id"].to_numpy(), matrix(own["x"])).packed()
        return pa.table([own["block"][:1], *([x] for x in packed)], ["block", "ids", "low", "bits", "slices"])

    index = materialised(vectors.withColumn("block", deal(blocks)).groupBy("block").applyInArrow(build, INDEX), "slices")
    own = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)).cast("array<long>")))

    asked = queries.dropDuplicates(["vec_id", "x"]).withColumn("query", F.xxhash64("vec_id", "x")).withColumn("chunk", deal(chunks))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    asked = asked.withColumn("lane", F.pmod("chunk", F.lit(lanes))).withColumn("block", everywhere)
    names = ["query_id", "query", "vec_id", "score", "key"]
    most = (1 << 63) - 1

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[list[list]] = [[] for _ in names]
        if index.num_rows:
            own = BitSlices.of(*(index[c][0].as_py() for c in ("ids", "low", "bits", "slices")))
            for query_id, key, q in zip(asked["vec_id"].to_pylist(), asked["query"].to_pylist(), matrix(asked["x"]), strict=True):
                ids, scores = own.top(query_id, q, k)
                scores = scores.tolist()
                for own_, new in zip(found, ([query_id] * len(ids), [key] * len(ids), ids.tolist(), [max(-most - 1, min(most, s)) for s in scores], map(order_key, scores)), strict=True):
                    own_ += new
        return pa.table([pa.array(c, pa.string() if n == "key" else pa.int64()) for c, n in zip(found, names, strict=True)], names)

    kind = "query_id long, query long, vec_id long, score long, key string"
    if chunks == lanes:  # one chunk for each lane
        some = own.groupBy("block", "lane").cogroup(asked.groupBy("block", "lane")).applyInArrow(run, kind)
    else:  # a lane's chunks go one after another, so that a task holds one at a time
        packed = asked.groupBy("block", "lane", "chunk").agg(F.collect_list(F.struct("vec_id", "query", "x")).alias("asked"))

        def each(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    rows = row.pop("asked")
                    t = pa.table({"vec_id": [r["vec_id"] for r in rows], "query": [r["query"] for r in rows], "x": pa.array([r["x"] for r in rows], pa.list_(pa.float64()))})
                    yield from run(pa.Table.from_pylist([row]), t).to_batches()

        some = own.join(packed, ["block", "lane"]).mapInArrow(each, kind)
    best = Window.partitionBy("query_id", "query").orderBy(F.col("key").desc(), "vec_id")
    return some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors for each whose vec_id is divisible by 50, against all others."""
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP9_SQL = """
WITH fine AS (
    SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM fine q JOIN fine c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
