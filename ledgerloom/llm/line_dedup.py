"""Reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

A line's key is the line, stripped and with A-Z in lower case, as the first 128 bits of its
SHA-256.  The index keeps three tables in a folder that all executors share:

* references: which document holds which key, as a log of signed rows.  Inserting a document appends
  its keys with +1, deleting it appends them with -1, so nothing that was known is lost.
* counts: for each key the exact number of documents that hold it and the largest of them.
* filters: for each shard of keys a cuckoo filter of those in ``least`` documents or more.  A key
  that comes to that number is inserted, one that falls below it is deleted.

Each change writes a new generation; only the counts and filters that it touches are made anew.
To find the lines that go, references meet the filter of their shard in a stream: a task
reads a shard's filter and then its references, batch by batch.  A shard's references are
spread over ``spread`` such streams by document, so that a line that is in a third of all documents
meets its filter in many tasks.  What passes is checked against the exact counts, by a join that
Spark splits where a key has many rows; the texts then meet their own lost keys.
A filter has at most about ``SHARD`` keys, and the number of shards follows their number.

Defined results: a null text is empty, and an empty text one empty line; rows without doc_id
keep all lines and count for no key; rows with the same doc_id are one document for
counting, and each keeps or loses lines of its own text; a document that is inserted again is
replaced; deleting one that is not there does nothing; an empty table gives no rows; columns
beside those of the query stay, and those named like its results are replaced.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, shared_folder, table, text_or_empty
from .cuckoo import CuckooFilter

SPACES = " \t\n\x0b\x0c\r"
SHARD = 1 << 15
FILTER = "shard int, buckets int, slots binary, stash binary"
KEY = ["high", "low"]


def key_of(line: str, least_chars: int) -> bytes | None:
    """16 bytes of the line's digest, or None for a line too short to count."""
    line = line.strip(SPACES)
    return hashlib.sha256(line.encode().lower()).digest()[:16] if len(line) >= least_chars else None


def halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)


def references(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """doc_id, high and low of every key that counts, once for each document."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {key_of(line, least_chars) for line in text.split("\n")} - {None}
                keys += own
                ids += [doc_id] * len(own)
            both = halves(keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", *KEY])

    bounded_batches(docs.sparkSession)
    read = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return read.mapInArrow(run, "doc_id long, high long, low long").distinct()


def without_lines(docs: DataFrame, lost: DataFrame, least_chars: int = 20) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept, the text without the lines whose keys ``lost`` (doc_id, high, low) names."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    by_doc = lost.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct(*KEY)).alias("__lost"))
    joined = docs.select(*keep).join(by_doc, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lost = batch.column(batch.num_columns - 1)
            flat = lost.flatten()
            keys = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in KEY], 1).astype(">i8").tobytes()
            n_lines, n_dropped, kept, at = [], [], [], 0
            for text, n in zip(texts, lost.value_lengths().to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if n:
                    own = {keys[16 * i : 16 * i + 16] for i in range(at, at + n)}
                    at += n
                    lines = [x for x in lines if key_of(x, least_chars) not in own]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept)], schema.fieldNames())

    return joined.mapInArrow(run, schema)


class LineIndex:
    """The index at ``folder``; without one, in a new place of the shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = 3, least_chars: int = 20, spread: int = 64):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.least, self.least_chars, self.spread = least, least_chars, spread
        self.logs: list[str] = []
        self.generation, self.shards = 0, 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index as its last finished change left it."""
        rows = spark.read.json(f"{folder}/state").orderBy(F.col("generation").desc()).limit(1).collect()
        own = cls(spark, folder, *(rows[0][c] for c in ("least", "least_chars", "spread")))
        own.logs, own.generation, own.shards = list(rows[0].logs), rows[0].generation, rows[0].shards
        return own

    def insert(self, docs: DataFrame) -> None:
        """Count the lines of ``docs``, which has doc_id and text; documents already there are replaced."""
        new = self._written("new", references(docs, self.least_chars)).withColumn("sign", F.lit(1))
        if self.generation:
            old = self.live().join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi").withColumn("sign", F.lit(-1))
            new = new.unionByName(old).groupBy("doc_id", *KEY).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")
        self._change(new)

    def delete(self, ids: DataFrame) -> None:
        """Forget the documents that ``ids`` (doc_id) names."""
        if self.generation:
            gone = ids.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct()
            self._change(self.live().join(gone, "doc_id", "left_semi").withColumn("sign", F.lit(-1)))

    def live(self) -> DataFrame:
        """doc_id, high and low of all that is in the index."""
        log = self.spark.read.schema("doc_id long, high long, low long, sign int").parquet(*self.logs)
        if len(self.logs) == 1:
            return log.drop("sign")
        return log.groupBy("doc_id", *KEY).agg(F.sum("sign").alias("sign")).filter("sign > 0").drop("sign")

    def counts(self) -> DataFrame:
        """high, low, n documents that hold the key, and the largest of them, last."""
        return self.spark.read.schema("high long, low long, n long, last long").parquet(f"{self.folder}/counts-{self.generation}")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTER).parquet(f"{self.folder}/filters-{self.generation}")

    def lost(self, of: DataFrame | None = None) -> DataFrame:
        """doc_id, high and low of all references whose lines go; ``of`` limits them to some references of the index."""
        rows = self.live() if of is None else of
        at = lambda df: df.withColumn("shard", self._shard())
        streams = at(rows).withColumn("stream", F.pmod(F.xxhash64("doc_id"), F.lit(self.spread)).cast("int")).select("shard", "stream", "doc_id", *KEY, F.lit(None).cast("binary").alias("slots"), F.lit(None).cast("binary").alias("stash"), F.lit(None).cast("int").alias("buckets"))
        copies = self.filters().withColumn("stream", F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1)))).select("shard", "stream", F.lit(None).cast("long").alias("doc_id"), *(F.lit(None).cast("long").alias(c) for c in KEY), "slots", "stash", "buckets")
        dealt = streams.unionByName(copies).repartition("shard", "stream").sortWithinPartitions("shard", "stream", F.col("slots").isNull())

        def run(batches):
            shard = held = None  # the stream at hand and its filter
            for batch in batches:
                of, stream = (batch.column(c).to_numpy() for c in ("shard", "stream"))
                starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (stream[1:] != stream[:-1])]) if len(of) else of
                for a, b in zip(starts, np.r_[starts[1:], len(of)], strict=True):
                    if shard != (shard := (of[a], stream[a])):
                        held = None
                    if batch["slots"][a].is_valid:
                        held = CuckooFilter(batch["buckets"][a].as_py(), batch["slots"][a].as_py(), batch["stash"][a].as_py())
                        a += 1
                    if held is not None and b > a:
                        part = batch.slice(a, b - a).select(["doc_id", *KEY])
                        yield part.filter(pa.array(held.holds(*(part[c].to_numpy() for c in KEY))))

        bounded_batches(self.spark, 8192)
        passed = dealt.mapInArrow(run, "doc_id long, high long, low long")
        exact = self.counts().filter(F.col("n") >= self.least).select(*KEY, "last")
        return passed.join(exact, KEY).filter("doc_id <> last").select("doc_id", *KEY)

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """``docs``, all of which are in the index, with n_lines, n_dropped and kept."""
        return without_lines(docs, self.lost(references(docs, self.least_chars)), self.least_chars)

    def _shard(self):
        return F.pmod(F.shiftrightunsigned("high", 32), F.lit(self.shards)).cast("int")

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{self.generation + 1}-{uuid.uuid4().hex}" if name == "new" else f"{self.folder}/{name}-{self.generation + 1}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _change(self, signed: DataFrame) -> None:
        """Apply signed references: log, counts and filters of the next generation, then its state."""
        log = self._written("references", signed.select("doc_id", *KEY, F.col("sign").cast("int").alias("sign")))
        last = lambda sign: F.max(F.when(F.col("sign") == sign, F.col("doc_id")))
        moved = log.groupBy(*KEY).agg(F.sum("sign").alias("by"), last(1).alias("came"), last(-1).alias("went"))
        if not self.generation:
            counts = moved.filter("by > 0").select(*KEY, F.col("by").alias("n"), F.col("came").alias("last"), F.lit(0).cast("long").alias("was"))
        else:
            merged = self.counts().join(moved, KEY, "full")
            n, was = F.coalesce("n", F.lit(0).cast("long")), F.coalesce(F.col("n"), F.lit(0).cast("long"))
            merged = merged.select(*KEY, (n + F.coalesce("by", F.lit(0))).alias("n"), was.alias("was"), F.greatest("last", "came").alias("last"), (F.col("went") >= F.col("last")).alias("unsure"))
            merged = self._written("merged", merged)
            unsure = merged.filter("unsure and n > 0").select(*KEY)
            paths = [*self.logs, f"{self.folder}/references-{self.generation + 1}"]
            after = self.spark.read.schema(log.schema).parquet(*paths).join(unsure, KEY, "left_semi").groupBy("doc_id", *KEY).agg(F.sum("sign").alias("sign")).filter("sign > 0")
            found = after.groupBy(*KEY).agg(F.max("doc_id").alias("found"))
            counts = merged.filter("n > 0 or was > 0").join(found, KEY, "left").select(*KEY, "n", F.coalesce("found", "last").alias("last"), "was")
        counts = self._written("changes", counts)
        self._written("counts", counts.filter("n > 0").select(*KEY, "n", "last"))
        often = counts.filter(F.col("n") >= self.least)
        shards = 1 << (max(1, often.count()) // SHARD).bit_length()
        if self.generation and shards == self.shards:
            crossed = counts.filter((F.col("n") >= self.least) != (F.col("was") >= self.least)).select(self._shard().alias("shard"), *KEY, (F.col("n") >= self.least).alias("up"))
            filters = self.filters().groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(_changed, FILTER)
        else:
            self.shards = shards
            filters = often.select(self._shard().alias("shard"), *KEY).groupBy("shard").applyInArrow(_built, FILTER)
        self._written("filters", filters)
        self.generation += 1
        self.logs.append(f"{self.folder}/references-{self.generation}")
        if len(self.logs) > 8:  # one row for each live reference again
            path = f"{self.folder}/references-{self.generation}-live"
            self.live().withColumn("sign", F.lit(1)).write.parquet(path)
            self.logs = [path]
        state = self.spark.createDataFrame([(self.generation, self.shards, self.least, self.least_chars, self.spread, self.logs)], "generation int, shards int, least int, least_chars int, spread int, logs array<string>")
        state.coalesce(1).write.mode("append").json(f"{self.folder}/state")


def _row(shard: int, held: CuckooFilter) -> pa.Table:
    buckets, slots, stash = held.packed()
    return pa.table([pa.array([shard], pa.int32()), pa.array([buckets], pa.int32()), pa.array([slots]), pa.array([stash])], ["shard", "buckets", "slots", "stash"])


def _keys(rows: pa.Table) -> list[np.ndarray]:
    return [rows[c].to_numpy() for c in KEY]


def _built(rows: pa.Table) -> pa.Table:
    """The filter of a shard's keys, at most about ``SHARD`` of them."""
    return _row(rows["shard"][0].as_py(), CuckooFilter.of(*_keys(rows)))


def _changed(before: pa.Table, rows: pa.Table) -> pa.Table:
    """A shard's filter after some keys came and some went."""
    if not before.num_rows:
        return _built(rows)
    held = CuckooFilter(*(before[c][0].as_py() for c in ("buckets", "slots", "stash")))
    if rows.num_rows:
        held.remove(*_keys(rows.filter(pa.compute.invert(rows["up"]))))
        held.insert(*_keys(rows.filter(rows["up"])))
    return _row(before["shard"][0].as_py(), held)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the lines that three or more documents share, but in the last of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark)
    index.insert(docs)
    done = without_lines(docs, index.lost())
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
    SELECT row, doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)
), often AS (
    SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT row, doc_id, i, line, last IS NOT NULL AND doc_id IS NOT NULL AND doc_id <> last AS gone FROM lines LEFT JOIN often USING (key))
GROUP BY row, doc_id
"""
