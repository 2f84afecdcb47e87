"""Log probabilities of whole texts: a word-frequency base and a causal self-attention model.

The texts of each input partition form blocks of about ``block_bytes``.  One
pass turns a block into one row: its distinct words with their subword ids and
numbers in training texts, and each text as places in that list.  All else
reads these rows.  Counts of words over all training texts are summed by word
and joined back, so what is shuffled grows with distinct words per block and
not with tokens; no table of all words is ever collected or broadcast.

Counts of subword ids, and of which id follows which, over all training texts
are where the model starts; the vocabulary bounds both tables.  It is then
trained on all training texts, in rounds: each partition of a round's blocks
takes Adam steps from the same weights over every window, and the weights are
averaged by a two-step sum.  A corpus of fewer than ``least_ids`` ids is passed
over more than once.

Every text is scored over windows of 16 ids that overlap by 4, each id once,
with at least the 4 ids before it in view, or all there are.

Defined results: null texts are empty; an empty text scores its end token;
repeated rows are scored one by one; an empty table gives no rows; a null
doc_id counts as the text "" for the split; a text longer than a block is a
block of its own; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .common import bounded_batches, materialised, table, text_or_empty

END = b""  # the token behind each text; no word is empty
CHUNK, PIECE = 8192, 1 << 19
LN10 = np.log(10)
BLOCK = "block long, round int, doc_ids array<long>, held array<boolean>, sizes binary, low binary, high binary, words binary, counts binary, ids binary, n_ids binary"


@functools.lru_cache(maxsize=2)
def subwords(path: str):
    """Encodes one word, with a space before it, to uint16 ids; and the id of the end, behind the last."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    if len(ranks) >= 1 << 16:
        raise ValueError("the vocabulary must have fewer than 65,536 entries")
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = lambda w: model.encode_ordinary(" " + w.decode()) if w else [len(ranks)]
    return encode, len(ranks)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Block:
    """Texts as places in the list of their distinct words, the end first."""

    def __init__(self):
        self.doc_ids, self.held, self.places, self.bytes = [], [], [], 0
        self.index: defaultdict = defaultdict(itertools.count().__next__)
        self.index[END]

    def add(self, doc_id: int | None, held: bool, text: str) -> None:
        words = words_of(text) + [END]
        self.places.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.bytes += len(text)

    def row(self, number: int, rounds: int, encode) -> pa.RecordBatch:
        ids = list(map(encode, self.index))
        training = [p for p, held in zip(self.places, self.held, strict=True) if not held]
        counts = np.bincount(np.concatenate([np.zeros(0, np.int32), *training]), minlength=len(ids))
        sizes = np.fromiter(map(len, self.places), np.int64, len(self.places))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint16)
        n_ids = np.fromiter(map(len, ids), np.int32, len(ids))
        places = np.concatenate(self.places)  # the high bytes are nearly all alike, and so compress well
        binary = [x.tobytes() for x in (sizes, (places & 0xFFFF).astype(np.uint16), (places >> 16).astype(np.uint16))] + [b" ".join(self.index)] + [x.tobytes() for x in (counts, flat, n_ids)]
        columns = [pa.array([number]), pa.array([number % rounds], pa.int32()), pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([self.held], pa.list_(pa.bool_())), *(pa.array([x], pa.binary()) for x in binary)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])


def blocks_of(docs: DataFrame, path: str, block_bytes: int, rounds: int) -> DataFrame:
    """One row for each block of texts; docs has doc_id, text and held_out."""

    def run(batches):
        from pyspark import TaskContext

        encode, block, n = subwords(path)[0], Block(), TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block.bytes and block.bytes + len(text) > block_bytes:
                    yield block.row(n, rounds, encode)
                    block, n = Block(), n + 1
                block.add(doc_id, held, text)
        if block.doc_ids:
            yield block.row(n, rounds, encode)

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, BLOCK)


def block_words(blocks: DataFrame) -> DataFrame:
    """block, place, word and n, its number in the block's training texts, of each block's distinct words."""

    def run(batches):
        for batch in batches:
            for block, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counts = words.split(b" "), np.frombuffer(counts, np.int64)
                for at in range(0, len(words), 50_000):
                    n = len(words[at : at + 50_000])
                    columns = [pa.array(np.full(n, block)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(words[at : at + n], pa.binary()), pa.array(counts[at : at + n])]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "place", "word", "n"])

    return blocks.select("block", "words", "counts").mapInArrow(run, "block long, place int, word binary, n long")


def subword_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each subword id, the end's last, in all training texts."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for counts, ids, n_ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total += np.bincount(np.frombuffer(ids, np.uint16), np.repeat(np.frombuffer(counts, np.int64), np.frombuffer(n_ids, np.int32)), size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in blocks.select("counts", "ids", "n_ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n  # one row for each entry of the vocabulary at most
    return counts


class Texts:
    """The texts of a block as ranks of subword ids, end to end."""

    def __init__(self, row: dict, rank: np.ndarray, only_training: bool = False):
        self.places, sizes = np.frombuffer(row["low"], np.uint16) | np.frombuffer(row["high"], np.uint16).astype(np.int32) << 16, np.frombuffer(row["sizes"], np.int64)
        if only_training:
            training = ~np.array(row["held"], bool)
            self.places, sizes = self.places[np.repeat(training, sizes)], sizes[training]
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        self.n_ids = np.frombuffer(row["n_ids"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.n_ids) - self.n_ids
        self.ranks = rank[np.frombuffer(row["ids"], np.uint16)]

    def pieces(self):
        """(first text, past the last, ranks end to end, ids of each text), about ``PIECE`` ids at once."""
        n = self.n_ids[self.places]
        lengths = np.add.reduceat(n, self.first) if len(self.first) else n[:0]
        group = np.cumsum(lengths) // PIECE
        for at in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(group)) + 1):
            if len(at):
                lo, hi = self.first[at[0]], self.first[at[-1]] + self.sizes[at[-1]]
                own, m = self.places[lo:hi], n[lo:hi]
                yield at[0], at[-1] + 1, self.ranks[np.repeat(self.starts[own] - np.cumsum(m) + m, m) + np.arange(m.sum())], lengths[at]


def pair_counts(blocks: DataFrame, frequencies: attention.Frequencies, end: int) -> np.ndarray:
    """How often each cell of the model's steps stands behind each id, in all training texts."""
    rank = blocks.sparkSession.sparkContext.broadcast(frequencies.rank)
    shape = attention.BEHIND, attention.CELLS

    def run(batches):
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for _, _, ranks, _ in Texts(row, rank.value, True).pieces():
                    # One end between two texts: both the last id's successor and the first id's predecessor.
                    behind = np.r_[rank.value[end], ranks[:-1]]
                    total += np.bincount(np.minimum(behind, shape[0] - 1) * shape[1] + np.minimum(ranks, attention.HEAD), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    # At most BEHIND * CELLS rows, whatever the corpus.
    found = blocks.select("held", "sizes", "low", "high", "ids", "n_ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(shape[0] * shape[1])
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    return total.reshape(shape)


def averaged(parts: DataFrame) -> np.ndarray:
    """The mean of weight vectors, cut in chunks and summed in two steps, always in the same order."""

    def summed(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        weight = np.array(t["weight"].to_pylist())
        total = sum(w * np.frombuffer(v, np.float32).astype(float) for w, v in zip(weight, t["vector"].to_pylist(), strict=True))
        mean = (total / weight.sum()).astype(np.float32).tobytes()
        return pa.table({"chunk": [t["chunk"][0].as_py()], "lane": [0], "part": [t["part"][0].as_py()], "weight": [float(weight.sum())], "vector": [mean]})

    kind = "chunk long, lane long, part long, weight double, vector binary"
    some = parts.groupBy("chunk", "lane").applyInArrow(summed, kind)
    rows = some.groupBy("chunk").applyInArrow(summed, kind).collect()
    return np.frombuffer(b"".join(r.vector for r in sorted(rows, key=lambda r: r.chunk)), np.float32)


def trained(blocks: DataFrame, shared, end: int, rounds: int, passes: int, lanes: int) -> np.ndarray:
    """The model's weights after all rounds: every window of every training text takes part in ``passes`` steps."""
    vector = attention.flat(attention.start())
    spark = blocks.sparkSession
    for k in range(rounds * passes):
        now = spark.sparkContext.broadcast(vector)

        def run(batches):
            before, known = now.value, shared.value
            trainer, weight, part = attention.Trainer(before, known), 0, None
            for batch in batches:
                for row in batch.to_pylist():
                    part = row["block"] if part is None else part
                    for _, _, ranks, lengths in Texts(row, known.rank, True).pieces():
                        trainer.over(attention.Batches(ranks, lengths, int(known.rank[end])))
                        weight += len(ranks)
            if weight:
                cuts = [trainer.vector[i : i + CHUNK].tobytes() for i in range(0, len(before), CHUNK)]
                n = len(cuts)
                columns = [pa.array(range(n), pa.int64()), pa.array([zlib.crc32(b"%d" % part) % lanes] * n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([float(weight)] * n), pa.array(cuts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "lane", "part", "weight", "vector"])

        own = blocks.filter(F.col("round") == k % rounds).select("block", "held", "sizes", "low", "high", "ids", "n_ids")
        found = averaged(own.mapInArrow(run, "chunk long, lane long, part long, weight double, vector binary"))
        vector = found if len(found) else vector
        now.destroy()
    return vector


def score_texts(docs: DataFrame, path: str, block_bytes: int = 8 << 20, rounds: int = 4, least_ids: int = 20_000_000, trains: bool = True) -> DataFrame:
    """Scores of every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A row trains the model unless crc32 of its doc_id as text leaves 2 modulo 7.
    ``trains=False`` scores by the model before training.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    end = subwords(path)[1]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2
    docs = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), held.alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = materialised(blocks_of(docs, path, min(block_bytes, (64 << 10) + size // 64), rounds), "blocks")
    words = block_words(blocks)
    counts = materialised(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total, distinct = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequencies = attention.Frequencies(subword_counts(blocks, end + 1))
    frequencies.set_pairs(pair_counts(blocks, frequencies, end))
    n_ids = int(frequencies.sorted.sum()) - len(frequencies.sorted)
    n_blocks = blocks.count()
    passes = max(1, min(6, least_ids // max(1, n_ids))) if trains else 0
    shared = spark.sparkContext.broadcast(frequencies)  # tables that the vocabulary bounds, about 20 MB
    vector = trained(blocks, shared, end, rounds, passes, 1 + int(n_blocks**0.5))
    known = spark.sparkContext.broadcast(vector)

    def run(key, own: pa.Table, counted: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([[]] * len(result), schema=result)
        (row,), frequencies = own.to_pylist(), shared.value
        texts, begin = Texts(row, frequencies.rank), int(frequencies.rank[end])
        count = np.zeros(len(texts.n_ids), np.int64)
        count[counted["place"].to_numpy()] = counted["c"].to_numpy()
        base = np.add.reduceat(np.log10((count + 1) / (total + distinct + 1))[texts.places], texts.first)
        n_known = np.add.reduceat((count > 0).astype(np.int64)[texts.places], texts.first)
        score, model = np.zeros(len(base)), attention.shaped(known.value)
        for first, past, ranks, lengths in texts.pieces():
            batches = attention.Batches(ranks, lengths, begin)
            for k in range(0, len(batches.text), 256):
                *what, text = batches.of(np.arange(k, min(k + 256, len(batches.text))))
                score[first:past] += np.bincount(text, attention.log_probability(model, frequencies, *what), past - first)
        train = np.full(len(base), total, np.int64)
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), *map(pa.array, (texts.sizes, n_known, train, base, score / LN10))], schema=result)

    fields = ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())
    result = pa.schema(fields)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    counted = words.join(counts, "word").select("block", "place", "c")
    texts = blocks.select("block", "doc_ids", "held", "sizes", "low", "high", "ids", "n_ids")
    return texts.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, kind)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents."""
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
