"""Best-two-fit packing of token sequences.

A bin is filled greedily, each time with the longest piece that fits.  Then its
shortest piece gives way to two unpacked pieces if these fill the widened gap
more tightly.  Bins depend on lengths alone, so the plan is made from the
histogram of lengths, which has at most ``capacity`` entries whatever the
corpus; a bin's pattern is used as often as the histogram allows before the
next is made.  Pieces then find their places through their rank among pieces of
their length: a per-partition rank plus an offset for the partition, so no
length is ever gathered into one task.

Defined results: a null or empty text packs as the end token alone; an empty
table gives no rows; repeated rows and repeated doc_ids are packed one by one;
extra columns are ignored.  Ties between equal lengths go by partition and row.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, bounded_batches, materialised, table

PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


#: Lower-case letters up to U+00FF, then ASCII marks other than the apostrophe: two pre-tokens.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """A text's ids as little-endian 32-bit bytes, each distinct word encoded once.

    The tokenizer drops white space and never joins across it, so the words
    between ASCII white space are encoded apart and their ids laid end to end.
    It also lower-cases, so words are kept in lower case, unless the text could
    hold a special token.  Plain words go to its byte-pair model directly, in
    the byte alphabet of byte-level models; all others to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode = lambda w: np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        # Printable bytes stand for themselves, the others for characters from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        model = tokenizer.model
        self.stem = Remembered(lambda w: np.array([t.id for t in model.tokenize("".join(alphabet[b] for b in w.encode()))], "<u4").tobytes(), 300_000)
        self.marks = Remembered(lambda w: self.encode(w) if w else b"", 50_000)
        self.words = Remembered(self.word, 300_000)

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if max(text) < "\u0100" and (plain := PLAIN.fullmatch(text.lower())):
            return self.stem[plain[1]] + self.marks[plain[2]]
        return self.encode(text)

    def ids(self, text: str) -> bytes:
        raw = text.encode()
        return b"".join(map(self.words.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, source: bool = False) -> DataFrame:
    """Each document's ids with ``end_id`` behind them, cut only where longer than ``capacity``; with ``source``, that column comes last."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids, part, seen = word_ids(path).ids, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, of = [], []
            for row, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                whole = ids(text or "") + end
                for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                    cut = whole[at : at + 4 * capacity]
                    length = len(cut) // 4
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(cut), part, seen[length]))
                    seen[length] += 1
                    of.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            if source:
                arrays, names = [*arrays, batch.column(2).take(pa.array(of, pa.int64()))], (*names, "source")
            yield pa.RecordBatch.from_arrays(arrays, names)

    bounded_batches(docs.sparkSession)
    own = [F.coalesce("source", F.lit("")).alias("source")] if source else []
    return docs.select(F.col("doc_id").cast("long"), "text", *own).mapInArrow(run, PIECES + ", source string" * source)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit over a histogram of lengths: patterns, longest piece first, and how often each is used."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = []
    fits = np.zeros(capacity + 1, np.int64)  # the longest unpacked length up to each gap

    def refresh() -> None:
        fits[:] = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    refresh()
    while fits[capacity]:
        bin_, gap = [], capacity
        while length := int(fits[gap]):
            n = min(int(left[length]), gap // length)
            bin_ += [length] * n
            gap -= n * length
            left[length] -= n
            if not left[length]:
                refresh()
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            first = np.flatnonzero(left[: room + 1])  # unpacked lengths that fit the widened gap
            second = fits[room - first]
            same = second == first
            second[same] = np.where(left[first[same]] > 1, second[same], fits[np.maximum(first[same] - 1, 0)])
            sums = np.where(second > 0, first + second, 0)
            if len(sums) and sums.max() > smallest:
                best = int(sums.argmax())
                pair = sorted((int(first[best]), int(second[best])), reverse=True)
                left[smallest] += 1
                left[pair[0]] -= 1
                left[pair[1]] -= 1
                bin_[-1:] = pair
        lengths, uses = np.unique(bin_, return_counts=True)
        more = int((left[lengths] // uses).min())
        left[lengths] -= more * uses
        refresh()
        plan.append((sorted(bin_, reverse=True), 1 + more))
    return plan


def places(plan: list[tuple[list[int], int]]) -> pd.DataFrame:
    """For each length, runs of ranks: in a run, ``each`` pieces go to one bin, one behind another."""
    rows, taken, bin_ = [], {}, 0
    for lengths, times in plan:
        offset = 0
        values, uses = np.unique(lengths, return_counts=True)
        for length, each in zip(values.tolist()[::-1], uses.tolist()[::-1], strict=True):
            rows.append((length, taken.get(length, 0), each, bin_, offset))
            taken[length] = taken.get(length, 0) + each * times
            offset += each * length
        bin_ += times
    frame = pd.DataFrame(rows, columns=["length", "first", "each", "bin", "offset"])
    return frame.astype("int64").sort_values(["length", "first"], ignore_index=True)


def placed(pdf: pd.DataFrame, rank: np.ndarray, runs: pd.DataFrame) -> pd.DataFrame:
    """``pdf`` with each piece's sequence_id and offset, from its rank among pieces of its length."""
    if not len(pdf):
        return pdf.assign(sequence_id=np.int64(0), offset=np.int64(0))
    span = 1 + int(runs["first"].max() if len(runs) else 0) + int(runs["each"].max() if len(runs) else 0)
    span = max(span, 1 + int(rank.max()))
    keys = runs["length"].to_numpy() * span + runs["first"].to_numpy()
    first, each, bins, offset = (runs[c].to_numpy() for c in ("first", "each", "bin", "offset"))
    length = pdf["length"].to_numpy()
    at = np.searchsorted(keys, length * span + rank, side="right") - 1
    within = rank - first[at]
    return pdf.assign(sequence_id=bins[at] + within // each[at], offset=offset[at] + within % each[at] * length)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = materialised(token_pieces(docs, path, capacity, end_id), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(places(plan_bins(histogram, capacity)))  # runs: a few for each length

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["part", "length"])

    def run(batches):
        for pdf in batches:
            yield placed(pdf, pdf["nth"].to_numpy() + pdf["base"].to_numpy(), runs.value)[PACKED]

    return ranked.mapInPandas(run, SCHEMA)


def pack_along(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, window: int = 256) -> DataFrame:
    """Like ``pack``, but sequences follow the order of ``docs``, whose partitions are ranges of it.

    Where ``docs`` has no texts, its rows are pieces of ``token_pieces`` in that order.

    Windows of the order, each of ``window`` sequences' tokens, are packed one
    by one, so sequences have the composition of their window; within a window
    they are numbered by their first piece.
    """

    def fill(pdf: pd.DataFrame, base: int) -> pd.DataFrame:
        plan = places(plan_bins(pdf["length"].value_counts().to_dict(), capacity))
        out = placed(pdf, pdf.groupby("length").cumcount().to_numpy(), plan)
        _, first, number = np.unique(out["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
        place = np.empty(len(first), np.int64)
        place[np.argsort(first)] = np.arange(len(first))
        return out.assign(sequence_id=base + place[number])[[*PACKED, "part"]]

    def run(batches):
        held, tokens, base = [], 0, 0
        for pdf in batches:
            while len(pdf):
                ends = tokens + pdf["length"].cumsum().to_numpy()
                cut = int(np.searchsorted(ends, window * capacity)) + 1
                held.append(pdf.iloc[:cut])
                tokens = int(ends[min(cut, len(pdf)) - 1])
                pdf = pdf.iloc[cut:]
                if tokens >= window * capacity:
                    out = fill(pd.concat(held, ignore_index=True), base)
                    base = int(out["sequence_id"].max()) + 1
                    yield out
                    held, tokens = [], 0
        if held:
            yield fill(pd.concat(held, ignore_index=True), base)

    if "text" in docs.columns:
        pieces = token_pieces(docs, path, capacity, end_id)
    else:
        pieces = docs.select("doc_id", "piece", "start", "length", "ids_crc32", F.spark_partition_id().alias("part"))
    packed = materialised(pieces.mapInPandas(run, SCHEMA + ", part int"), "packed")
    sizes = packed.groupBy("part").agg((F.max("sequence_id") + 1).alias("n")).orderBy("part").collect()  # a row for each partition
    bases = dict(zip((r.part for r in sizes), np.cumsum([0, *(r.n for r in sizes)]).tolist()))
    offsets = docs.sparkSession.createDataFrame(list(bases.items()), "part int, base long")
    return packed.join(F.broadcast(offsets), "part").withColumn("sequence_id", F.col("sequence_id") + F.col("base")).select(PACKED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens of word_bpe_49k.json."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
