"""Token counts by heap-and-linked-list byte-pair merging.

A text's symbols form a linked list.  A heap holds the adjacent pairs that the
vocabulary can join, lowest rank first and leftmost among equals.  Popping and
joining until the heap is empty leaves ``initial symbols - merges`` tokens, so
no identifiers are ever made.  A character outside the vocabulary starts as one
symbol for each of its UTF-8 bytes and never merges.

No vocabulary entry holds a space after another character, so merges never
cross the start of a run of spaces, and a character that only stands alone in
the vocabulary never merges at all.  Texts are cut there, and each distinct cut
is merged once per worker, in a bounded cache.

Nulls, empty texts: 0 bytes, 0 tokens.  Repeated rows are counted one by one.
Other columns are ignored by the query; ``count_tokens`` keeps them, its result
columns replacing columns of the same names.
"""

from __future__ import annotations

import functools
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Remembered, bounded_batches, table, text_or_empty

SPACE = "▁"


class PieceCounter:
    """Counts the tokens of texts under a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids if not special(i)}
        joined = {c for piece in self.rank if len(piece) > 1 for c in piece}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("this vocabulary joins symbols across the start of a run of spaces")
        if not joined <= self.rank.keys():
            raise ValueError("this vocabulary joins characters that it does not hold")
        self.alone = "\n" not in joined
        self.newline = self.initial("\n")
        self.after_space = Remembered(lambda word: self.merged(SPACE + word))
        self.chunks = Remembered(lambda chunk: self.merged(chunk.replace(" ", SPACE)))

    def initial(self, text: str) -> int:
        """Number of symbols before any merge."""
        rank = self.rank
        return sum(1 if c in rank else len(c.encode()) for c in text)

    def merged(self, chunk: str) -> int:
        """Number of tokens of one chunk: initial symbols minus merges."""
        rank, symbols = self.rank.get, list(chunk)
        n, merges = len(symbols), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (r := rank(pair)) is not None:
                heap.append((r, i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            merges += 1
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(pair + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, pair + symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, symbols[h] + pair))
        return self.initial(chunk) - merges

    def count(self, text: str) -> int:
        """Number of tokens of a whole text, which gets one space in front unless it is empty."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        lines = text.split("\n") if self.alone else [text]
        total = (len(lines) - 1) * self.newline
        after_space = self.after_space.__getitem__
        for i, line in enumerate(lines):
            words = line.split(" ")
            if "" in words:  # runs of spaces
                total += sum(map(self.chunks.__getitem__, re.findall(" *[^ ]+| +", (" " if i == 0 else "") + line)))
            elif i == 0:
                total += sum(map(after_space, words))
            else:
                total += self.chunks[words[0]] + sum(map(after_space, words[1:]))
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit for each row's whole text.

    ``path`` names the sentencepiece model, a file present on every executor.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType())])

    def run(batches):
        count = counter(path).count
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], [*batch.schema.names, "n_tokens"])

    counted = docs.select(*(docs[c] for c in keep)).mapInArrow(run, schema)
    size = F.octet_length(text_or_empty(text)).cast("long")
    return counted.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document under piece_bpe_32k.model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
