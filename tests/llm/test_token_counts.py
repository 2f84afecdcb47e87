import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.token_counts import PieceCounter, count_tokens, op8_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = PieceCounter(PATH)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  a", "a  b ", "\n", "\n\n a\n", "a\n b", "\t\ta", "▁", "a▁b ▁ c", "<s> </s> <unk> <0x0A>", "é🎉漢字\u0000x", "x" * 3000, "​﻿", "the the  THE", "\r\n\r\n", "a b"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert COUNTER.count(text) == len(MODEL.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n▁aeht")), max_size=60))
def test_like_the_library(text):
    assert COUNTER.count(text) == len(MODEL.encode(text))


def test_whole_table(spark):
    rows = op8_token_counts(spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        n = len(MODEL.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "a b", None), (2, "a b", 0)], "doc_id long, text string, n_tokens int")
    rows = sorted(count_tokens(docs, PATH).select("doc_id", "n_bytes", "n_tokens").collect(), key=str)
    assert [tuple(r) for r in rows] == [(1, 0, 0), (1, 0, 0), (2, 3, 2), (None, 3, 2)]
    assert count_tokens(docs.limit(0), PATH).count() == 0
