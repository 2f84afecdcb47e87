import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm.packing import WordIds, op10_best_fit_packing, pack, pack_along, places, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
IDS = WordIds(PATH)


def checked(rows, texts, capacity):
    """The pieces of each document follow one another and hold its ids; sequences have no gaps or overflow."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc_id, own in by_doc.items():
        ids = np.array([*LIBRARY.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert [r.piece for r in sorted(own, key=lambda r: r.piece)] == list(range(-(-len(ids) // capacity)))
        for r in own:
            assert r.start == r.piece * capacity and r.length == min(capacity, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r.length for r in rows)
    return len(by_sequence), -(-total // capacity)


def test_whole_table(spark):
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    used, least = checked(op10_best_fit_packing(spark, "/root/testdata/sf0.001").collect(), texts, 4096)
    assert used <= least + 1


def test_odd_texts(spark):
    texts = {1: "", 2: None, 3: "a " * 5000, 4: "a<|endoftext|>b <|startoftext|> <|STARTOFTEXT|>", 8: "Mµ ÷x Ÿ Éa\u0301!! a_b c__ don'T.", 5: "É́ ΣΑΣ x\u0085y z\x1cq", 6: "\n\t ", 7: "don't I'LL"}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, part int")
    checked(pack(docs, PATH, 64).collect(), {k: v or "" for k, v in texts.items()}, 64)
    assert pack(docs.limit(0), PATH).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 50, "doc_id long, text string")
    rows = pack(docs, PATH, 10).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50 and len({r.sequence_id for r in rows}) == 25


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=25))
def test_plan_places_each_length_once(histogram):
    plan = plan_bins(histogram, 40)
    used = defaultdict(int)
    for lengths, times in plan:
        assert sum(lengths) <= 40 and times >= 1
        for length in lengths:
            used[length] += times
    assert dict(used) == histogram
    assert len(places(plan)) == sum(len(set(lengths)) for lengths, _ in plan)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sSéÉ")), max_size=40))
def test_ids_like_the_library(text):
    assert IDS.ids(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_sequences_follow_the_order_of_documents(spark):
    texts = {i: "a " * (1 + (i * 7) % 30 + 30 * (i >= 200)) for i in range(400)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    rows = pack_along(docs, PATH, 256, window=4).collect()
    used, least = checked(rows, texts, 256)
    assert sorted({r.sequence_id for r in rows}) == list(range(used)) and used <= least * 1.25
    first, last = defaultdict(lambda: 10**9), defaultdict(int)
    for r in rows:
        first[r.sequence_id], last[r.sequence_id] = min(first[r.sequence_id], r.doc_id), max(last[r.sequence_id], r.doc_id)
    assert all(last[s] < first[s + 12] for s in range(used - 12))
    assert pack_along(docs.limit(0), PATH).count() == 0
