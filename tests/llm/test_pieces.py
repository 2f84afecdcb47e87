import public_tokenizers

from ledgerloom.llm.mixing import mixed
from ledgerloom.llm.packing import pack_along, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_are_packed_like_texts(spark):
    """Pieces cut before they are put in order are those of the texts in order, with all of a document's in their place."""
    rows = [(i, "a " * (1 + i % 700), "xy"[i % 2] if i % 5 else None) for i in range(120)] + [(None, "b", None), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    by_text = pack_along(mixed(docs), PATH, 256, window=4).collect()
    order = mixed(token_pieces(docs, PATH, 256, 1, source=True), then=("piece", "ids_crc32"))
    by_piece = pack_along(order, PATH, 256, window=4).collect()
    assert sorted(map(key, by_piece)) == sorted(map(key, by_text))
    filled = {}
    for r in by_piece:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 256
    numbers = {}
    for r in order.collect():
        numbers.setdefault((r.doc_id, r.source), []).append(r.piece)
    assert all(n == sorted(n) for n in numbers.values())
