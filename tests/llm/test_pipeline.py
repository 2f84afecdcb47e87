from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES
from ledgerloom.llm.packing import pack_along
from ledgerloom.llm.quality import op6_quality_classifier
from ledgerloom.llm.secret_scan import base_spans

from test_similar import expected

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage against a plain account of what it has to do with its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    for name, stage in STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        at[name] = docs, spark.read.parquet(str(tmp_path / name))
        docs = at[name][1]
    for name, _ in STAGES[:-1]:
        assert at[name][1].columns == COLUMNS
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    kept = {r.doc_id for r in op6_quality_classifier(spark, SF).collect() if r.keep}
    before, after = map(rows, at["quality"])
    assert after == {i: before[i] for i in kept}

    before, after = map(rows, at["near_duplicates"])
    stay = set(expected([(i, r.text) for i, r in before.items()]).values())  # all pairs of five-word similarity 0.8 or more
    assert after == {i: before[i] for i in stay}

    before, after = map(rows, at["secrets"])
    assert after.keys() == before.keys()
    for i, r in after.items():
        assert not base_spans(r.text)
        if r.text != before[i].text:
            assert "[REDACTED]" in r.text and r.n_chars == len(r.text)
        else:
            assert r == before[i]

    assert rows(at["mixing"][0]) == rows(at["mixing"][1])
    pieces = at["packing"][1].collect()
    assert {r.doc_id for r in pieces} == rows(at["packing"][0]).keys() and all(r.offset + r.length <= 4096 for r in pieces)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


def test_sequences_follow_the_mix(spark, monkeypatch):
    """The packing stage gets rows in any order and fills sequences along the schedule."""
    rows = [(i, f"w{i} " * (40 if i % 2 else 400), "en", "ab"[i % 2], 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "text")
    monkeypatch.setattr(corpus_pipeline, "pack_along", lambda d, path: pack_along(d, path, 2048, window=8))
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    half = max(r.sequence_id for r in packed) / 2
    for source in (0, 1):
        ids = {r.doc_id for r in packed if r.doc_id % 2 == source}
        early = {r.doc_id for r in packed if r.doc_id % 2 == source and r.sequence_id <= half}
        assert 0.35 < len(early) / len(ids) < 0.65


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, one long text, extra columns and empty tables, through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(10_001, None, None, None, None), (10_002, "", "", "", 0), (None, None, None, None, None), (None, "a text without a number", "en", "web", 23), (10_003, "word " * 60_000, "en", None, 300_000), (10_004, " \n\t", "xx", "web", 3)]
    more = docs.unionByName(spark.createDataFrame(odd, columns)).unionByName(docs.limit(20)).withColumn("slot", F.lit(1)).withColumn("code", F.lit("x"))
    sf = tmp_path / "sf"
    sf.mkdir()
    more.write.parquet(str(sf / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(sf / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(sf)).collect()
    assert packed and all(r.offset + r.length <= 4096 for r in packed)
    pieces = [(r.doc_id, r.piece) for r in packed if r.doc_id is not None]
    assert len(pieces) == len(set(pieces))
    empty = tmp_path / "empty"
    empty.mkdir()
    more.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
