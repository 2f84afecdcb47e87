import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.cuckoo import CuckooFilter
from ledgerloom.llm.line_dedup import OP12_SQL, LineIndex, op12_line_dedup, references, without_lines


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line) if len(line) >= 20 else None


def plain(rows, least=3):
    """doc_id, lines, lost lines and the text that stays, from the definition."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and key(line):
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(h := holders.get(key(x), ())) < least or i == max(h)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def answer(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1 << 62), max_size=400), st.data())
def test_cuckoo(keys, data):
    mixed = np.array(sorted(keys), np.int64) * np.int64(6364136223846793005 & ((1 << 62) - 1))
    half = data.draw(st.integers(0, len(mixed)))
    held = CuckooFilter(16)  # too small for most sets, so keys move and some are stashed
    held.insert(mixed, mixed[::-1].copy())
    assert held.holds(mixed, mixed[::-1].copy()).all()
    held = CuckooFilter(*held.packed())
    held.remove(mixed[:half], mixed[::-1][:half].copy())
    assert held.holds(mixed[half:], mixed[::-1][half:].copy()).all()
    assert (held.slots > 0).sum() + len(held.stash) == len(mixed) - half


def test_cuckoo_turns_most_others_away():
    rng = np.random.default_rng(0)
    own, others = rng.integers(-(1 << 63), 1 << 63, (2, 20_000)), rng.integers(-(1 << 63), 1 << 63, (2, 50_000))
    held = CuckooFilter.of(*own)
    assert held.holds(*own).all() and not held.stash and held.holds(*others).mean() < 0.001


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_table(spark, size):
    folder = f"/root/testdata/{size}"
    got = sorted(map(tuple, op12_line_dedup(spark, folder).collect()))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(rows))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    assert sorted(db.sql(OP12_SQL).fetchall()) == got


A, B, C, D = ("the first of the long lines", "a second line that is long", "ÄÖÜ line with other letters", "x" * 200_000)
ODD = [(1, f"{A}\n{B}\nshort"), (2, f"  {A.upper()}\t\n{A}\r\n{C}"), (3, f"{A}\n\n{B}"), (3, f"{A}\n{C}"), (4, None), (5, ""), (None, A), (6, f"{B}\n{C.lower()}"), (7, f"{C}\n{D}"), (8, D), (9, D + "\n" + D), (10, "\n".join([A] * 40)), (11, "\x0b" + A + " ")]
KIND = "doc_id long, text string, kept int, high string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h") for r in rows], KIND)


def test_odd_rows(spark):
    for rows in (ODD, ODD * 2, []):
        index = LineIndex(spark)
        index.insert(frame(spark, rows).repartition(3))
        assert answer(index.deduplicated(frame(spark, rows))) == plain(rows)
    db = duckdb.connect()
    db.sql("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", ODD)
    assert sorted(db.sql(OP12_SQL).fetchall(), key=str) == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(ODD)), key=str)


def test_changes_are_reversible(spark):
    """After each insertion and deletion the index answers as one that was made of the documents that are left."""
    rng = np.random.default_rng(5)
    pool = [f"shared line number {i:04d} of the pool" for i in range(30)]
    make = lambda ids: [(int(i), "\n".join(rng.choice(pool, rng.integers(1, 8)))) for i in ids]
    index, there = LineIndex(spark, spread=3), {}

    def same():
        rows = list(there.items())
        assert answer(index.deduplicated(frame(spark, rows))) == plain(rows)
        want = defaultdict(set)
        for i, text in rows:
            for line in text.split("\n"):
                want[key(line)].add(i)
        assert sorted((r.n, r.last) for r in index.counts().collect()) == sorted((len(h), max(h)) for h in want.values())
        often = index.counts().filter("n >= 3").count()
        assert sum((np.frombuffer(f.slots, np.uint16) > 0).sum() + len(f.stash) // 16 for f in index.filters().collect()) == often

    def insert(rows):
        index.insert(frame(spark, rows))
        there.update(rows)
        same()

    def delete(ids):
        index.delete(spark.createDataFrame([(int(i),) for i in ids], "doc_id long"))
        for i in ids:
            there.pop(i, None)
        same()

    first = make(range(20))
    insert(first)
    insert(make(range(20, 30)))
    insert(make(range(5, 12)))  # replaced
    delete([29, 28, 27, 3, 1000])  # the last holders, one of others, one that is not there
    delete(range(20, 27))
    index = LineIndex.open(spark, index.folder)
    insert(first)
    while len(index.logs) > 1:  # up to the log's rewriting
        insert(make([50 + index.generation]))
    delete(list(there))
    assert index.counts().count() == 0


def test_large_batches_of_one_line(spark):
    """A line in all documents, over more rows than a batch holds."""
    rows = [(i, A if i % 3 else f"{A}\n{B} {i}") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex(spark, spread=4)
    index.insert(docs)
    done = without_lines(docs, index.lost())
    assert done.filter("n_dropped = 1").count() == 29_999
    assert done.filter("n_dropped = 0").first().doc_id == 29_999
    assert index.lost(references(docs.filter("doc_id < 10"))).count() == 10
