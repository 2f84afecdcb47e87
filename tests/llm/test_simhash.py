import itertools
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import simhash
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.simhash import GrayIndex, drop_near_duplicates, fingerprint, near_duplicates, op5_simhash_near_dedup


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(codes, distance):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for a, b in itertools.combinations(sorted(set(codes)), 2):
        if (a ^ b).bit_count() <= distance:
            root[find(a)] = find(b)
    return {c: find(c) for c in codes}


def expected(rows, distance=2):
    """rows: (doc_id, text)."""
    codes = [plain_fingerprint(t or "") for _, t in rows]
    root = plain_components(codes, distance)
    least = {}
    for (doc_id, _), c in zip(rows, codes):
        ids = [x for x in (doc_id, least.get(root[c])) if x is not None]
        least[root[c]] = min(ids) if ids else None
    return sorted(((d, f"{c:016x}", least[root[c]]) for (d, _), c in zip(rows, codes)), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op5_simhash_near_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == expected(rows)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 63), st.integers(0, 63), st.integers(0, 2)), max_size=80), st.integers(0, 3))
def test_index_joins_what_pairs_join(raw, distance):
    if not raw:
        return
    base = [0, 2**64 - 1, 0x0F0F00FF12345678, 1 << 63]
    group = np.sort(np.array([g for *_, g in raw]))
    codes = np.array([base[b] ^ (1 << i) ^ (1 << j) for b, i, j, _ in raw], np.uint64)
    u, v = GrayIndex(group, codes).forest(distance)
    per_group = {g: plain_components(codes[group == g].tolist(), distance) for g in set(group.tolist())}
    for a, b in zip(u.tolist(), v.tolist()):
        assert any(p.get(a) is not None and p.get(a) == p.get(b) for p in per_group.values())
    assert len(u) == sum((group == g).sum() - len(set(p.values())) for g, p in per_group.items())


def test_hot_groups_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 4)
    rng = random.Random(1)
    codes = {0x123456789ABCDEF0 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(simhash.signed(c),) for c in codes], "code long")
    found = {r.node % 2**64: r.root % 2**64 for r in connected_components(simhash.links(df, 2)).collect()}
    want = plain_components(codes, 2)
    groups = lambda m: {frozenset(c for c in codes if m.get(c, c) == r) for r in {m.get(c, c) for c in codes}}
    assert groups(found) == groups(want)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (None, "one two three four"), (2, "One TWO three\tfour"), (2, "One TWO three\tfour"), (9, "x " * 40000), (8, "x " * 39999), (None, "alone " * 3)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, code string")
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == expected(rows)
    kept = sorted((r.doc_id for r in drop_near_duplicates(docs).collect() if r.doc_id is not None))
    assert kept == [2, 3, 8]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(-5, i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: -5 for i in range(30)}, -5: -5}
