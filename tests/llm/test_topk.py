import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.topk import OP9_SQL, BitSlices, op9_exact_topk, order_key, quantised, top_k


def plain(rows, queries, k):
    out = []
    for qid, q in queries:
        scored = sorted((-int(np.dot(q, x)), i) for i, x in rows if i != qid)[:k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=150), st.lists(st.integers(-300, 300), min_size=3, max_size=3), st.integers(1, 7))
def test_index(rows, query, k):
    x = np.array(rows)
    ids, scores = BitSlices(np.arange(len(rows))[::-1].copy(), x).top(3, np.array(query), k)
    got = sorted(zip((-scores).tolist(), ids.tolist()))
    want = [(-s, i) for _, _, i, s in plain([(len(rows) - 1 - n, r) for n, r in enumerate(rows)], [(3, query)], k)]
    assert got == sorted(want)


def test_whole_table(spark):
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(int)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = sorted(map(tuple, op9_exact_topk(spark, "/root/testdata/sf0.001").collect()))
    assert got == plain(rows, [r for r in rows if r[0] % 50 == 0], 5)
    db = duckdb.connect()
    db.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(db.sql(OP9_SQL).fetchall()) == got


def test_odd_rows_and_blocks(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (50, [1.0]), (100, None), (150, [1.0, None]), (200, [nan, 1.0]), (1, [inf, 0.0]), (None, [9.0, 9.0]), (2, []), (3, [-0.001, 5.0])] + [(i, [0.5, 0.5]) for i in range(1000, 1300)]
    v = quantised(spark.createDataFrame([(*r, "q") for r in rows], "vec_id long, embedding array<double>, query string"))
    whole = [(i, np.floor(256 * np.array((x + [0.0, 0.0])[:2])).astype(int)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    asked = {i: x for i, x in whole if i % 50 == 0}
    got = sorted(map(tuple, top_k(v, v.filter("vec_id % 50 = 0"), 5, block_rows=64, block_queries=3).collect()))
    assert got == plain(whole, asked.items(), 5)
    assert top_k(v.limit(0), v.limit(0)).count() == 0


def test_large_finite_values_and_many_chunks(spark):
    """Values near the largest of a float, and more chunks of queries than lanes."""
    rows = [(0, [3e38, 1.0]), (50, [1.0, -3e38]), (1, [1e30, 1e30]), (2, [-3.4e38, 0.0])] + [(i, [float(i % 7), float(i % 11)]) for i in range(100, 400)]
    v = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    whole = [(i, np.array([int(np.floor(np.float64(np.float32(c)) * 256)) for c in x], object)) for i, x in rows]
    stop = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = sorted((q, r, i, s) for q, x in whole if q % 50 == 0 for r, (s, i) in enumerate(sorted(((int(x @ y), j) for j, y in whole if j != q), key=lambda p: (-p[0], p[1]))[:5], 1))
    want = [(q, r, i, stop(s)) for q, r, i, s in want]
    got = sorted(map(tuple, top_k(v, v.filter("vec_id % 50 = 0"), 5, block_rows=100, block_queries=2, tasks=4).collect()))
    assert got == want


def test_no_clipping(spark):
    """Whole numbers beyond 2^56 keep their order, among few and among many bits."""
    rows = [(0, [1 / 256]), (1, [2.0**50]), (2, [2.0**51]), (3, [-(2.0**300)]), (4, [2.0**200 + 2.0**150]), (50, [-1.0])]
    v = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r.query_id, r.vec_id, r.score) for r in top_k(v, v.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    most = (1 << 63) - 1
    assert got[:5] == [(0, 4, most), (0, 2, 1 << 59), (0, 1, 1 << 58), (0, 50, -256), (0, 3, -most - 1)]
    assert [i for _, i, _ in got[5:]] == [3, 0, 1, 2, 4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(-20, 20), st.integers(-(1 << 300), 1 << 300)), max_size=20))
def test_order_of_keys(scores):
    assert sorted(scores, key=order_key) == sorted(scores)
