import hashlib
import math

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.clustering import LARGEST, OP13_SQL, Annulus, clusters, op13_centroid_clustering


def plain(rows, k, rounds, width, scale=256):
    """The same by whole numbers of Python and all centroids for each vector."""
    fine = [(i, [math.floor(scale * float(v)) if abs(v) < 1e15 else int(v) * scale for v in x]) for i, x in rows if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(fine, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    to = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((to(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in fine]
        for j in range(len(centroids)):
            if members := [x for (_, x), o in zip(fine, own) if o == j]:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, *near(x)[::-1]) for i, x in fine]
    cap = lambda v: min(v, LARGEST)
    inertia = {j: cap(sum(cap(d) for _, o, d in found if o == j)) for j in range(len(centroids))}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    key = lambda r: tuple((v is not None, v) for v in r)
    return sorted(((i, j, cap(d), inertia[j], cap(sum(inertia.values())), digest(centroids[j])) for i, j, d in found), key=key)


def answer(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=12), st.lists(st.lists(st.integers(-9, 9), min_size=2, max_size=2), min_size=1, max_size=30), st.sampled_from([1, 1 << 22, 1 << 27, 1 << 70]))
def test_nearest(centroids, rows, by):
    """Few values, so many ties; whole numbers that need floats, 64 bits or more."""
    centroids, rows = [[v * by for v in c] for c in centroids], [[v * by for v in r] for r in rows]
    x = np.array(rows, object if by > 1 << 40 else np.int64)
    number, distance = Annulus(centroids).nearest(x)
    want = [min((sum((a - b) ** 2 for a, b in zip(r, c)), j) for j, c in enumerate(centroids)) for r in rows]
    assert list(zip(distance.tolist(), number.tolist())) == [(min(d, LARGEST), j) for d, j in want]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = answer(op13_centroid_clustering(spark, folder))
    assert got == plain(rows, 40, 5, 64)
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    assert sorted(db.sql(OP13_SQL).fetchall()) == got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (None, [0.5, 0.5]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [3.0, 1.0]), (8, []), (9, [1e18, -1e18]), (10, [-3e38, 1e300])]
    rows += [(i, [float(i % 5), float(i % 3)]) for i in range(20, 60)]
    named = spark.createDataFrame([(*r, "q", 0) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    for k in (1, 4, 100):
        assert answer(clusters(named, k, 3, 2)) == plain(rows, k, 3, 2)
    assert answer(clusters(named.limit(0), 4, 3, 2)) == []
    hot = rows[:1] * 500 + rows[-9:]
    assert answer(clusters(spark.createDataFrame(hot, "vec_id long, embedding array<double>").repartition(7), 4, 3, 2)) == plain(hot, 4, 3, 2)


def test_partitions_do_not_matter(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert answer(clusters(table.repartition(1), 7)) == answer(clusters(table.repartition(13), 7))
