import numpy as np
import pytest

from ledgerloom.llm import lobpcg
from ledgerloom.llm.whitening import LARGEST, op11_embedding_whitening, scaled, whitened


def plain(rows, width, count=16):
    """vec_id, deviation, explained and whitened components by the dense covariance."""
    x = np.array([[int(np.floor(64 * float(v))) + 1_000_000 for v in r] + [1_000_000] * (width - len(r)) for _, r in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    return n, ((n * x - sums) ** 2).sum(1), e / np.trace(v), ((n * x - sums) / n) @ u / np.sqrt(e)


@pytest.mark.parametrize("values", [0.9 ** np.arange(150), np.r_[np.full(20, 5.0), np.full(20, 4.999999), np.full(30, 1e-9)], np.r_[3.0, 2.0, 1.0, np.zeros(50)], np.ones(7), 1 + 1e-3 * np.random.default_rng(0).random(120)])
def test_eigenvectors(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))
    a = (q * values) @ q.T
    e, x = lobpcg.largest(lambda b: a @ b, len(values), min(16, len(values)))
    assert np.abs(e - np.sort(values)[::-1][:16]).max() < 1e-12 * max(values)
    assert np.abs(a @ x - x * e).max() < 1e-12 * max(values)
    assert np.abs(x.T @ x - np.eye(x.shape[1])).max() < 1e-12


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    got = op11_embedding_whitening(spark, folder).orderBy("vec_id", "component").toPandas()
    n, deviation, explained, want = plain(rows, 64)
    assert got.vec_id.tolist() == [i for i, _ in rows for _ in range(16)] and got.component.tolist() == list(range(1, 17)) * len(rows)
    assert (got.n == n).all() and got.deviation.tolist() == np.repeat(deviation, 16).tolist()
    assert np.abs(got.explained.to_numpy()[:16] / explained - 1).max() < 1e-10
    out = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(out - want * np.sign((out * want).sum(0))).max() < 1e-8
    assert got.identity_error.max() < 1e-10 and got.identity_error.nunique() == 1


def test_odd_rows_and_copies(spark):
    nan = float("nan")
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(40)] + [(100, [0.5, 1.0]), (101, [0.5, 1.0, 0.0, 0.0, 0.0]), (102, []), (None, [1.0] * 5)] + [(7, [9.0, 1.0, 2.0, 3.0, 4.0])] * 300
    bad = [(200, None), (201, [nan] * 5), (202, [1.0, None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1.0, "z") for r in rows + bad], "vec_id long, embedding array<double>, whitened double, n string").repartition(6)
    got = whitened(df).toPandas()
    n, deviation, explained, want = plain(rows, 5)
    assert len(got) == 5 * len(rows) and (got.n == n).all() and n == 44  # padding makes 100 and 101 equal
    for key, at in ((100, 40), (101, 41), (102, 42), (7, 44)):
        own = got[got.vec_id == key].sort_values("component") if key != 7 else got[(got.vec_id == 7) & (got.deviation == deviation[44])].sort_values("component")[::300]
        assert (own.deviation == deviation[at]).all() and np.abs(np.abs(own.whitened) - np.abs(want[at])).max() < 1e-9
    assert np.abs(np.sort(got.explained.unique())[::-1] - explained).max() < 1e-12 and got.vec_id.isna().sum() == 5


def test_no_spread(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])], [(1, None)]):
        assert whitened(spark.createDataFrame(rows, kind)).count() == 0
    flat = whitened(spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i]) for i in range(9)], kind)).toPandas()
    assert set(flat.component) == {1} and np.abs(flat.whitened.std(ddof=0) - 1) < 1e-9  # two of three eigenvalues are zero


def test_large_values(spark):
    df = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e9, 1e9]), (2, [3.0, 5.0])], "vec_id long, embedding array<double>")
    assert max(max(r.x) for r in scaled(df).collect()) == 1 << 62
    got = whitened(df).toPandas()
    assert (got[got.vec_id == 0].deviation == LARGEST).all() and np.isfinite(got.whitened).all()
