import numpy as np
import pytest

from ledgerloom.llm.quality import Classifier, decided, drop_low_quality, op6_quality_classifier, rates


def test_held_out(spark):
    """Half of the labels fit, the other half judge."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    good = np.array([r.quality == 1 and not r.toxic for r in rows])
    fit = np.arange(len(rows)) % 2 == 0
    c = Classifier([r.text for r, f in zip(rows, fit) if f], good[fit])
    p = np.array([c.log_odds(r.text) for r in rows])[~fit] > 0
    want = good[~fit]
    print("kept of good", (p & want).sum() / want.sum(), "rejected of bad", (~p & ~want).sum() / (~want).sum())
    assert (p & want).sum() / want.sum() > 0.99 and (~p & ~want).sum() / (~want).sum() > 0.85


def plain_rates(groups):
    """groups: {(host, path): [p]}; the same formulas over plain lists."""
    n = sum(map(len, groups.values()))
    host = {}
    for (h, _), p in groups.items():
        host.setdefault(h, []).extend(p)
    mean = sum(map(sum, groups.values())) / n
    ss = lambda of, centre: sum(sum((x - centre(k)) ** 2 for x in p) for k, p in of.items())
    m = lambda p: sum(p) / len(p)

    def pull(within, between, g, above, spread):
        inner = max(within, 1e-9) / max(1, n - g)
        return min(1e6, max(1.0, inner / max((between - (g - above) * inner) / max(1e-9, spread), 1e-9)))

    k1 = pull(ss(host, lambda h: m(host[h])), sum(len(p) * (m(p) - mean) ** 2 for p in host.values()), len(host), 1, n - sum(len(p) ** 2 for p in host.values()) / n)
    k2 = pull(ss(groups, lambda k: m(groups[k])), sum(len(p) * (m(p) - m(host[h])) ** 2 for (h, _), p in groups.items()), len(groups), len(host), n - sum(len(p) ** 2 / len(host[h]) for (h, _), p in groups.items()))
    hr = {h: (sum(p) + k1 * mean) / (len(p) + k1) for h, p in host.items()}
    return {(h, q): (hr[h], (sum(p) + k2 * hr[h]) / (len(p) + k2)) for (h, q), p in groups.items()}


def test_rates(spark):
    rng = np.random.default_rng(5)
    groups = {(h, q): rng.beta(2 + 3 * i, 3 + j, 1 + 10 * i * j).tolist() for i, h in enumerate("abc") for j, q in enumerate("xyz")}
    df = spark.createDataFrame([(h, q, p) for (h, q), own in groups.items() for p in own], "host string, path string, p double")
    want = plain_rates(groups)
    for r in rates(df).collect():
        assert (r.host_rate, r.path_rate) == pytest.approx(want[r.host, r.path], rel=1e-6)


def test_posterior(spark):
    c = Classifier(["a"], np.array([True]))
    c.prior, c.weights = 0.5, np.zeros(1)
    df = spark.createDataFrame([(1, "a", "x", 2.0, 0.9), (2, "a", "x", -5.0, 0.1)], "doc_id long, host string, path string, log_odds double, p double")
    for r in decided(df, c).collect():
        x = r.log_odds - 0.5 + np.log(r.path_rate / (1 - r.path_rate))
        assert r.posterior == pytest.approx(1 / (1 + np.exp(-x))) and r.keep == (x >= 0)


def test_whole_table(spark):
    rows = op6_quality_classifier(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(0 < r.path_rate < 1 and 0 <= r.posterior <= 1 and r.keep == (r.posterior >= 0.5) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "s", None), (1, "", None, "en"), (2, "good words here", "s", "en"), (None, "BAD!!! ###", "s", "en")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, lang string, keep int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(str, drop_low_quality(docs, none).collect())) == sorted(map(str, docs.collect()))
    some = spark.createDataFrame([(2, 1, None), (1, 0, 0), (1, None, 1), (None, 1, 0)], none.schema)
    kept = drop_low_quality(docs, some)
    assert kept.columns == docs.columns and kept.count() <= 4
    assert drop_low_quality(docs.limit(0), some).count() == 0
