"""Quality classifier: a document's evidence combined with its site's record by hierarchical empirical Bayes.

A logistic classifier over the shape of a text (case, marks, digits, repeated
lines and words) and over telling words is fitted on at most ``sample`` labelled
documents, those with the smallest hashes of their doc_id; a document is good if
its quality is 1 and it is not toxic.  The classifier's log odds less those of
the sample's prior are the document's evidence.

Hosts (``source``) and paths in them (``source``, ``lang``) get posterior rates
from grouped sums of all documents' probabilities: a path's mean is shrunk
towards its host's, and a host's towards the global mean, the more the fewer
documents it has.  How far follows from the variances within and between groups.
A document's posterior is its evidence on top of its path's rate; it is kept at
one half or more.

Defined results: null and empty texts are scored as texts without words; a null
source or lang counts as ""; without labels of both classes the evidence is
zero and all documents are kept; repeated rows are scored one by one; an empty
table gives no rows.  ``drop_low_quality`` keeps all columns.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialised, table

UPPER, LOWER, DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
MARKS = b"!|#$%&*@^~<>{}[]=+_\\/"


#: Lower-cases A-Z and turns ASCII marks to spaces.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(PLAIN).split()


def marks_of(distinct: set[bytes]) -> set[bytes]:
    """Distinct words and, after a caret, their first six bytes."""
    return distinct | {b"^" + w[:6] for w in distinct}


def shape(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Numbers that describe a text's shape."""
    n, lines = max(1, len(raw)), raw.split(b"\n")
    without = lambda some: (len(raw) - len(raw.translate(None, some))) / n
    return [
        math.log1p(len(words)), without(UPPER), without(DIGIT), without(MARKS), without(b"!"), without(b"|"), without(b".,;:"),
        distinct / max(1, len(words)), len(set(lines)) / len(lines), n / (1 + len(words)) / 10, math.log1p(n / len(lines)),
    ]


class Classifier:
    """Log odds that a text is good."""

    def __init__(self, texts: list[str], good: np.ndarray, words: int = 200, rounds: int = 300):
        self.prior = 0.0
        self.words: dict[bytes, float] = {}
        if not len(texts) or good.all() or not good.any():
            self.weights = None
            return
        self.prior = math.log(good.mean() / (1 - good.mean()))
        # Texts are parsed twice, so that the words of all of them are never held at once.
        x, among = np.zeros((len(texts), 11)), [Counter(), Counter()]
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            own = words_of(raw)
            distinct = set(own)
            x[i] = shape(raw, own, len(distinct))
            among[int(good[i])].update(marks_of(distinct))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        n0, n1 = (~good).sum(), good.sum()
        score = lambda w, a, b: (abs(b / n1 - a / n0) / math.sqrt(a + b), w)
        often = ((w, among[0][w], among[1][w]) for w in among[0].keys() | among[1].keys())
        telling = heapq.nlargest(words, (score(w, a, b) for w, a, b in often if a + b >= 5))
        del among
        chosen = {w: i for i, (_, w) in enumerate(telling)}
        seen = np.zeros((len(texts), len(chosen)), np.float32)
        for i, text in enumerate(texts):
            seen[i, [chosen[w] for w in chosen.keys() & marks_of(set(words_of((text or "").encode())))]] = 1
        z = np.hstack((np.ones((len(texts), 1)), (x - self.mean) / self.scale, seen)).astype(np.float32)
        weight, m1, m2 = np.zeros(z.shape[1], np.float32), 0.0, 0.0
        decay = np.r_[0, np.full(x.shape[1], 1e-4), np.full(len(chosen), 5e-4)].astype(np.float32)
        weight[0] = self.prior
        for k in range(1, rounds + 1):
            g = z.T @ (1 / (1 + np.exp(-np.clip(z @ weight, -30, 30))) - good) / len(texts) + decay * weight
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            weight -= 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        self.weights = weight[: 1 + x.shape[1]].astype(float)
        self.words = {w: float(weight[1 + x.shape[1] + i]) for w, i in chosen.items()}

    def log_odds(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        raw = (text or "").encode()
        words = words_of(raw)
        distinct = set(words)
        value = self.weights[0] + self.weights[1:] @ ((shape(raw, words, len(distinct)) - self.mean) / self.scale)
        return float(value + math.fsum(map(self.words.__getitem__, self.words.keys() & marks_of(distinct))))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Classifier:
    """The classifier over at most ``sample`` labelled documents."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("fine"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # broadcast: ``sample`` rows at most
    # Of rows that share a doc_id the least text counts; a text comes to the driver alone.
    rows = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("fine").alias("fine"), F.first("toxic").alias("toxic")).orderBy("doc_id").toLocalIterator()
    texts, good = [], []
    for r in rows:
        texts.append(r.text)
        good.append(bool(r.fine and not r.toxic))
    return Classifier(texts, np.array(good, bool))


def with_log_odds(docs: DataFrame, classifier: Classifier, column: str) -> DataFrame:
    """``docs`` with the classifier's log odds in ``column``."""
    bounded_batches(docs.sparkSession)
    own, at = docs.sparkSession.sparkContext.broadcast(classifier), docs.columns.index("text")

    def run(batches):
        score = own.value.log_odds
        for batch in batches:
            value = pa.array([score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(column, T.DoubleType())]))


def rates(scored: DataFrame) -> DataFrame:
    """host, path, host_rate and path_rate from the documents' probabilities in ``p``."""
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")]
    paths = materialised(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(*sums, F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k"))
    t = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("b").alias("b_paths"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("k").alias("paths"), F.count("*").alias("hosts"), F.sum(F.col("n2") / F.col("n")).alias("n2_in")).first()
    n = max(1, t.n or 0)
    mean = (t.s or 0.0) / n

    def pull(between: float, within: float, groups: int, above: int, spread: float) -> float:
        """How many documents the level above counts for: variance within groups over variance between them."""
        inner = max(within, 1e-9) / max(1, n - groups)
        outer = (between - (groups - above) * inner) / max(1e-9, spread)
        return min(1e6, max(1.0, inner / max(outer, 1e-9)))

    host_pull = pull((t.b or 0) - n * mean * mean, (t.q or 0) - (t.b or 0), t.hosts or 0, 1, n - (t.n2 or 0) / n)
    path_pull = pull((t.b_paths or 0) - (t.b or 0), (t.q or 0) - (t.b_paths or 0), t.paths or 0, t.hosts or 0, n - (t.n2_in or 0))
    host = hosts.select("host", ((F.col("s") + host_pull * mean) / (F.col("n") + host_pull)).alias("host_rate"))
    return paths.join(host, "host").select("host", "path", "host_rate", ((F.col("s") + path_pull * F.col("host_rate")) / (F.col("n") + path_pull)).alias("path_rate"))


def _p(log_odds):
    return 1 / (1 + F.exp(-log_odds))


def _site(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def posteriors(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """doc_id, host, path, log_odds, host_rate, path_rate, posterior and keep of every row."""
    classifier = fitted(docs, labels, sample)
    odds = with_log_odds(docs.select("doc_id", "source", "lang", "text"), classifier, "log_odds")
    scored = odds.select("doc_id", _site("source").alias("host"), _site("lang").alias("path"), "log_odds", _p(F.col("log_odds")).alias("p"))
    return decided(materialised(scored, "scored"), classifier)


def decided(scored: DataFrame, classifier: Classifier, from_: DataFrame | None = None) -> DataFrame:
    """``scored`` with rates, posterior and keep; the rates come from ``from_`` or ``scored`` itself."""
    prior = (F.greatest(F.least("path_rate", F.lit(1 - 1e-6)), F.lit(1e-6))) if classifier.weights is not None else F.lit(1 - 1e-6)
    joined = scored.join(rates(scored if from_ is None else from_), ["host", "path"])
    posterior = _p(F.col("log_odds") - classifier.prior + F.log(prior / (1 - prior)))
    return joined.withColumn("posterior", posterior).withColumn("keep", F.col("posterior") >= 0.5).drop("p")


def drop_low_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps.

    Texts are scored twice, once for the sites' rates and once beside the
    documents, so that whole texts are neither shuffled nor written.
    """
    classifier = fitted(docs, labels, sample)
    slim = with_log_odds(docs.select("source", "lang", "text"), classifier, "log_odds").select(_site("source").alias("host"), _site("lang").alias("path"), _p(F.col("log_odds")).alias("p"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"), _site("source").alias("host"), _site("lang").alias("path"))
    return decided(with_log_odds(whole, classifier, "log_odds").drop("text"), classifier, slim).filter("keep").select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every whole document."""
    found = posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "host", "path", "log_odds", "host_rate", "path_rate", "posterior", "keep")
