"""Secret scans: fixed patterns, and formats learned from what they find.

The patterns label credentials (``assign`` values, ``access`` keys, ``hex``
runs).  From at most ``examples`` distinct ones of each kind, of ``characters``
characters altogether, those with the smallest hashes of the whole table, a probabilistic automaton of the kind's
format is inferred.  Every run of 8 or more credential characters, the least that
a labelled one has, that no
pattern covers is then a candidate.  It is a ``format`` span if some automaton
finds it, its end included, as likely per symbol as automata from one half of
the kind's examples find all but the least likely hundredth of the other half;
and likelier than which character follows which in all other distinct
candidates makes it.  A run of fewer than ``SHORT`` characters tells too little for
that alone: the automaton also has to accept it, each step and the end having been seen.

Spans are of whole pattern matches, in code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows each get a
row; an empty table gives no rows; without examples of a kind (8 at least)
there is no automaton of it; the query ignores extra columns and ``redact``
keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import SYMBOLS, Automaton
from .common import Remembered, bounded_batches, materialised, table

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as every shorter run fails
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")  # as short as a labelled credential may be
LABELS = ("password", "passwd", "secret", "token", "api")
MASK = "[REDACTED]"
#: Shorter candidates have to be accepted as well.
SHORT = 16


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns, by start, then kind."""
    found = []
    lower = text.lower()
    if any(label in lower for label in LABELS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(start, characters) of runs that no fixed pattern touches."""
    found, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            found.append((m.start(), m[0]))
    return found


START = "^"  # before a candidate's first character
LITTLE = 0.1


def steps_of(text: str) -> Counter:
    """How often each character follows each other in a candidate, its start and end included."""
    return Counter(zip(START + text, text + START, strict=True))


class Formats:
    """Automata of the kinds, the least score of each, and the background."""

    def __init__(self, labelled: dict[str, list[str]], steps: Counter):
        self.steps, self.before = steps, Counter()
        for (a, _), n in steps.items():
            self.before[a] += n
        self.kinds, self.known = [], Remembered(self.fits)
        for values in (labelled[k] for k in sorted(labelled)):
            if len(values) >= 8:
                halves = values[::2], values[1::2]
                scores = sorted(s for one, other in (halves, halves[::-1]) for s in map(Automaton(one).score, other))
                self.kinds.append((Automaton(values), scores[len(scores) // 100] - 0.1))

    def usual(self, text: str) -> float:
        """Mean log2 probability of the steps as other candidates have them."""
        own, before, total = steps_of(text), Counter(START + text), 0.0
        for (a, b), n in own.items():
            here, there = max(0, self.steps[a, b] - n), max(0, self.before[a] - before[a])
            total += n * log2((here + LITTLE) / (there + LITTLE * SYMBOLS))
        return total / (len(text) + 1)

    def match(self, text: str) -> bool:
        """``fits``, remembered for words that come again."""
        return self.known[text] if len(text) <= 64 else self.fits(text)

    def fits(self, text: str) -> bool:
        scores = [(automaton.score(text), least) for automaton, least in self.kinds if len(text) >= SHORT or automaton.accepts(text)]
        scores = [score for score, least in scores if score >= least]
        return bool(scores) and max(scores) > self.usual(text)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and credentials, and candidates of every row."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())]))
    run_ = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("value", T.StringType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", span), T.StructField("candidates", run_)])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))
    runs = pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string())]))

    def run(batches):
        for batch in batches:
            base = [base_spans(t or "") for t in batch.column(1).to_pylist()]
            rest = [candidates(t or "", b) for t, b in zip(batch.column(1).to_pylist(), base, strict=True)]
            base = [[dict(zip(("start", "kind", "end", "value"), s, strict=True)) for s in b] for b in base]
            rest = [[{"start": s, "value": v} for s, v in r] for r in rest]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(rest, runs)], ["doc_id", "base", "candidates"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def learned(scans: DataFrame, examples: int = 300, characters: int = 100_000) -> Formats:
    """Formats of the table's labelled credentials.

    The driver gets ``examples`` values of each kind, none longer than
    ``characters``, and one count for each two characters, whatever the table's
    size.  In the order of their hashes, those that fit into ``characters``
    altogether are examples.
    """
    labelled: dict[str, list[str]] = {}
    values = scans.select(F.explode("base").alias("b")).select("b.kind", "b.value")
    for kind in range(3):
        own = values.filter(F.col("kind") == kind).groupBy("value").agg(F.first(F.xxhash64("value")).alias("h"))
        left, labelled[KINDS[kind]] = characters, []
        for r in own.filter(F.length("value") <= characters).orderBy("h", "value").limit(examples).collect():
            if len(r.value) <= left:
                labelled[KINDS[kind]].append(r.value)
                left -= len(r.value)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total.update(steps_of(value))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in total], pa.string()), pa.array([b for _, b in total], pa.string()), pa.array(total.values(), pa.int64())], ["a", "b", "n"])

    distinct = scans.select(F.explode("candidates.value").alias("value")).distinct()
    rows = distinct.mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Formats(labelled, Counter({(r.a, r.b): r.n for r in rows}))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_format of every row."""
    scans = materialised(scanned(docs), "scans")
    formats = scans.sparkSession.sparkContext.broadcast(learned(scans))  # a few hundred examples' states

    def run(batches):
        match = formats.value.match
        for batch in batches:
            rows = []
            for doc_id, base, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = [(b["start"], b["kind"], b["end"]) for b in base]
                more = [(c["start"], 3, c["start"] + len(c["value"])) for c in rest if match(c["value"])]
                n = Counter(k for _, k, _ in spans)
                rows.append((doc_id, n[0], n[1], n[2], hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + more), len(more)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return scans.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def redacted(text: str, formats: Formats) -> str:
    """The text with each stretch of secrets replaced by a mask."""
    base = base_spans(text)
    spans = [(s, e) for s, _, e, _ in base] + [(s, s + len(v)) for s, v in candidates(text, base) if formats.match(v)]
    out, at, masked = [], 0, -1
    for s, e in sorted(spans):
        if s >= masked:
            out += [text[at:s], MASK]
        at = masked = max(e, masked)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of all texts masked; n_chars, if there, follows a changed text."""
    formats = docs.sparkSession.sparkContext.broadcast(learned(materialised(scanned(docs), "scans")))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t and redacted(t, formats.value) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    if "n_chars" not in docs.columns:
        return docs.mapInArrow(run, docs.schema)
    own = docs.withColumn("n_chars", F.when(F.length("text") == F.col("n_chars"), F.lit(None)).otherwise(F.col("n_chars")))
    kept = own.mapInArrow(run, own.schema)
    return kept.withColumn("n_chars", F.coalesce("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))).select(docs.columns)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
