"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, by doc_id, form blocks of ``block_docs``.  A source of
weight w releases its block k at slot floor(k / w), to be served before slot
ceil((k + 1) / w).  In each slot the released block with the earliest deadline
is served, so that after t slots a source has been served less than one block
more or less than t * w times.

Weights are taken exactly: numbers by their decimal digits, or fractions.  Over
their common denominator they are whole parts, and the schedule repeats after
as many slots as there are parts; one period, or the slots until a source ends
if these are fewer, is made on the driver, whatever the corpus, and a block's
slot follows from its number by arithmetic.  When a source ends, the others'
weights are scaled up and a new phase begins, so no document is dropped or
repeated.  Sources of weight 0 share the slots, in equal parts, when all others
have ended.  Numbers of documents within a source come from a range
partitioning by source and doc_id, with per-partition counts, so a hot source
is never one task.

Defined results: a null source counts as ""; rows that share source and doc_id
count as one document and stay together; a null doc_id comes first; an empty
table gives no rows; a negative weight is an error.  Where exact weights need more
than ``most`` slots to keep, blocks are doubled until they fit: the weights stay exact, and
the deviation stays below one block.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, table


class TooManySlots(ValueError):
    """A schedule that is not kept: it needs larger blocks."""


def whole_parts(weights: dict[str, float], parts: int) -> dict[str, int]:
    """Weights as whole parts, at least one each, of ``parts`` in all (more if there are more sources)."""
    parts = max(parts, len(weights))
    total = sum(weights.values()) or 1.0
    exact = {s: 1 + w / total * (parts - len(weights)) for s, w in weights.items()}
    found = {s: int(x) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (found[s] - exact[s], s))
    for s in rest[: parts - sum(found.values())]:
        found[s] += 1
    return found


def period(parts: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period, by earliest deadline first among released blocks."""
    total, slots = sum(parts.values()), {s: [] for s in parts}
    releases = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(releases)
    ready: list[tuple[int, str, int]] = []
    for slot in range(total):
        while releases and releases[0][0] <= slot:
            _, s, k = heapq.heappop(releases)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < parts[s]:
            heapq.heappush(releases, ((k + 1) * total // parts[s], s, k + 1))
    return slots


def exact_parts(weights: dict) -> dict[str, int]:
    """Weights over their common denominator, without a common factor."""
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    if min(exact.values(), default=0) < 0:
        raise ValueError("a weight is negative")
    whole = math.lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * whole) for s, w in exact.items()}
    common = math.gcd(*parts.values()) or 1
    return {s: n // common for s, n in parts.items()}


def served(parts: dict[str, int], blocks: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source in one period, or until the first source has ended, by earliest deadline first."""
    total, slots, left = sum(parts.values()), {s: [] for s in parts}, dict(blocks)
    releases = [(0, s, 0) for s in sorted(parts)]
    ready: list[tuple[int, str, int]] = []
    for slot in range(total):
        while releases and releases[0][0] <= slot:
            _, s, k = heapq.heappop(releases)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        left[s] -= 1
        if not left[s]:
            break
        if k + 1 < parts[s]:
            heapq.heappush(releases, ((k + 1) * total // parts[s], s, k + 1))
    return {s: np.array(x, np.int64) for s, x in slots.items()}


def phases(parts: dict[str, int], blocks: dict[str, int], most: int = 20_000_000) -> list[dict]:
    """For each phase: its first slot, its period, each source's first block and the period's slots."""
    left, done, first, found, kept = dict(blocks), dict.fromkeys(blocks, 0), 0, [], 0
    while left := {s: n for s, n in left.items() if n > 0}:
        own = {s: parts[s] for s in left if parts[s] > 0} or dict.fromkeys(left, 1)
        own = exact_parts(own)
        total = sum(own.values())
        kept += min(total, sum(left[s] for s in own))
        if kept > most:
            raise TooManySlots(f"the weights' schedule has more than {most} slots to keep")
        slots = served(own, {s: left[s] for s in own})
        if sum(map(len, slots.values())) < total:  # a source has ended within the period
            ends = max(int(x[-1]) for x in slots.values() if len(x))
        else:
            ends = min((left[s] - 1) // own[s] * total + int(slots[s][(left[s] - 1) % own[s]]) for s in own)
        found.append({"first": first, "total": total, "base": {s: done[s] for s in own}, "slots": slots, "parts": own})
        rounds, rest = divmod(ends + 1, total)
        for s in own:
            n = rounds * own[s] + int(np.searchsorted(slots[s], rest))
            left[s] -= n
            done[s] += n
        first += ends + 1
    return found


def schedule(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block_docs: int = 16, parts: int | None = None, most: int = 20_000_000) -> DataFrame:
    """source, doc_id, phase, block, release, deadline, slot and nth of every document.

    Without ``weights`` a source's weight is its number of documents to the
    ``power``, in whole hundredths of the largest source's, 1 at least.  Sources
    that ``weights`` leaves out have weight 0.  With ``parts`` the weights are
    rounded to so many parts, one at least for each source.  Blocks are of
    ``block_docs`` documents, or a power of two times as many where ``most`` slots would not do.  ``nth`` is the document's place in its block; (slot, nth) is the
    order of the mix.
    """
    spark = docs.sparkSession
    keys = docs.select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("long")).distinct()
    dealt = keys.repartitionByRange("source", F.col("doc_id").asc_nulls_first()).sortWithinPartitions("source", F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())

    def number(batches):
        last, n = None, 0
        for pdf in batches:
            source = pdf["source"].to_numpy()
            change = np.r_[True, source[1:] != source[:-1]] if len(pdf) else np.array([], bool)
            starts = np.flatnonzero(change)
            within = np.arange(len(pdf)) - np.repeat(starts, np.diff(np.r_[starts, len(pdf)]))
            if len(pdf) and source[0] == last:
                head = starts[1] if len(starts) > 1 else len(pdf)
                within[:head] += n
            if len(pdf):
                last, n = source[-1], within[-1] + 1
            yield pdf.assign(at=within.astype("int64"))

    numbered = materialised(dealt.mapInPandas(number, "source string, doc_id long, part int, at long"), "numbered")
    counts = numbered.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sizes = {r.source: r.n for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    largest = max(sizes.values(), default=1)
    given = {s: weights.get(s, 0) for s in sizes} if weights else {s: max(1, round(100 * (n / largest) ** power)) for s, n in sizes.items()}
    own = whole_parts({s: max(0.0, float(w)) for s, w in given.items()}, parts) if parts else exact_parts(given)
    while True:
        try:
            kept = phases(own, {s: -(-n // block_docs) for s, n in sizes.items()}, most)
            break
        except TooManySlots:
            if block_docs > largest:  # each source is one block
                raise
            block_docs *= 2
    plan = spark.sparkContext.broadcast(kept)  # 8 bytes a slot, ``most`` slots

    def place(batches):
        for pdf in batches:
            found = []
            for source, rows in pdf.groupby("source", sort=False):
                at = (rows["at"] + rows["base"]).to_numpy()
                block = at // block_docs
                out = pd.DataFrame({"source": source, "doc_id": rows["doc_id"], "phase": -1, "block": block, "release": 0, "deadline": 0, "slot": 0, "nth": at % block_docs})
                for k, p in enumerate(plan.value):
                    if source in p["base"]:
                        here = block >= p["base"][source]
                        j, w, total = block[here] - p["base"][source], p["parts"][source], p["total"]
                        out.loc[here, "phase"] = k
                        out.loc[here, "release"] = p["first"] + j * total // w
                        out.loc[here, "deadline"] = p["first"] - (-(j + 1) * total // w)
                        slots = p["slots"][source]  # shorter than a period if the phase ends first; blocks behind go to later phases
                        out.loc[here, "slot"] = p["first"] + j // w * total + slots[np.minimum(j % w, len(slots) - 1)] if len(slots) else 0
                found.append(out)
            yield pd.concat(found) if found else pd.DataFrame(columns=["source", "doc_id", "phase", "block", "release", "deadline", "slot", "nth"])

    return numbered.join(offsets, ["source", "part"]).mapInPandas(place, "source string, doc_id long, phase int, block long, release long, deadline long, slot long, nth long")


def mixed(docs: DataFrame, then: tuple[str, ...] = (), **how) -> DataFrame:
    """``docs`` in the order of the mix: partitions are ranges of slots, sorted by slot; rows of one place by the columns ``then``."""
    plan = schedule(docs, **how).select(F.struct("source", "doc_id").alias("_key"), F.struct("slot", "nth").alias("_at"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.struct(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id")).alias("_key"))
    # Neither the documents nor the schedule are small, so both are dealt by key at every size.
    return keyed.join(plan.hint("merge"), "_key").select("_row", "_at").repartitionByRange("_at").sortWithinPartitions("_at", *(f"_row.{c}" for c in then)).select("_row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document, sources weighted by the square root of their size."""
    return schedule(table(spark, sf_dir, "documents").select("source", "doc_id"))
