"""SimHash near-duplicates, found with a Gray-order hierarchical index.

Fingerprints within ``distance`` bits of each other agree on at least one of
``distance + 1`` parts of their bits.  Each distinct fingerprint is therefore
dealt to the groups of those that share a part with it.  A group that is still
large is dealt again by parts of its other bits, so that no task must hold the
fingerprints of one hot part.

Within a group, fingerprints are sorted by Gray rank, so that neighbours differ
in few bits.  Runs of four form nodes, runs of four nodes form upper nodes, and
so on.  A node holds the bits that all below it share and that no node above
holds yet.  A search adds up the differences on the way down and drops a whole
node once they exceed the distance.  All groups of a batch are searched at once.

A group returns no pairs but a tree over each set of fingerprints that are
linked in it, in which no fingerprint has more than 17 links.  Trees of all
groups meet in ``connected_components``.

Defined results: a null text is empty; a text without words has fingerprint
zero, which links like any other; repeated rows each get a row; a component's
id is its smallest non-null doc_id, or null if it has none; an empty table
gives no rows.  Other columns are ignored by the query and kept by
``drop_near_duplicates``.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialised, table
from .components import connected_components

BITS, FANOUT, SEED = 64, 4, 42
#: A group with more fingerprints is dealt again, at most LEVELS times in all.
GROUP, LEVELS = 256, 3


def fingerprint(text: str, words_each: int = 3) -> int:
    """The 64-bit fingerprint over all word shingles of a whole text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_each + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(min(words_each, len(words)))), strict=True))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id and fingerprint, as a long with the same bits, of every row."""

    def run(batches):
        for batch in batches:
            codes = np.array([fingerprint(t or "", words_each) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    bounded_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("code", T.LongType())])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def parts(path: tuple[int, ...], pieces: int) -> tuple[int, list[int]]:
    """The bits on which the group at ``path`` agrees, as a mask, and its other bits."""
    free, mask = list(range(BITS)), 0
    for choice in path:
        cut = [len(free) * i // pieces for i in range(pieces + 1)]
        mask |= sum(1 << b for b in free[cut[choice] : cut[choice + 1]])
        free = free[: cut[choice]] + free[cut[choice + 1] :]
    return mask, free


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of each a and b; a set's label is its smallest member."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        low, high = np.minimum(la[apart], lb[apart]), np.maximum(la[apart], lb[apart])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


class GrayIndex:
    """Hierarchical indexes over many groups of codes, one beside another."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.group, self.codes = group[order], codes[order]
        shared, values = np.full(len(codes), ~np.uint64(0)), self.codes
        owner, self.levels = self.group, []  # from the leaves upwards: mask, values, first child, children
        first, count = np.arange(len(codes)), np.ones(len(codes), np.int64)
        while True:
            self.levels.append([shared, values, first, count])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            if sizes.max() == 1:
                break
            within = np.arange(len(owner)) - np.repeat(starts, sizes)
            first = np.flatnonzero(within % FANOUT == 0)
            count = np.diff(np.r_[first, len(owner)])
            all_, any_ = np.bitwise_and.reduceat(values, first), np.bitwise_or.reduceat(values, first)
            shared = np.bitwise_and.reduceat(shared, first) & ~(all_ ^ any_)
            values, owner = all_, owner[first]
        for upper, lower in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            lower.append(lower[0] & ~np.repeat(upper[0], upper[3]))  # the bits that no node above holds
        self.levels[-1].append(self.levels[-1][0])
        self.root = np.cumsum(np.r_[True, self.group[1:] != self.group[:-1]]) - 1

    def pairs(self, at: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, found) of codes of the query's group, beyond it in Gray order, within the distance."""
        query, node, seen = at, self.root[at], np.zeros(len(at), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            _, values, first, count, own = self.levels[level]
            seen = seen + np.bitwise_count((self.codes[query] ^ values[node]) & own[node])
            near = seen <= distance
            query, node, seen = query[near], node[near], seen[near]
            if level:
                n = count[node]
                child = np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
                query, node, seen = np.repeat(query, n), child, np.repeat(seen, n)
        later = node > query
        return query[later], node[later]

    def forest(self, distance: int, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Links that join the same codes as all pairs do, with few links at each code."""
        label = np.arange(len(self.codes))
        for start in range(0, len(self.codes), at_once):
            label = merge_labels(label, *self.pairs(np.arange(start, min(start + at_once, len(self.codes))), distance))
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1]])
        begin = np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        within = np.arange(len(order)) - begin
        child = within > 0
        parent = begin + (within - 1) // 16
        return self.codes[order[child]], self.codes[order[parent[child]]]


def links(codes: DataFrame, distance: int) -> DataFrame:
    """u and v: links that join the same codes as all pairs of ``codes`` within the distance do."""
    pieces = distance + 1
    dealt = lambda df, paths: df.select("code", F.explode(F.array(*(F.struct(F.lit(n).alias("path"), F.expr(f"code & {signed(m)}L").alias("bits")) for n, m in paths))).alias("g")).select("code", "g.*")
    numbered = [(i,) for i in range(pieces)]  # the paths of this level; a row's path is a number among all paths
    name = {p: i for i, p in enumerate(numbered)}
    rows, ready = dealt(codes, [(name[p], parts(p, pieces)[0]) for p in numbered]), []
    for level in range(1, LEVELS + 1):
        sizes = materialised(rows.groupBy("path", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
        last = level == LEVELS
        ready.append(rows.join(sizes if last else sizes.filter(F.col("n") <= GROUP), ["path", "bits"]).select("code", "path", "bits"))
        if last or not sizes.filter(F.col("n") > GROUP).limit(1).count():
            break
        hot = rows.join(sizes.filter(F.col("n") > GROUP), ["path", "bits"]).select("code", "path")
        deeper = []
        for p in numbered:
            below = [(*p, i) for i in range(pieces)]
            name |= {q: len(name) + i for i, q in enumerate(below)}
            deeper.append(dealt(hot.filter(F.col("path") == name[p]), [(name[q], parts(q, pieces)[0]) for q in below]))
        numbered = [(*p, i) for p in numbered for i in range(pieces)]
        rows = deeper[0]
        for more in deeper[1:]:
            rows = rows.unionByName(more)
    grouped = ready[0]
    for more in ready[1:]:
        grouped = grouped.unionByName(more)

    def run(batches):
        held, n = [], 0

        def searched(batch):
            path, bits, code = (batch.column(c).to_numpy() for c in ("path", "bits", "code"))
            group = np.cumsum(np.r_[True, (path[1:] != path[:-1]) | (bits[1:] != bits[:-1])])
            u, v = GrayIndex(group, code.view(np.uint64)).forest(distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= 40_000:
                whole = pa.Table.from_batches(held).combine_chunks()
                path, bits = whole["path"].to_numpy(), whole["bits"].to_numpy()
                ends = np.flatnonzero((path[1:] != path[:-1]) | (bits[1:] != bits[:-1]))
                cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on
                if cut:
                    yield searched(whole.slice(0, cut))
                held, n = whole.slice(cut).to_batches(), len(whole) - cut
        if n:
            yield searched(pa.Table.from_batches(held))

    return grouped.repartition("path", "bits").sortWithinPartitions("path", "bits").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words_each: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``."""
    marked = materialised(fingerprints(docs, words_each), "fingerprints")
    codes = materialised(marked.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    found = connected_components(links(codes.select("code"), distance)).withColumnRenamed("node", "code")
    rooted = codes.join(found, "code", "left").withColumn("root", F.coalesce("root", "code"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(least, "root").select("code", "component_id")
    return marked.join(component, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words_each: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id.

    Rows without a doc_id are kept.  Of rows that share doc_id and text one is kept.
    """
    found = materialised(near_duplicates(docs, words_each, distance), "near")
    kept = docs.join(found.select(F.col("component_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(docs.columns)
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole documents whose fingerprints differ in two bits at most."""
    return near_duplicates(table(spark, sf_dir, "documents"))
