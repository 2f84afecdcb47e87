"""Lookups between artifacts, written as equi-joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.packages import is_archive, match_score, stem
from ..model import ALIAS_TO


def claimed(artifacts: DataFrame, claimers: list[tuple[str, Column]], otherwise: str = "generic") -> DataFrame:
    """Each artifact goes to the first claimer whose condition holds; a single pass without residual joins."""
    out = F
    for name, condition in claimers:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return artifacts.withColumn("strategy", out.otherwise(otherwise))


def residual(artifacts: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    """Artifacts that no multi-row claimer took."""
    return artifacts.join(taken.select(key).distinct(), key, "left_anti")


def companions(files: DataFrame) -> DataFrame:
    """Each archive (path) with the paths of its pom, sources and javadoc, and of its folder's metadata file.

    One aggregation by stem collects the companions; no self-join is needed.
    """
    name, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "[^/]*$", "")
    pick = lambda condition: F.min(F.when(condition, F.col("path")))
    whole = F.regexp_replace(stem(F.col("path")), "-(sources|javadoc)$", "")
    by_stem = files.select("path", whole.alias("stem"), folder.alias("folder"), name.alias("name"))
    grouped = by_stem.groupBy("stem", "folder").agg(
        F.collect_set(F.when(is_archive(F.col("name")), F.col("path"))).alias("archives"),
        pick(F.col("name").endswith(".pom")).alias("pom"),
        pick(F.col("name").endswith("-sources.jar")).alias("sources"),
        pick(F.col("name").endswith("-javadoc.jar")).alias("javadoc"),
    )
    meta = by_stem.filter(F.col("name") == "maven-metadata.xml").groupBy("folder").agg(F.min("path").alias("metadata"))
    return grouped.select(F.explode("archives").alias("path"), "folder", "pom", "sources", "javadoc").join(meta, "folder", "left").drop("folder")


def augmented(aliases: DataFrame, ancestors: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, key, value) of each change whose hash is an alias of the item, in its own scope or an ancestor's.

    aliases: id, hash.  ancestors: id, scope (an item is its own scope).  changes: scope, hash, key, value.
    """
    scoped = aliases.join(ancestors, "id")
    return scoped.join(changes, ["scope", "hash"]).select("id", "key", "value").distinct()


def resolved(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Items for alias identifiers (name), themselves where they are no alias."""
    to = edges.filter(F.col("edge_type") == ALIAS_TO).select(F.col("src").alias("name"), "dst")
    return names.join(to, "name", "left").select("name", F.coalesce("dst", "name").alias("id"))


def references(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The file for each reference: that of the whole path, else the first path with its base name."""
    base = lambda c: F.substring_index(c, "/", -1)
    by_name = files.groupBy(base("path").alias("name")).agg(F.min("path").alias("by_name"))
    exact = files.select(F.col("path").alias("reference"), F.col("path").alias("exact")).distinct()
    found = wanted.withColumn("name", base("reference")).join(exact, "reference", "left").join(by_name, "name", "left")
    return found.withColumn("path", F.coalesce("exact", "by_name")).drop("name", "exact", "by_name")


def primary(embedded: DataFrame) -> DataFrame:
    """For each archive (jar, name) its best embedded (group_id, artifact_id, version); none if nothing matches."""
    scored = embedded.withColumn("score", match_score(F.col("artifact_id"), F.col("name"))).filter("score > 0")
    best = Window.partitionBy("jar").orderBy(F.desc("score"), F.desc(F.length("artifact_id")), "artifact_id", "group_id", "version")
    return scored.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def shared(contains: DataFrame, least: int = 2) -> DataFrame:
    """Contents (dst) of several containers (src), with their number."""
    return contains.distinct().groupBy("dst").agg(F.count("*").alias("holders")).filter(F.col("holders") >= least)


def markers(contains: DataFrame) -> DataFrame:
    """Contents that exactly one container has: (src, dst)."""
    return contains.distinct().groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("src")).filter("n = 1").select("src", "dst")


def overlap(contains: DataFrame, marks: DataFrame) -> DataFrame:
    """For each container the share of another's markers that it holds: (holder, of, found, share)."""
    size = marks.groupBy("src").agg(F.count("*").alias("size"))
    held = contains.select(F.col("src").alias("holder"), "dst").distinct().join(marks.select(F.col("src").alias("of"), "dst"), "dst")
    found = held.groupBy("holder", "of").agg(F.count("*").alias("found"))
    return found.join(size.withColumnRenamed("src", "of"), "of").select("holder", "of", "found", (F.col("found") / F.col("size")).alias("share"))


def needles_in(texts: DataFrame, needles: list[str], column: str = "text") -> DataFrame:
    """(id, needle) of each text that holds a needle; the fixed list is one expression in one pass."""
    own = F.filter(F.array(*map(F.lit, needles)), lambda n: F.col(column).contains(n))
    return texts.select("id", F.explode(own).alias("needle"))


def holding(texts: DataFrame, needles: DataFrame, most: int = 16 << 20) -> DataFrame:
    """J12 with a table of needles: (id, item_id) of each text that holds a needle whole.

    Needles form blocks of about ``most`` characters.  Each block becomes one
    automaton, which finds all of its needles in one pass over the texts; only
    one block at a time is on the driver.  Empty and null needles are in no text.
    """
    needles = needles.filter("needle <> ''").select("item_id", "needle")
    blocks = max(1, -(-(needles.agg(F.sum(F.length("needle"))).first()[0] or 0) // most))
    kind = texts.schema["id"].dataType, needles.schema["item_id"].dataType
    schema = T.StructType([T.StructField("id", kind[0]), T.StructField("item_id", kind[1])])

    def found_in(block: int) -> DataFrame:
        known: dict[str, list] = {}
        for r in needles.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block).toLocalIterator():
            known.setdefault(r.needle, []).append(r.item_id)
        own = texts.sparkSession.sparkContext.broadcast(known)

        def run(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for needle, ids in own.value.items():
                automaton.add_word(needle, ids)
            automaton.make_automaton()
            for batch in batches:
                found = [(i, item) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text and own.value for item in {x for _, ids in automaton.iter(text) for x in ids}]
                a, b = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, to_arrow_type(kind[1]))], ["id", "item_id"])

        return texts.select("id", "text").mapInArrow(run, schema)

    whole = found_in(0)
    for block in range(1, blocks):
        whole = whole.unionByName(found_in(block))
    return whole.distinct()
