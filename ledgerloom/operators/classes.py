"""Class files: what they were built from (J04), and module descriptors.

A class is asked for its source only where its archive has a companion with sources.  Contents are read once, however many
archives hold them; classes and sources meet by equi-joins on the pair of archives and the path, so no archive
is ever one row.

Defined results: a class without a source file's name, or whose path the companion lacks, has no edge; of
several sources under one path the least identifier counts; what is no class file has no facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BUILT_FROM
from ..sources import records as rec
from .joins import companions
from .keymaterial import long_form, place
from .merge import name_map


def class_facts(rows: DataFrame) -> DataFrame:
    """id, class_name and source_path, the path of the source that a class names, package first."""
    one = lambda n: F.max(F.when((F.size("path") == 1) & (place(0) == n), F.try_validate_utf8("value")))
    found = rows.groupBy("id").agg(one(rec.CLASS).alias("class_name"), one(rec.SOURCE).alias("source"))
    return found.select("id", "class_name", F.concat(F.regexp_replace("class_name", "[^/]*$", ""), "source").alias("source_path"))


def paired(archives: DataFrame) -> DataFrame:
    """Jar and sources, both ids, of archives (id, path, scope) that have a companion with sources beside them in one scope."""
    scoped = archives.withColumn("path", F.concat_ws("|", F.coalesce("scope", F.lit("")), "path"))
    found = companions(scoped.select("path").distinct()).filter("sources is not null").select("path", F.col("sources").alias("sources_path"))
    ids = scoped.select("path", "id").distinct()
    return found.join(ids, "path").join(ids.select(F.col("path").alias("sources_path"), F.col("id").alias("sources")), "sources_path").select(F.col("id").alias("jar"), "sources").distinct()


def source_edges(classes: DataFrame, facts: DataFrame, pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges from each class to the source it was built from.

    classes: jar, id.  facts: id, source_path.  pairs: jar, sources.  sources: sources, path, id.
    """
    known = name_map(sources.withColumnRenamed("sources", "scope")).select(F.col("scope").alias("sources"), F.col("path").alias("source_path"), F.col("id").alias("dst"))
    asked = classes.join(facts.filter("source_path is not null").select("id", "source_path"), "id").join(pairs, "jar")
    return asked.join(known, ["sources", "source_path"]).select(F.col("id").alias("src"), F.lit(BUILT_FROM).alias("edge_type"), "dst").distinct()


def module_facts(rows: DataFrame) -> DataFrame:
    """(id, key, value) of module descriptors; lists as JSON, names with dots."""
    dotted = F.translate(F.try_validate_utf8("value"), "/", ".")
    # What belongs to one part of one module: as many as a module names.
    many = lambda n: F.transform(F.array_sort(F.collect_list(F.when((place(0) == n) & (F.size("path") == 2), F.struct(place(1).alias("j"), dotted.alias("s"))))), lambda x: x["s"])
    one = lambda j: F.max(F.when((place(0) == rec.MODULE) & (place(1) == j), F.try_validate_utf8("value")))
    provided = rows.filter(place(0) == rec.PROVIDES).groupBy("id", place(1).alias("j")).agg(
        F.max(F.when(F.size("path") == 2, dotted)).alias("service"), F.transform(F.array_sort(F.collect_list(F.when(F.size("path") == 3, F.struct(place(2).alias("k"), dotted.alias("s"))))), lambda x: x["s"]).alias("by"))
    provided = provided.groupBy("id", "service").agg(F.array_distinct(F.flatten(F.sort_array(F.collect_list("by")))).alias("by"))
    entries = provided.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("service", "by"))).alias("e"))
    own = rows.groupBy("id").agg(one(0).alias("name"), *(many(n).alias(k) for n, k in ((rec.REQUIRES, "requires"), (rec.EXPORTS, "exports"), (rec.OPENS, "opens"), (rec.USES, "uses")))).filter("name is not null")
    shown = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    return long_form(own.join(entries, "id", "left"), {
        "AutomaticModuleName": F.col("name"), "ModuleRequires": shown("requires"), "ModuleExports": shown("exports"), "ModuleOpens": shown("opens"),
        "ModuleProvides": F.when(F.size("e") > 0, F.to_json(F.map_from_entries("e"))), "ModuleUses": shown("uses"),
    })


def built_from(artifacts: DataFrame) -> DataFrame:
    """J02 and J04 over artifacts (id, path, container, content): the edges of all classes in archives with a sources companion."""
    archives = artifacts.filter(F.lower("path").endswith(".jar")).select("id", "path", F.col("container").alias("scope"))
    pairs = paired(archives)
    held = artifacts.filter("container is not null").select("container", "path", "id")
    classes = held.filter(F.col("path").endswith(".class")).select(F.col("container").alias("jar"), "id").distinct().join(pairs.select("jar").distinct(), "jar", "left_semi")
    sources = held.join(pairs.select(F.col("sources").alias("container")).distinct(), "container", "left_semi").select(F.col("container").alias("sources"), "path", "id")
    asked = classes.select("id").distinct()
    contents = artifacts.filter(F.col("path").endswith(".class")).select("id", "content").join(asked, "id", "left_semi").dropDuplicates(["id"])
    return source_edges(classes, class_facts(rec.records(contents, "class")), pairs, sources)


def described_modules(artifacts: DataFrame) -> DataFrame:
    """F56 over artifacts: (id, key, value) of the archives that hold a module descriptor at their top."""
    own = artifacts.filter("container is not null and lower(path) = 'module-info.class'")
    facts = module_facts(rec.records(own.select("id", "content").dropDuplicates(["id"]), "class"))
    holders = own.select("container", F.col("id").alias("module")).distinct()
    return holders.join(facts.withColumnRenamed("id", "module"), "module").select(F.col("container").alias("id"), F.concat(F.lit("maven:"), "key").alias("key"), "value").distinct()
