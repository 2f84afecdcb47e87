"""Configuration files as relations: sections, keys and values, the sections that others point to, and included files.

Files become rows (id, section, place, key, value); pointers from section to section and includes from file to file are
edges, and what they reach is found by joins: G04 by the bounded walk of ``graph.reach``, G05 by layers, A12 by
grouped unions.  A file's lines meet only to carry the section's name down, in the order of the file.

Defined results: lines before the first section tell nothing; of equal keys in a section the last counts; of several
sections that set one value the last of the file counts; an include that names no known file has no edge; circles
of includes are opened at the least path of those that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto
from ..storage import materialised
from . import graph

#: Pointers are followed so many steps.
DEPTH = 9
# Keys that make a section one of security, and keys whose value names another section.
SECURITY = {"cipherstring": "cipher_string", "ciphersuites": "cipher_suites", "minprotocol": "min_protocol", "maxprotocol": "max_protocol", "options": "options"}
POINTERS = ("ssl_conf", "system_default", "server", "client", "default", "default_server", "default_client", "tls_system_default")
# Properties of Java security files that are lists, the names of their facts, and the one that is a number.
LISTS = {"jdk.tls.disabledAlgorithms": "disabled_algorithms", "jdk.certpath.disabledAlgorithms": "certpath_disabled_algorithms", "jdk.tls.legacyAlgorithms": "legacy_algorithms", "jdk.tls.namedGroups": "named_groups"}
KEY_SIZE = "jdk.tls.ephemeralDHKeySize"


def section_rows(files: DataFrame) -> DataFrame:
    """id, section, place, key and value of every setting of files (id, text); an include has the key ``.include``, a section's head the key null."""
    lines = files.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("place", "raw")).select("id", "place", F.trim(F.regexp_replace("raw", r"[\t\x0b\f]", " ")).alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").rlike("^[#;]"))
    head = F.when(F.col("line").rlike(r"^\[.+\]$"), F.trim(F.regexp_replace("line", r"^\[|\]$", "")))
    own = lines.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(Window.partitionBy("id").orderBy("place"))).filter("section is not null")
    include = F.col("line").startswith(".include")
    path = F.trim(F.regexp_replace("line", r"^\.include\s*!?\s*", ""))
    key = F.when(include, ".include").otherwise(F.lower(F.trim(F.substring_index("line", "=", 1))))
    value = F.when(include, path).otherwise(F.trim(F.regexp_replace("line", "^[^=]*=", "")))
    told = F.col("head").isNotNull() | F.when(include, path != "").otherwise(F.col("line").contains("="))
    return own.filter(told).select("id", "section", "place", F.when(F.col("head").isNull(), key).alias("key"), F.when(F.col("head").isNull(), value).alias("value"))


def settings(rows: DataFrame) -> DataFrame:
    """id, section, key, value and place of what counts: the last of equal keys, but every include."""
    plain = rows.filter("key <> '.include'").groupBy("id", "section", "key").agg(F.max_by("value", "place").alias("value"), F.max("place").alias("place"))
    return plain.unionByName(rows.filter("key = '.include'").select("id", "section", "key", "value", "place"))


def pointers(rows: DataFrame) -> DataFrame:
    """Id, src and dst: sections that point to sections of the same file."""
    own = settings(rows).filter(F.col("key").isin(*POINTERS)).select("id", F.col("section").alias("src"), F.col("value").alias("dst"))
    return own.join(rows.select("id", F.col("section").alias("dst")).distinct(), ["id", "dst"], "left_semi").select("id", "src", "dst").distinct()


def reached(rows: DataFrame) -> DataFrame:
    """Id, root and section: the sections that each section leads to, itself included, at most DEPTH steps away."""
    node = lambda c: F.to_json(F.array("id", c))
    part = lambda c, n: F.from_json(c, "array<string>")[n]
    heads = rows.select("id", "section").distinct()
    steps = pointers(rows).select(node("src").alias("src"), node("dst").alias("dst"))
    starts = heads.select(node("section").alias("id"))
    # Only sections that point to others are walked from.
    walked = graph.reach(starts.join(steps.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("root"), "id"), steps, DEPTH)
    far = walked.filter("depth > 0").select(part("id", 0).alias("file"), part("root", 1).alias("root"), part("id", 1).alias("section"))
    return heads.select("id", F.col("section").alias("root"), "section").unionByName(far.select(F.col("file").alias("id"), "root", "section")).distinct()


def active(rows: DataFrame) -> DataFrame:
    """id and section of those that set security, lead to one that does, or are led to from such a section."""
    wanted = settings(rows).filter(F.col("key").isin(*SECURITY, "ssl_conf", ".include")).select("id", "section").distinct()
    whole = reached(rows)
    starts = whole.join(wanted, ["id", "section"], "left_semi").select("id", "root").distinct()
    return whole.join(starts, ["id", "root"], "left_semi").select("id", "section").distinct()


def security_facts(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, key, value) of the active sections: their names, cipher strings and protocols, and the algorithms that these stand for."""
    own = settings(rows).join(sections, ["id", "section"], "left_semi")
    one = own.filter(F.col("key").isin(*(k for k in SECURITY if k != "options"))).groupBy("id", "key").agg(F.max_by("value", "place").alias("value"))
    named = one.select("id", F.try_element_at(crypto.lookup(SECURITY), F.col("key")).alias("key"), "value")
    options = own.filter("key = 'options'").select("id", F.explode(F.split("value", ",")).alias("value")).select("id", F.lit("options").alias("key"), F.trim("value").alias("value"))
    heads = sections.select("id", F.lit("sections").alias("key"), F.col("section").alias("value"))
    listed = named.filter("key in ('cipher_string', 'cipher_suites')").select("id", F.explode(F.split("value", r"[:;,\s]+")).alias("t"))
    known = F.coalesce(crypto.suite_algorithms(F.col("t")), F.try_element_at(crypto.lookup(crypto.ALGORITHM_NAMES), F.upper("t")))
    algorithms = listed.select("id", F.explode(F.split(known, " ")).alias("value")).select("id", F.lit("algorithms").alias("key"), "value")
    return heads.unionByName(named).unionByName(options).unionByName(algorithms).filter("value <> ''").distinct()


def openssl_includes(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Id and reference of the files that active sections include."""
    return rows.join(sections, ["id", "section"], "left_semi").filter("key = '.include'").select("id", F.col("value").alias("reference")).distinct()


def java_includes(files: DataFrame) -> DataFrame:
    """Id and reference of the files that Java security files (id, text) include."""
    lines = files.select("id", F.explode(F.split("text", r"\r?\n")).alias("line")).select("id", F.trim("line").alias("line")).filter(F.col("line").startswith("include"))
    bare = F.regexp_replace(F.trim(F.regexp_replace("line", "^include", "")), r"""^<?"?'?|'?"?>?$""", "")
    return lines.select("id", F.regexp_replace(F.trim(bare), "^file:", "").alias("reference")).filter("reference <> ''").distinct()


def include_edges(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scope, src and dst, paths: the file of the same scope that each reference means, by its path, else the first with its name.

    files: scope, path, id.  wanted: id, reference.
    """
    base = lambda c: F.substring_index(c, "/", -1)
    by_name = files.groupBy("scope", base("path").alias("name")).agg(F.min("path").alias("by_name"))
    exact = files.select("scope", F.col("path").alias("reference"), F.col("path").alias("exact")).distinct()
    asked = files.join(wanted, "id").withColumn("name", base("reference"))
    found = asked.join(exact, ["scope", "reference"], "left").join(by_name, ["scope", "name"], "left")
    return found.select("scope", F.col("path").alias("src"), F.coalesce("exact", "by_name").alias("dst")).filter("dst is not null").distinct()


def layers(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Scope, path and layer of files (scope, path), so that what a file includes lies in a lower layer.

    A round takes all files whose includes are taken; a scope where none is free has only circles left, and
    its least path is taken.  Rounds grow with the length of chains, not with the number of files.
    """
    left = materialised(files.select("scope", "path").distinct(), "unordered")
    steps = materialised(edges.filter("src <> dst").select("scope", "src", "dst").distinct(), "includes")
    out, layer = None, 0
    while not left.isEmpty():
        waiting = steps.join(left.select("scope", F.col("path").alias("dst")), ["scope", "dst"], "left_semi").select("scope", F.col("src").alias("path")).distinct()
        free = left.join(waiting, ["scope", "path"], "left_anti")
        stuck = left.join(free.select("scope").distinct(), "scope", "left_anti").groupBy("scope").agg(F.min("path").alias("path"))
        taken = materialised(free.unionByName(stuck).withColumn("layer", F.lit(layer)), "layer")
        out = taken if out is None else out.unionByName(taken)
        left = materialised(left.join(taken, ["scope", "path"], "left_anti"), "unordered")
        layer += 1
    return files.select("scope", "path").distinct().withColumn("layer", F.lit(0)) if out is None else out


def associated(files: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """(id, value) of each file's references, ``container:file``, to what lies in a lower layer.

    files: scope, path, id; the scope is the container, or empty.
    """
    placed = files.join(order, ["scope", "path"])
    own = edges.join(placed.select("scope", F.col("path").alias("src"), F.col("id").alias("from"), F.col("layer").alias("at")), ["scope", "src"])
    other = placed.select("scope", F.col("path").alias("dst"), F.col("id").alias("to"), F.col("layer").alias("below"))
    return own.join(other, ["scope", "dst"]).filter("below < at").select(F.col("from").alias("id"), F.concat("scope", F.lit(":"), "to").alias("value")).distinct()


def java_properties(files: DataFrame) -> DataFrame:
    """id, key and value of the properties of Java security files (id, text) that tell facts; the last of equal keys counts."""
    joined = F.regexp_replace("text", r"\\\r?\n[ \t]*", "")
    lines = files.select("id", F.posexplode(F.split(joined, r"\r?\n")).alias("place", "line"))
    key = F.regexp_extract("line", r"^\s*([^\s=:#!]+)\s*[=:]?", 1)
    own = lines.withColumn("key", key).filter(F.col("key").isin(*LISTS, KEY_SIZE))
    value = F.trim(F.regexp_replace("line", r"^\s*[^\s=:]+\s*[=:]?\s*", ""))
    return own.groupBy("id", "key").agg(F.max_by(value, "place").alias("value"))


def effective(files: DataFrame, properties: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, key, value) of what counts in each file: lists united with those of the files it includes, its own size or that of the last included.

    files: scope, path, id.  properties: id, key, value.  A file's list stays rows throughout.
    """
    itself = files.select("scope", F.col("path").alias("src"), F.col("path").alias("dst"), F.lit(True).alias("own")).distinct()
    sources = edges.filter("src <> dst").withColumn("own", F.lit(False)).unionByName(itself)
    ids = files.select("scope", F.col("path").alias("src"), "id").distinct()
    told = files.select("scope", F.col("path").alias("dst"), F.col("id").alias("told")).distinct().join(properties.withColumnRenamed("id", "told"), "told")
    whole = sources.join(told, ["scope", "dst"]).join(ids, ["scope", "src"])
    names: Column = F.try_element_at(crypto.lookup(LISTS), F.col("key"))
    listed = whole.filter(F.col("key").isin(*LISTS)).select("id", names.alias("key"), F.explode(F.split("value", ",")).alias("value")).select("id", "key", F.trim("value").alias("value"))
    sized = whole.filter((F.col("key") == KEY_SIZE) & (F.col("value") != "")).groupBy("id").agg(F.max_by("value", F.struct("own", "dst")).alias("value"))
    return listed.filter("value <> ''").distinct().unionByName(sized.select("id", F.lit("ephemeral_dh_key_size").alias("key"), "value"))
