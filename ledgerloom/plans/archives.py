"""Queries of operators that join what archives hold: images and their layers, classes and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classes, images
from ..sources.records import records
from ..storage import materialised
from .base import query, table
from .material import raw, text, whole


def image_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as image archives: files (scope, path, id) and JSON texts (id, json).

    An order's manifest lists its lines' parts as layers.  Layers of returned lines are missing, and a part
    ordered twice is there twice.  Pending orders lack their configuration, each seventh key has it twice.
    """
    scope = lambda key: F.col(key).cast("string").alias("scope")
    orders = table(spark, sf_dir, "orders").select(scope("o_orderkey"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(scope("l_orderkey"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    blob = lambda letter, key: F.concat(F.lit("blobs/sha256/"), F.md5(F.concat(F.lit(letter), key).cast("binary")))
    own = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("parts"))
    listed = orders.select("scope", "o_orderkey").join(own, "o_orderkey", "left").withColumn("Layers", F.transform("parts", lambda p: blob("P", p["l_partkey"])))
    entry = F.struct(blob("C", F.col("scope")).alias("Config"), F.array(F.concat(F.lit("library/order:"), "scope")).alias("RepoTags"), "Layers")
    manifests = listed.select("scope", F.concat(F.lit("M"), "scope").alias("id"), F.to_json(F.array(entry)).alias("json"))
    configs = orders.filter("o_orderstatus <> 'P'").select("scope", blob("C", F.col("scope")).alias("path"), F.concat(F.lit("C"), "scope").alias("id"), "o_orderkey", F.to_json(F.struct(F.lit("linux").alias("os"), F.col("o_orderpriority").alias("author"))).alias("json"))
    twice = configs.filter("o_orderkey % 7 = 0")
    layers = lines.filter("l_returnflag <> 'R'").select("scope", blob("P", F.col("l_partkey")).alias("path"), F.concat(F.lit("L"), "scope", F.lit("-"), "l_linenumber").alias("id"))
    files = orders.select("scope", F.lit("manifest.json").alias("path"), F.concat(F.lit("M"), "scope").alias("id"))
    for more in (configs, twice, layers):
        files = files.unionByName(more.select("scope", "path", "id"))
    return files, manifests.select("id", "json").unionByName(configs.select("id", "json"))  # an order that is there twice has no manifest alone


JOINED_SQL = """there AS (
    SELECT l_orderkey, l_partkey, any_value(l_linenumber) AS line FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL HAVING count(*) = 1
), placed AS (
    SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position FROM lineitem
), found AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS scope, 'C' || o_orderkey AS config, CAST(position AS INTEGER) AS position, 'L' || o_orderkey || '-' || line AS layer
    FROM orders JOIN placed ON placed.l_orderkey = o_orderkey JOIN there USING (l_orderkey, l_partkey)
    WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0)"""


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, texts = image_files(spark, sf_dir)
    found = images.images(files, texts).select("scope", "image", "config", "layers")
    return images.layers(materialised(found, "images", release=True), files)


@query("j03_image_join", f"WITH {JOINED_SQL} SELECT scope, config, position, layer FROM found")
def j03_image_join(spark, sf_dir):
    """Manifest to configuration and layers; only files that are alone under their path."""
    return _layers(spark, sf_dir).select("scope", "config", "position", "layer")


@query("j03_image_facts", """SELECT 'C' || o_orderkey AS id, u.key, u.value FROM orders, LATERAL (VALUES ('docker:Platform', 'linux'), ('docker:Author', nullif(o_orderpriority, '')), ('CanonicalPurl', 'pkg:docker/library%2Forder@' || o_orderkey)) u(key, value)
WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AND u.value IS NOT NULL""")
def j03_image_facts(spark, sf_dir):
    """What configurations tell, and the package URL of an image's first tag."""
    own = images.metadata(images.images(*image_files(spark, sf_dir)))
    return own.filter("key not like 'docker:%Json'").select("id", "key", "value")


@query("j09_layers", f"WITH {JOINED_SQL} SELECT DISTINCT config AS src, 'contained:down' AS edge_type, layer AS dst FROM found UNION SELECT DISTINCT layer, 'contained:up', config FROM found")
def j09_layers(spark, sf_dir):
    """Image configurations contain their layers."""
    return images.layer_edges(_layers(spark, sf_dir))


def utf8(value):
    """A text constant of a class file."""
    return F.concat(raw("01"), whole(F.length(text(value)), 2), text(value))


def class_file(name, source):
    """A class with a wide constant before its source file's name; a null source leaves the attribute out."""
    pool = F.concat(utf8(name), raw("070001"), raw("050000000000000007"), utf8(F.lit("SourceFile")), utf8(F.coalesce(source, F.lit("none"))))
    attribute = F.when(source.isNotNull(), raw("00010005000000020006")).otherwise(raw("0000"))
    return F.concat(raw("CAFEBABE000000410007"), pool, raw("002100020000000000000000"), attribute)


@query("j04_class_source", """WITH c AS (SELECT o_orderkey, o_custkey, 'pkg/' || lower(o_orderstatus) || '/C' || (o_orderkey % 10) || '.java' AS path, o_orderpriority LIKE '5%' AS bare FROM orders)
SELECT DISTINCT 'K' || k.o_orderkey AS src, 'build:down' AS edge_type, 'S' || s.o_custkey || '-' || s.path AS dst FROM c k JOIN c s ON k.o_custkey = s.o_custkey AND k.path = s.path WHERE s.o_orderkey % 4 <> 1 AND NOT k.bare AND k.o_custkey % 3 <> 0""")
def j04_class_source(spark, sf_dir):
    """Customers as pairs of archives: orders are classes in one, some have their source in the other; every third has no companion."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.concat(F.lit("pkg/"), F.lower("o_orderstatus"), F.lit("/")).alias("package"), F.concat(F.lit("C"), F.col("o_orderkey") % 10, F.lit(".java")).alias("file"))
    jar, sources = F.concat(F.lit("J"), "o_custkey"), F.concat(F.lit("S"), "o_custkey")
    path = lambda end: F.concat(F.lit("repo/app"), "o_custkey", F.lit(end))
    customers = own.select("o_custkey").distinct()
    archives = customers.select(jar.alias("id"), path("-1.0.jar").alias("path"), F.lit(None).cast("string").alias("scope"))
    archives = archives.unionByName(customers.filter("o_custkey % 3 <> 0").select(sources.alias("id"), path("-1.0-sources.jar").alias("path"), F.lit(None).cast("string").alias("scope")))
    id_ = F.concat(F.lit("K"), "o_orderkey")
    contents = own.select(id_.alias("id"), class_file(F.concat("package", F.lit("K"), "o_orderkey"), F.when(~F.col("o_orderpriority").startswith("5"), F.col("file"))).alias("content"))
    there = own.filter("o_orderkey % 4 <> 1").select(sources.alias("sources"), F.concat("package", "file").alias("path")).withColumn("id", F.concat("sources", F.lit("-"), "path"))
    return classes.source_edges(own.select(jar.alias("jar"), id_.alias("id")), classes.class_facts(records(contents, "class")), classes.paired(archives), there)


@query("f56_module_descriptors", """SELECT CAST(p_partkey AS VARCHAR) AS id, u.key, u.value FROM part, LATERAL (VALUES ('AutomaticModuleName', 'm.' || p_partkey), ('ModuleRequires', '["java.base","r.' || p_size || '"]'), ('ModuleExports', '["e.' || p_size || '"]'), ('ModuleUses', CASE WHEN p_partkey % 2 = 0 THEN '["u.Service"]' END), ('ModuleProvides', '{"u.Service":["i.A' || p_size || '","u.Service"]}')) u(key, value) WHERE u.value IS NOT NULL""")
def f56_module_descriptors(spark, sf_dir):
    """Each part is a module."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pool = F.concat(
        utf8(F.lit("module-info")), raw("070001"), utf8(F.lit("Module")), utf8(F.concat(F.lit("m."), key)), raw("130004"), utf8(F.lit("java.base")), raw("130006"), utf8(F.concat(F.lit("r."), size)), raw("130008"),
        utf8(F.concat(F.lit("e/"), size)), raw("14000A"), utf8(F.lit("u/Service")), raw("07000C"), utf8(F.concat(F.lit("i/A"), size)), raw("07000E"),
    )
    uses = F.when(key % 2 == 0, raw("0001000D")).otherwise(raw("0000"))
    requires, exports, provides = raw("0002" + "000780000000" + "000900000000"), raw("0001" + "000B000000010007"), raw("0001" + "000D0002000F000D")
    body = F.concat(raw("000500000000"), requires, exports, raw("0000"), uses, provides)
    content = F.concat(raw("CAFEBABE000000410010"), pool, raw("8000" + "0002" + "0000" * 4 + "0001"), raw("0003"), whole(F.length(body), 4), body)
    return classes.module_facts(records(table(spark, sf_dir, "part").select(key.cast("string").alias("id"), content.alias("content")), "class"))
