"""Output of an external scanner, as changes keyed by digest (S19), and which files to scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "artifacts array<struct<id string, name string, version string, type string, purl string>>,"
    "files array<struct<id string, location struct<path string>, digests array<struct<algorithm string, value string>>>>,"
    "artifactRelationships array<struct<parent string, child string, type string>>"
)


def eligible(mime: Column, path: Column, filters=None) -> Column:
    """Containers and package files, unless the given include/exclude rules drop them."""
    own = F.arrays_overlap(mime, F.array(*map(F.lit, ("application/zip", "application/java-archive", "application/x-rpm", "application/x-archive", "application/x-tar", "application/gzip")))) | path.rlike(r"\.(jar|war|ear|rpm|deb|apk|gem|whl|nupkg)$")
    return own & filters.passes(mime) if filters is not None else own


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Reports of one JSON document a file."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(list(paths))


def changes(reports: DataFrame) -> DataFrame:
    """(hash, key, value): packages for the digests of the files that belong to them.

    Files, relationships and packages meet on the identifiers of their report.
    """
    own = reports.withColumn("report", F.monotonically_increasing_id())
    packages = own.select("report", F.explode("artifacts").alias("a")).select("report", F.col("a.id").alias("parent"), "a.purl", F.to_json("a").alias("value"))
    related = own.select("report", F.explode("artifactRelationships").alias("r")).select("report", "r.parent", "r.child")
    files = own.select("report", F.explode("files").alias("f")).select("report", F.col("f.id").alias("child"), F.explode("f.digests").alias("d"))
    hashes = files.select("report", "child", F.concat_ws(":", F.lower("d.algorithm"), F.lower("d.value")).alias("hash"))
    joined = hashes.join(related, ["report", "child"]).join(packages, ["report", "parent"])
    facts = F.array(F.struct(F.lit("static-metadata-artifact").alias("key"), "value"), F.struct(F.lit("alias:from").alias("key"), F.col("purl").alias("value")))
    return joined.select("hash", F.explode(facts).alias("f")).select("hash", "f.key", "f.value").filter("value is not null").distinct()
