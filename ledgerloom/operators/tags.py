"""Run tags and package tags."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TAG_BODY, TAG_FROM, TAGS


def run_tag(name: str, date: str, version: str | None = None, more: str | None = None) -> tuple[str, str]:
    """A tag's identity and JSON; JSON of the user overlays it, or goes under ``extra`` if it is no object."""
    own = {"tag": name, "date": date} | ({"version": version} if version else {})
    if more:
        given = json.loads(more)
        own |= given if isinstance(given, dict) else {"extra": given}
    text = json.dumps(own, separators=(",", ":"), ensure_ascii=False)
    raw = text.encode()
    return "gitoid:blob:sha256:" + hashlib.sha256(b"blob %d\0" % len(raw) + raw).hexdigest(), text


def tagged(spark: SparkSession, tops: DataFrame, tag: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """The tag's item and the tag root, and edges from top-level items (id) to the tag and from it to the root."""
    items = spark.createDataFrame([(tag[0], TAG_BODY, tag[1]), (TAGS, None, None)], "id string, body_mime string, tag string")
    edges = tops.select(F.col("id").alias("src"), F.lit(TAG_FROM).alias("edge_type"), F.lit(tag[0]).alias("dst"))
    return items, edges.unionByName(spark.createDataFrame([(tag[0], TAG_FROM, TAGS)], edges.schema))


def package_tags(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From packages (id, name, version, date) one tag item for each, below the tag root."""
    from ..functions.identity import gitoid
    from ..functions.packages import short_name

    text = F.to_json(F.struct(F.lit(True).alias("package_tag"), F.col("name").alias("tag"), short_name(F.col("name")).alias("simple_name"), "version", "date"))
    own = packages.withColumn("tag", text).withColumn("tag_id", gitoid(F.col("tag")))
    items = own.select(F.col("tag_id").alias("id"), F.lit(TAG_BODY).alias("body_mime"), "tag").distinct()
    edges = own.select(F.col("id").alias("src"), F.lit(TAG_FROM).alias("edge_type"), F.col("tag_id").alias("dst"))
    return items, edges.unionByName(items.select(F.col("id").alias("src"), F.lit(TAG_FROM).alias("edge_type"), F.lit(TAGS).alias("dst")))
