"""Artifacts as a stream: each micro-batch becomes items and edges that merge with what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import ALIAS_FROM, CONTAINED_BY, METADATA_BODY
from ..operators.graph import with_reversed
from ..operators.merge import merged_items


def graph_of(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and edges of artifacts (id, path, container, size, mime)."""
    items = artifacts.select("id", F.lit(METADATA_BODY).alias("body_mime"), F.array("path").alias("file_names"), F.col("mime").alias("mime_types"), F.col("size").alias("file_size"))
    up = artifacts.filter("container is not null").select(F.col("id").alias("src"), F.lit(CONTAINED_BY).alias("edge_type"), F.col("container").alias("dst"))
    return merged_items(items), with_reversed(up)


def with_aliases(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with those of the alias identifiers of artifacts that still have their content."""
    from ..functions.identity import aliases

    own = artifacts.select(F.col("id").alias("src"), F.lit(ALIAS_FROM).alias("edge_type"), F.explode(aliases(F.col("content"))).alias("dst"))
    return edges.unionByName(with_reversed(own)).distinct()


def upsert(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's part of the graph below ``target``; run again, a batch replaces what it wrote.

    Merging is idempotent and commutative, so readers merge the parts and writers
    never rewrite them.
    """

    def write(batch: DataFrame, number: int) -> None:
        items, edges = graph_of(batch)
        items.write.mode("overwrite").parquet(f"{target}/items/batch={number}")
        edges.write.mode("overwrite").parquet(f"{target}/edges/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """The graph that all batches make."""
    items, edges = (spark.read.parquet(f"{target}/{name}").drop("batch") for name in ("items", "edges"))
    return merged_items(items), edges.distinct()


def compacted(spark: SparkSession, target: str, into: str) -> None:
    """Write the merged graph of ``target`` to another folder, so that later reads merge fewer parts."""
    items, edges = current(spark, target)
    items.write.mode("overwrite").parquet(f"{into}/items/batch=0")
    edges.write.mode("overwrite").parquet(f"{into}/edges/batch=0")
