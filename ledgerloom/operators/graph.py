"""Graph operators over edge tables (src, edge_type, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ALIAS_TO, CONTAINED_BY, CONTAINS, METADATA_BODY, REVERSED, TAGS, UPWARD
from ..storage import materialised


def with_reversed(edges: DataFrame) -> DataFrame:
    """The edges and the reverses of four types, each once.

    One pass: an edge becomes one or two rows, so the input is not read twice.
    """
    back = F.create_map(*(F.lit(x) for pair in REVERSED.items() for x in pair))
    own = F.struct("src", "edge_type", "dst")
    reverse = F.struct(F.col("dst").alias("src"), F.try_element_at(back, F.col("edge_type")).alias("edge_type"), F.col("src").alias("dst"))
    both = F.when(F.col("edge_type").isin(*REVERSED), F.array(own, reverse)).otherwise(F.array(own))
    return edges.select(F.explode(both).alias("e")).select("e.*").distinct()


def stubs(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Ids that edges name and that no item has."""
    return edges.select(F.col("dst").alias("id")).distinct().join(items.select("id"), "id", "left_anti")


def roots(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Items with a metadata body, other than the tag root, that nothing contains and that are no alias."""
    held = edges.filter(F.col("edge_type").isin(ALIAS_TO, CONTAINED_BY)).select(F.col("src").alias("id"))
    return items.filter((F.col("body_mime") == METADATA_BODY) & (F.col("id") != TAGS)).join(held, "id", "left_anti")


def contained(edges: DataFrame) -> DataFrame:
    """Container and content."""
    return edges.filter(F.col("edge_type") == CONTAINS).select("src", "dst")


def dangling(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Edges whose target no item has."""
    return edges.join(items.select(F.col("id").alias("dst")), "dst", "left_anti")


def in_degree(edges: DataFrame, top: int = 50) -> DataFrame:
    """The ids with most containers."""
    return edges.filter(F.col("edge_type") == CONTAINED_BY).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(top)


def reach(seeds: DataFrame, steps: DataFrame, depth: int | None = None) -> DataFrame:
    """All (root, id, depth) reachable from seeds (root, id) along steps (src, dst), with the least depth.

    Semi-naive: each round joins only the rows that the last one found, and
    drops those already seen, so shared nodes and cycles are walked once.  Each
    round's result is written to the shared folder; rounds grow with the depth.
    """
    steps = materialised(steps.select("src", "dst").distinct(), "steps")  # each round reads them again
    seen = materialised(seeds.select("root", "id").distinct().withColumn("depth", F.lit(0)), "reach")
    front = seen
    at = 0
    while depth is None or at < depth:
        at += 1
        found = front.join(steps, front["id"] == steps["src"]).select("root", F.col("dst").alias("id")).distinct()
        front = materialised(found.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(at)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure(seeds: DataFrame, edges: DataFrame, types: tuple[str, ...] = UPWARD) -> DataFrame:
    """Ids reachable from the seeds' ids along edges of these types."""
    return reach(seeds.select(F.lit("").alias("root"), "id"), edges.filter(F.col("edge_type").isin(*types))).select("id")


def pruned(items: DataFrame, edges: DataFrame, late: Column) -> tuple[DataFrame, DataFrame]:
    """Items and edges without those marked late and all that depends on them."""
    gone = materialised(closure(items.filter(late), edges), "gone")
    kept = items.join(gone, "id", "left_anti")
    ends = lambda side: gone.select(F.col("id").alias(side))
    return kept, edges.join(ends("src"), "src", "left_anti").join(ends("dst"), "dst", "left_anti")


def paths(seeds: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """(id, path) of every walk of at most ``depth`` steps down from the seeds' ids, the path joined by ``>``."""
    steps = materialised(steps.select("src", "dst").distinct(), "steps")
    front = seeds.select("id", F.col("id").alias("path"))
    out = front
    for _ in range(depth):
        front = front.join(steps, front["id"] == steps["src"]).select(F.col("dst").alias("id"), F.concat_ws(">", "path", "dst").alias("path"))
        out = out.unionByName(front)
    return out
