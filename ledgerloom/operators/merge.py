"""The merge algebra of items, as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def united(column: str) -> Column:
    """The sorted union of a set-valued column over a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def merged_items(items: DataFrame) -> DataFrame:
    """One row for each id; names and types are united, the largest size counts.

    Sizes of one id are equal but for stubs, which have 0, so the largest is the
    size that was there first.
    """
    return items.groupBy("id").agg(F.max("body_mime").alias("body_mime"), united("file_names").alias("file_names"), united("mime_types").alias("mime_types"), F.max("file_size").alias("file_size"))


def merged_extra(extra: DataFrame) -> DataFrame:
    """The union of values of each id and key, in long form."""
    return extra.select("id", "key", "mime", "value").distinct()


def overwritten_extra(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata enhancement: the new keys replace the old ones of the same id."""
    keys = new.select("id", "key").distinct()
    return old.join(keys, ["id", "key"], "left_anti").unionByName(new).distinct()


def merged_clusters(*graphs: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Several graphs' items and edges as one graph."""
    items, edges = graphs[0]
    for more_items, more_edges in graphs[1:]:
        items, edges = items.unionByName(more_items), edges.unionByName(more_edges)
    return merged_items(items), edges.distinct()


def earliest(extra: DataFrame, key: str = "file_modified_epoch_millis") -> DataFrame:
    """The least numeric plain value of a key."""
    number = F.when(F.col("mime").isNull(), F.col("value").try_cast("long"))
    return extra.filter(F.col("key") == key).groupBy("id").agg(F.min(number).alias("mtime"))


def qualified_names(names: DataFrame) -> DataFrame:
    """File names (id, value, parent): where an id has several, each also with its parent in front."""
    own = names.withColumn("several", F.size(F.collect_set("value").over(Window.partitionBy("id"))) > 1)
    both = F.when(F.col("several") & F.col("parent").isNotNull(), F.array("value", F.concat_ws("/", "parent", "value"))).otherwise(F.array("value"))
    return own.select("id", F.explode(both).alias("value")).distinct()


def name_map(files: DataFrame) -> DataFrame:
    """Scope, path and id: the file that a name means in its scope; of several the least."""
    return files.groupBy("scope", "path").agg(F.min("id").alias("id"))


def failures(paths: DataFrame, top: int = 10) -> DataFrame:
    """The folders with most of the failed paths, and how many."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return paths.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(top)


def changes_by_hash(changes: DataFrame) -> DataFrame:
    """Hash and changes, the sorted list of all that several sources (hash, key, value) say of it; each source's own are listed."""
    told = F.concat_ws(":", "key", "value")
    return changes.groupBy("hash").agg(F.array_sort(F.collect_list(told)).alias("changes"))


def line_sets(files: DataFrame, pattern: str) -> DataFrame:
    """Id and values, the sorted set of what the pattern's first group finds in the files' texts (id, text)."""
    found = files.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("value"))
    return found.groupBy("id").agg(F.array_sort(F.collect_set("value")).alias("values"))


def dependency_groups(dependencies: DataFrame) -> DataFrame:
    """A10: id, name, versions and n: each dependency (id, name, version) of a file once, with the sorted set of its versions."""
    return dependencies.groupBy("id", "name").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.count("*").alias("n"))
