"""Artifacts from files (S01, S02) and from the containers in them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import gitoid
from ..functions.mime import mime_types
from ..functions.packages import clean_path
from ..operators.filters import not_archive
from ..storage import materialised
from .archives import members

COLUMNS = "id string, path string, container string, root string, depth int, size long, mtime long, mime array<string>, content binary"


def scan(spark: SparkSession, *folders: str, exclude: str | None = None) -> DataFrame:
    """Regular files below the folders, without hidden ones and those whose name matches ``exclude``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
    name = F.substring_index("path", "/", -1)
    kept = files.filter(~name.startswith("."))
    kept = kept.filter(~name.rlike(exclude)) if exclude else kept
    return artifacts_of(kept.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), F.unix_millis("modificationTime").alias("mtime"), "content"))


def listed(spark: SparkSession, file_list: str) -> DataFrame:
    """Artifacts of the files that a text file names, one path a line; missing ones are skipped."""
    named = [r.value.strip() for r in spark.read.text(file_list).distinct().collect() if r.value.strip()]  # what a command line would name
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    paths = [p for p in named if (h := hadoop(p)).getFileSystem(conf).exists(h)]
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], kinds)
    return artifacts_of(files.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), F.unix_millis("modificationTime").alias("mtime"), "content"))


def artifacts_of(files: DataFrame) -> DataFrame:
    """Top-level artifacts from path, mtime and content."""
    own = gitoid(F.col("content"))
    return files.select(
        own.alias("id"), clean_path(F.col("path")).alias("path"), F.lit(None).cast("string").alias("container"), own.alias("root"), F.lit(0).alias("depth"),
        F.octet_length("content").cast("long").alias("size"), "mtime", mime_types(F.col("content"), F.col("path")).alias("mime"), "content",
    )


def _unpacked(frontier: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for path, content, mtime in members(row["content"]) or ():
                    own = hashlib.sha256(b"blob %d\0" % len(content) + content).hexdigest()
                    yield pa.RecordBatch.from_pylist(
                        [{"id": "gitoid:blob:sha256:" + own, "path": path or row["path"], "container": row["id"], "root": row["root"], "depth": row["depth"] + 1, "size": len(content), "mtime": mtime, "content": content}],
                        pa.schema([("id", pa.string()), ("path", pa.string()), ("container", pa.string()), ("root", pa.string()), ("depth", pa.int32()), ("size", pa.int64()), ("mtime", pa.int64()), ("content", pa.binary())]),
                    )

    found = frontier.select("id", "path", "root", "depth", "content").mapInArrow(run, "id string, path string, container string, root string, depth int, size long, mtime long, content binary")
    named = found.withColumn("mime", mime_types(F.col("content"), F.col("path")))
    return named.select("id", clean_path(F.col("path")).alias("path"), "container", "root", "depth", "size", "mtime", "mime", "content")


def expand(artifacts: DataFrame, blocked: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The artifacts and all that their containers hold, level by level.

    A content is opened once, however often it occurs (P10); what is on the
    block list (id) is neither kept nor opened (P09).  Every level is written to
    the shared folder, so a lost executor costs one level at most.  All levels
    are opened, or with ``most`` so many; what lies deeper is then kept closed.
    """
    conf, batch = artifacts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(batch)
    conf.set(batch, 4)  # whole containers
    try:
        return _expand(artifacts, blocked, most)
    finally:
        conf.set(batch, before)


def _expand(artifacts: DataFrame, blocked: DataFrame | None, most: int | None) -> DataFrame:
    free = lambda df: df.join(blocked.select("id").distinct(), "id", "left_anti") if blocked is not None else df
    level = materialised(free(artifacts), "level")
    out, opened = level, None
    depth = 0
    while most is None or depth < most:
        depth += 1
        todo = level.filter(~not_archive(F.col("mime"))).dropDuplicates(["id"])
        if opened is not None:
            todo = todo.join(opened, "id", "left_anti")
        fresh = materialised(todo, "frontier")
        if fresh.isEmpty():
            break
        opened = fresh.select("id") if opened is None else opened.unionByName(fresh.select("id"))
        level = materialised(free(_unpacked(fresh)), "level")
        out = out.unionByName(level)
    return out


def record_ingested(artifacts: DataFrame, folder: str) -> None:
    """Append the paths of the top-level artifacts to a text table."""
    artifacts.filter("depth = 0").select("path").distinct().write.mode("append").text(folder)
