"""Graphs as Parquet, and as the indexed file set of data, index and cluster files.

Parquet is the form to work with: ``write_graph`` sorts items by the digest of
their id in ranges, so a lookup by id reads the row groups whose statistics
allow it, and no file has to be indexed.  ``export_cluster`` streams the items
through the driver into the indexed file set for other readers;
``read_cluster`` gives them back as rows.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import roots
from . import cbor

# Magic numbers and versions of the file formats.
DATA_MAGIC, INDEX_MAGIC, CLUSTER_MAGIC = 0x00BE1100, 0x54154170, 0x00BA4A4A
DATA_VERSION, INDEX_VERSION, CLUSTER_VERSION = 1, 2, 3
ROLLOVER = 15 << 30


def nested(items: DataFrame, edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row for each id with its connections and metadata; only for sinks, as hubs get long rows."""
    connections = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct("edge_type", F.col("dst").alias("target")))).alias("connections"))
    out = connections.join(items, "id", "full_outer")
    if extra is not None:
        by_key = extra.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("mime", "value"))).alias("values"))
        out = out.join(by_key.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("extra")), "id", "left")
    return out.withColumn("id_md5", F.md5("id"))


def write_graph(items: DataFrame, edges: DataFrame, folder: str, extra: DataFrame | None = None) -> None:
    """Parquet tables of the graph, items and edges in ranges of their ids' digests."""
    items.withColumn("id_md5", F.md5("id")).repartitionByRange("id_md5").sortWithinPartitions("id_md5").write.mode("overwrite").parquet(f"{folder}/items")
    edges.withColumn("src_md5", F.md5("src")).repartitionByRange("src_md5").sortWithinPartitions("src_md5").write.mode("overwrite").parquet(f"{folder}/edges")
    if extra is not None:
        extra.repartitionByRange("id").sortWithinPartitions("id", "key").write.mode("overwrite").parquet(f"{folder}/extra")


def dump(items: DataFrame, edges: DataFrame, folder: str, extra: DataFrame | None = None) -> None:
    """Every item with its connections and metadata, a JSON object a line, written by the tasks."""
    nested(items, edges, extra).drop("id_md5").write.mode("overwrite").json(folder)


def dump_roots(items: DataFrame, edges: DataFrame, folder: str) -> None:
    """The ids of root items, a JSON string a line, in order."""
    roots(items, edges).select("id").orderBy("id").select(F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2).alias("value")).write.mode("overwrite").text(folder)


def item_by_id(spark: SparkSession, folder: str, identifier: str) -> DataFrame:
    """A point read; the digest's range prunes files and row groups."""
    return spark.read.parquet(f"{folder}/items").filter((F.col("id_md5") == hashlib.md5(identifier.encode()).hexdigest()) & (F.col("id") == identifier))


def _file_hash(path: str) -> int:
    with open(path, "rb") as file:
        return int.from_bytes(hashlib.file_digest(file, "sha256").digest()[:8], "big") & (1 << 63) - 1


def _item(row: dict) -> bytes:
    body = None
    if row.get("body_mime"):
        extra = {k: [v["value"] if v["mime"] is None else [v["mime"], v["value"]] for v in values] for k, values in sorted((row.get("extra") or {}).items())}
        body = {"file_names": row["file_names"] or [], "mime_type": row["mime_types"] or [], "file_size": row["file_size"] or 0, "extra": extra}
    connections = [[c["edge_type"], c["target"]] for c in row["connections"] or []]
    return cbor.encode({"body": body, "body_mime_type": row.get("body_mime"), "connections": connections, "identifier": row["id"]})


def export_cluster(rows: DataFrame, folder: str, name: str = "graph") -> str:
    """The file set of ``nested`` rows; returns the cluster file's path.

    Rows come to the driver partition by partition, in order of their digests,
    and go to disk at once, so memory holds one partition.
    """
    os.makedirs(folder, exist_ok=True)
    data_files, index_files, previous = [], [], 0
    ordered = rows.orderBy("id_md5").toLocalIterator()
    row = next(ordered, None)
    while row is not None or not data_files:
        path, index = os.path.join(folder, "data.tmp"), []
        with open(path, "wb") as file:
            envelope = cbor.encode({"version": DATA_VERSION, "magic": DATA_MAGIC, "previous": previous, "depends_on": [], "built_from_merge": False, "info": {}})
            file.write(struct.pack(">IH", DATA_MAGIC, len(envelope)) + envelope)
            while row is not None and file.tell() < ROLLOVER:
                item = _item(row.asDict(recursive=True))
                index.append((bytes.fromhex(row.id_md5), file.tell()))
                file.write(struct.pack(">i", len(item)) + item)
                row = next(ordered, None)
            file.write(struct.pack(">hq", -1, index[-1][1] if index else 0))
        previous = _file_hash(path)
        os.replace(path, os.path.join(folder, f"{previous:016x}.grd"))
        data_files.append(previous)
        path = os.path.join(folder, "index.tmp")
        if index != sorted(index):
            raise ValueError("items are not in order of their digests")
        with open(path, "wb") as file:
            envelope = cbor.encode({"version": INDEX_VERSION, "magic": INDEX_MAGIC, "size": len(index), "data_files": [previous], "encoding": "MD5/Long/Long", "info": {}})
            file.write(struct.pack(">IH", INDEX_MAGIC, len(envelope)) + envelope)
            for digest, offset in index:
                file.write(digest + struct.pack(">qq", previous, offset))
        index_files.append(_file_hash(path))
        os.replace(path, os.path.join(folder, f"{index_files[-1]:016x}.gri"))
    path = os.path.join(folder, "cluster.tmp")
    with open(path, "wb") as file:
        envelope = cbor.encode({"version": CLUSTER_VERSION, "magic": CLUSTER_MAGIC, "data_files": data_files, "index_files": index_files, "info": {}})
        file.write(struct.pack(">IH", CLUSTER_MAGIC, len(envelope)) + envelope)
    now = datetime.datetime.now(datetime.UTC)
    final = os.path.join(folder, f"{now:%Y_%m_%d_%H_%M_%S}_{_file_hash(path):016x}.grc")
    os.replace(path, final)
    with open(os.path.join(folder, "history.jsonl"), "w") as file:
        file.write(json.dumps({"date": now.isoformat(), "operation": "build", "name": name, "cluster": os.path.basename(final)}) + "\n")
    return final


def _opened(path: str, magic: int) -> tuple[bytes, dict, int]:
    with open(path, "rb") as file:
        data = file.read()
    found, length = struct.unpack(">IH", data[:6])
    if found != magic:
        raise ValueError(f"{path} is not such a file")
    return data, cbor.decode(data, 6)[0], 6 + length


def read_items(path: str) -> Iterator[dict]:
    """The items of a data file; a record that cannot be read ends it."""
    with open(path, "rb") as file:  # one record at a time: a data file can be 15 GiB long
        found, length = struct.unpack(">IH", file.read(6))
        if found != DATA_MAGIC:
            raise ValueError(f"{path} is not such a file")
        file.seek(6 + length)
        while len(head := file.read(4)) == 4:
            length = struct.unpack(">i", head)[0]
            record = file.read(length) if length > 0 else b""
            if length <= 0 or len(record) < length:
                return
            try:
                yield cbor.decode(record, 0)[0]
            except (ValueError, IndexError):
                return


def read_cluster(spark: SparkSession, path: str) -> DataFrame:
    """The items of a cluster, after its files' hashes and magic numbers have been checked."""
    folder = os.path.dirname(path)
    if int(os.path.basename(path).rpartition("_")[2][:16], 16) != _file_hash(path):
        raise ValueError("the cluster file is damaged")
    _, envelope, _ = _opened(path, CLUSTER_MAGIC)
    for kind, key in (("grd", "data_files"), ("gri", "index_files")):
        for h in envelope[key]:
            if _file_hash(os.path.join(folder, f"{h:016x}.{kind}")) != h:
                raise ValueError(f"{h:016x}.{kind} is damaged")
    files = spark.createDataFrame([(os.path.join(folder, f"{h:016x}.grd"),) for h in envelope["data_files"]], "file string")

    def run(rows):
        import pandas as pd

        for pdf in rows:
            for file in pdf["file"]:
                block: list = []
                for item in read_items(file):
                    body = item["body"] or {}
                    block.append((item["identifier"], item["body_mime_type"], body.get("file_names", []), body.get("mime_type", []), body.get("file_size"), [{"edge_type": a, "target": b} for a, b in item["connections"]], extra_of(body)))
                    if len(block) >= 1000:
                        yield pd.DataFrame(block, columns=names)
                        block = []
                yield pd.DataFrame(block, columns=names)

    def extra_of(body: dict) -> dict:
        return {k: [{"mime": v[0], "value": v[1]} if isinstance(v, list) else {"mime": None, "value": v} for v in values] for k, values in (body.get("extra") or {}).items()}

    names = ["id", "body_mime", "file_names", "mime_types", "file_size", "connections", "extra"]
    return files.repartition(max(1, len(envelope["data_files"]))).mapInPandas(run, "id string, body_mime string, file_names array<string>, mime_types array<string>, file_size long, connections array<struct<edge_type string, target string>>, extra map<string, array<struct<mime string, value string>>>")
