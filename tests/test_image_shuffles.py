"""What the image joins move: bytes a line of the table, and paths as bytes."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import QUERIES
from ledgerloom.operators import images
from ledgerloom.storage import materialised

SF = "/root/testdata/sf0.01"


def shuffled(spark):
    """Bytes that the session's shuffles have written so far."""
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def shuffle_files(spark):
    """Names of the shuffle files that are on the disk."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


@pytest.mark.parametrize("name", ["j03_image_join", "j09_layers"])
def test_bytes_a_line(spark, name):
    """Shuffles of a query write less than 200 bytes for each line of the table; they once wrote more than 300."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        at = shuffled(spark)
        QUERIES[name](spark, SF).collect()
        moved = shuffled(spark) - at
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert 0 < moved < 200 * lines, moved / lines


def test_shuffles_go_when_their_result_is_written(spark):
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    at = shuffle_files(spark)
    out = materialised(counts, "counts", release=True)
    assert not shuffle_files(spark) - at
    materialised(counts.filter("k >= 0"), "counts")
    assert shuffle_files(spark) - at and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_codes_give_paths_back(spark):
    digest = "0123456789abcdef" * 4
    paths = [images.BLOBS + d for d in (digest, digest[:32], digest * 3, digest[:-1], digest.upper(), digest + "\n", "", "ab", "é")] + ["manifest.json", "", digest + "/layer.tar", "x" + images.BLOBS + digest, "\u0001ab", None]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", images.coded(F.col("path")).alias("code"))
    rows = rows.select("path", "code", images.decoded(F.col("code")).alias("back")).collect()
    assert [r.back for r in rows] == paths and len({bytes(r.code) for r in rows if r.code is not None}) == len(paths) - 1
    assert len(rows[0].code) == 33 and rows[-1].code is None
