"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialised, remove_materialised, shared_folder

__all__ = ["Remembered", "bounded_batches", "materialised", "remove_materialised", "shared_folder", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Keep Arrow batches of whole texts small: at most ``rows`` rows, and about ``size`` bytes, go to Python at once.

    The two settings stay in the session, as batches are cut when a result is computed.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.isdigit() or int(now) > most:  # the default of bytes has a unit
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def text_or_empty(column: str = "text"):
    """The text column; a null counts as an empty text."""
    return F.coalesce(F.col(column), F.lit(""))


class Remembered(dict):
    """Results of ``function`` by argument; emptied when it holds more than ``limit`` of them."""

    def __init__(self, function, limit: int = 400_000):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value
