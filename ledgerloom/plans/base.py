"""What queries share: registration, tables, and inputs picked from fixed lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(key: str, values) -> Column:
    """One of the values for each row, by its key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def picked_sql(key: str, values) -> str:
    return f"([{', '.join(map(quoted, values))}])[{key} % {len(values)} + 1]"


def values_sql(rows) -> str:
    """A VALUES list of strings."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


GITOID_SQL = "'gitoid:blob:sha256:' || sha256('blob ' || strlen(text) || chr(0) || text)"
# The containment tree of regions, nations, customers, orders and lines.
TREE_SQL = """tree AS (
    SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation
    UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
    UNION SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
    UNION SELECT 'O' || l_orderkey, 'L' || l_orderkey || '-' || l_linenumber FROM lineitem)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst) of the containment tree."""
    own = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("O"), "l_orderkey").alias("src"), F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("dst"))
    upper = own("nation", "R", "n_regionkey", "N", "n_nationkey").unionByName(own("customer", "N", "c_nationkey", "C", "c_custkey")).unionByName(own("orders", "C", "o_custkey", "O", "o_orderkey"))
    return upper.unionByName(lines.distinct())
