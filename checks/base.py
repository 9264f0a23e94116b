"""The registry of checked queries: each a DataFrame and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sediment.operators.gather import pieces
from sediment.types import cols

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


_SCHEMAS: dict[str, StructType] = {}

# Keys that spread the rows of a table evenly.
_KEYS = {
    "customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread(df: DataFrame, keys: list[str], piece_bytes: int | None = None) -> DataFrame:
    """The rows of one small file on all cores, with `piece_bytes` in pieces of that size at most; a source with enough splits as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = pieces(df, piece_bytes) if piece_bytes else cores
    return df.repartition(n, *cols(keys)) if df.rdd.getNumPartitions() < n else df


def spread_table(spark: SparkSession, sf_dir: str, name: str, piece_bytes: int | None = None) -> DataFrame:
    """A given table for costly work per row, on all cores even if it is one small file."""
    return spread(table(spark, sf_dir, name), _KEYS[name], piece_bytes)


def time_text(value) -> Column:
    """An instant as text, the same in both engines."""
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_time_text(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_canonical(value: str) -> str:
    """A value's canonical text in SQL."""
    text = f"({value})::VARCHAR"
    return f"CASE WHEN ({value}) IS NULL THEN 'N' ELSE 'V' || length({text}) || ':' || {text} END"


def sql_hash(*values: str) -> str:
    """A record hash in SQL."""
    return "sha256(concat_ws('|', " + ", ".join(sql_canonical(v) for v in values) + "))"
