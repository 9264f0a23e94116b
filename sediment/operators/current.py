"""The current version of each business key, and the records that cannot become one."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.identity import reversed_hex, value_hash
from sediment.operators.merge import same
from sediment.types import col, cols

_SEEN = ("_seen_at", "_seen_batch")


def key_missing(keys: list[str]) -> Column:
    return functools.reduce(operator.or_, [col(k).isNull() for k in keys])


def split_keyless(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a full key, rows without)."""
    missing = key_missing(keys)
    return df.where(~missing), df.where(missing)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason against them, rows with one)."""
    return df.where(F.size("_reasons") == 0), df.where(F.size("_reasons") > 0)


def latest_ties(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row that shares its key's latest (`_seen_at`, `_seen_batch`).

    The latest is an aggregate joined back on key and time together, so the versions of a busy key
    spread over the cluster by their times instead of meeting in one window.  `df` is used twice; stage it
    first if it takes work.
    """
    latest = (
        df.groupBy(*cols(keys))
        .agg(F.max(F.struct(*_SEEN)).alias("_top"))
        .select(*[col(k).alias(f"_top_{k}") for k in keys], *[F.col(f"_top.{s}").alias(f"_top{s}") for s in _SEEN])
    )
    on = [same(col(k), col(f"_top_{k}")) for k in keys] + [same(col(s), col(f"_top{s}")) for s in _SEEN]
    return df.join(latest, functools.reduce(operator.and_, on), "left_semi")


def current_per_key(df: DataFrame, keys: list[str], value_hash_column: str = "_value_hash") -> DataFrame:
    """The version of each key seen most recently, and `_conflicting`: its latest versions disagree.

    Among versions seen last together the smallest value hash wins, then the fewest reasons, then the
    smallest record hash, so the pick is the same on every run.  Two versions disagree when their value
    hashes differ, that is when the largest is not the smallest.  One aggregate answers all of it, with
    a partial result per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    value = col(value_hash_column)
    order = F.struct(
        F.col("_seen_at"),
        F.col("_seen_batch"),
        reversed_hex(value).alias("value"),
        (-F.size("_reasons")).alias("reasons"),
        reversed_hex(F.col("_record_hash")).alias("record"),
    )
    grouped = df.groupBy(*cols(keys)).agg(
        F.max_by(F.struct(*cols(rest)), order).alias("_row"),
        F.max(F.struct(F.col("_seen_at"), F.col("_seen_batch"), value.alias("value"))).alias("_last"),
    )
    return grouped.select(
        *cols(keys),
        *[F.col("_row").getField(c).alias(c) for c in rest],
        (F.col("_last.value") != F.col("_row").getField(value_hash_column)).alias("_conflicting"),
    )


def conflicting_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose latest versions hold different values."""
    return current_per_key(df, keys).where("_conflicting").select(*cols(keys))


def with_value_hash(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumn("_value_hash", value_hash([df.schema[n] for n in names]))


def quarantine_rows(rejected: DataFrame, bronze: DataFrame, record: Column, at: Column) -> DataFrame:
    """One row per turned-away record: why, the whole record as JSON, and when.

    `rejected` holds `_record_hash` and `_reasons`.  The JSON is built for these records only, by going
    back to Bronze with their hashes.  A record turned away more than once keeps its first reasons
    (shortest list, then by text).
    """
    once = rejected.groupBy("_record_hash").agg(
        F.min(F.struct(F.size("_reasons").alias("n"), F.to_json("_reasons").alias("reasons"))).alias("_why")
    )
    records = bronze.select("_record_hash", record.alias("_record"))
    return records.join(once, "_record_hash").select(
        "_record_hash",
        F.col("_why.reasons").alias("_reasons"),
        "_record",
        at.cast("timestamp").alias("_quarantined_at"),
    )


def still_invalid(quarantine: DataFrame, rejected: DataFrame) -> DataFrame:
    """The quarantined records that are still turned away today."""
    return quarantine.join(rejected.select("_record_hash").distinct(), "_record_hash", "left_semi")
