"""Master keys from a crosswalk of (source system, source key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.types import col


def restrict_crosswalk(crosswalk: DataFrame, spec, system: str) -> DataFrame:
    """The distinct (`_cw_key`, `_cw_master`) pairs of one system and, if the spec names one, one kind."""
    rows = crosswalk
    if spec.entity_type_column is not None:
        rows = rows.where(col(spec.entity_type_column).cast("string") == spec.entity_type)
    return (
        rows.where(col(spec.system_column).cast("string") == system)
        .select(
            col(spec.key_column).cast("string").alias("_cw_key"),
            col(spec.master_column).cast("string").alias("_cw_master"),
        )
        .where("_cw_key IS NOT NULL AND _cw_master IS NOT NULL")
        .dropDuplicates(["_cw_key", "_cw_master"])
    )


def ambiguous(pairs: DataFrame) -> DataFrame:
    """Source keys mapped to more than one master key, and to how many."""
    return pairs.groupBy("_cw_key").agg(F.count_distinct("_cw_master").alias("n")).where("n > 1")


class AmbiguousMasterKeys(ValueError):
    """`keys` source keys have more than one master key; `sample` has the first of them."""

    def __init__(self, what: str, keys: int, sample: list[str]):
        super().__init__(f"{what} maps {keys} source keys to more than one master key, for example {sample}")
        self.keys, self.sample = keys, sample


def require_unambiguous(pairs: DataFrame, what: str = "the crosswalk", examples: int = 5) -> None:
    """Stop rather than pick one of several master keys for a source key."""
    found = ambiguous(pairs)
    sample = [r["_cw_key"] for r in found.orderBy("_cw_key").limit(examples).collect()]
    if sample:
        raise AmbiguousMasterKeys(what, found.count(), sample)


def lookup_master(df: DataFrame, pairs: DataFrame, key: str, column: str, unknown: str) -> DataFrame:
    """Add the master key, `unknown` where there is none, and `_master_key_resolved`.

    Keys compare as text.  The join carries no hint: Spark broadcasts the pairs once it knows that they
    are small, and shuffles otherwise.
    """
    return (
        df.join(pairs, col(key).cast("string") == F.col("_cw_key"), "left")
        .withColumns(
            {
                column: F.coalesce("_cw_master", F.lit(unknown)),
                "_master_key_resolved": F.col("_cw_master").isNotNull(),
            }
        )
        .drop("_cw_key", "_cw_master")
    )
