"""Merging a batch into a keyed table."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.types import col, cols

ACTIONS = ("insert", "update", "unchanged", "kept")


def same(left: Column, right: Column) -> Column:
    """Equality in which null equals null."""
    return left.eqNullSafe(right)


def _all(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions)


def row_changed(names: Iterable[str], old, new) -> Column:
    """Whether any of the columns differs; `old` and `new` give the column of a name."""
    return functools.reduce(
        operator.or_, [~same(old(c), new(c)) for c in names], F.lit(False)
    )


def new_rows(source: DataFrame, target: DataFrame, keys: list[str], *, null_safe: Iterable[str] = ()) -> DataFrame:
    """Source rows whose key the target does not hold yet: all an insert-only merge has to append."""
    null_safe = set(null_safe)
    held = target.select(*[col(k).alias(f"_held_{k}") for k in keys])
    matches = [
        same(col(k), col(f"_held_{k}")) if k in null_safe else col(k) == col(f"_held_{k}") for k in keys
    ]
    return source.join(held, _all(matches), "left_anti")


def mark_new(source: DataFrame, target: DataFrame, keys: list[str], *, null_safe: Iterable[str] = ()) -> DataFrame:
    """The source with `_action`: `insert` where the target lacks the key, else `unchanged`.

    Counting the actions right here, in the stage that writes, is exact even if tasks before the shuffle
    run twice.  The target holds each key once.
    """
    null_safe = set(null_safe)
    held = target.select(*[col(k).alias(f"_held_{k}") for k in keys], F.lit(True).alias("_held"))
    matches = [
        same(col(k), col(f"_held_{k}")) if k in null_safe else col(k) == col(f"_held_{k}") for k in keys
    ]
    action = F.when(F.col("_held").isNull(), "insert").otherwise("unchanged")
    return source.join(held, _all(matches), "left").select(*cols(source.columns), action.alias("_action"))


def merge_insert_only(target: DataFrame, source: DataFrame, keys: list[str], *, null_safe: Iterable[str] = ()) -> DataFrame:
    """The target after the merge; rows it already had stay as they are."""
    return target.unionByName(
        new_rows(source, target, keys, null_safe=null_safe).select(*cols(target.columns))
    )


def _both_sides(before: DataFrame, after: DataFrame, on: Column, incoming_only: bool = False) -> DataFrame:
    """All rows of both tables, matched where they match; without those of `before` alone if `incoming_only`.

    A full outer join can't be split where one key has very many rows.  So it is made of one that keeps the left rows and one
    that finds the right rows without a match, both of which adaptive execution splits on their many-row side.
    """
    if incoming_only:
        return after.join(before, on, "left")
    alone = after.join(before, on, "left_anti")
    return before.join(after, on, "left").unionByName(alone, allowMissingColumns=True)


def upsert_changed(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    *,
    compare: Iterable[str] | None = None,
    protected: Iterable[str] = (),
    null_safe: bool = True,
    incoming_only: bool = False,
) -> DataFrame:
    """The target after the merge, each row with its `_action`.

    `insert`: the key is new.  `update`: a compared column differs; all columns but the protected ones
    come from the source.  `unchanged`: the key came in with equal values.  `kept`: it did not come in
    (left out with `incoming_only`).
    Compared are all columns outside the key unless named.  The source holds each key once; with
    `null_safe` off, neither side may hold a null key.
    """
    columns, protected = target.columns, set(protected)
    compare = [c for c in columns if c not in keys] if compare is None else list(compare)

    def old(c):
        return col(f"_old_{c}")

    def new(c):
        return col(f"_new_{c}")

    on = _all(same(old(k), new(k)) if null_safe else old(k) == new(k) for k in keys)
    joined = _both_sides(
        target.select(*[col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_in_old")),
        source.select(*[col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_in_new")),
        on, incoming_only,
    )
    action = (
        F.when(F.col("_in_old").isNull(), "insert")
        .when(F.col("_in_new").isNull(), "kept")
        .when(row_changed(compare, old, new), "update")
        .otherwise("unchanged")
    )
    marked = joined.withColumn("_action", action)
    fresh = F.col("_action").isin("insert", "update")
    inserted = F.col("_action") == "insert"
    return marked.select(
        *[
            F.when(inserted if c in protected else fresh, new(c)).otherwise(old(c)).alias(c)
            for c in columns
        ],
        "_action",
    )


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys both tables hold whose other columns differ, with the new values."""
    return upsert_changed(old, new, keys).where(F.col("_action") == "update").drop("_action")


def backfill(target: DataFrame, source: DataFrame, keys: list[str], only_if_empty: Iterable[str] = ()) -> DataFrame:
    """Insert the keys the target lacks, and fill its empty columns in `only_if_empty` from the source."""
    only_if_empty = set(only_if_empty)
    columns = target.columns
    joined = _both_sides(
        target.select(*[col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_in_old")),
        source.select(*[col(c).alias(f"_new_{c}") for c in columns]),
        _all(same(col(f"_old_{k}"), col(f"_new_{k}")) for k in keys),
    )
    missing = F.col("_in_old").isNull()

    def pick(c):
        old, new = col(f"_old_{c}"), col(f"_new_{c}")
        if c in only_if_empty:
            return F.coalesce(old, new).alias(c)
        return F.when(missing, new).otherwise(old).alias(c)

    return joined.select(*[pick(c) for c in columns])


def action_counts(merged: DataFrame) -> list[Column]:
    """Aggregates that count a merge's actions in one pass."""
    return [F.count_if(F.col("_action") == a).alias(f"rows_{a}") for a in ACTIONS]
