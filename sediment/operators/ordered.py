"""Order-dependent numbering that no single busy key can pull into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.staging import stage
from sediment.types import col, cols


def number_runs(df: DataFrame, keys: list[str], order: list[str], value: str, carry: str | None = None) -> DataFrame:
    """Number the runs of equal `value` of each key in the given order, from 1, as `_run`.

    `_first_of_run` marks the row that opens a run.  With `carry`, the key's largest value of that
    column is added as `_carried`.

    The rows are range-partitioned by key *and* order, which cuts a busy key into pieces of even size.
    Each piece is numbered on its own; the pieces of a key, one small row each, are then put in order
    to find how many runs precede each of them.  (key, order) has to be unique.  The pieces are staged, so
    that all uses see the same ones; inside a `staging` block they are removed at its end.
    """
    keyed = [*keys, "_chunk"]
    spread = df.repartitionByRange(*cols(keys), *cols(order)).withColumn("_chunk", F.spark_partition_id())
    pieces = stage(spread)

    inside = Window.partitionBy(*cols(keyed)).orderBy(*cols(order))
    marked = (
        pieces.withColumn("_place", F.row_number().over(inside))
        .withColumn("_before", F.lag(col(value)).over(inside))
        .withColumn("_opens", (F.col("_place") > 1) & ~col(value).eqNullSafe(F.col("_before")))
        .withColumn("_inner", F.sum(F.col("_opens").cast("long")).over(inside))
    )
    ends = marked.groupBy(*cols(keyed)).agg(
        F.min_by(F.struct(col(value).alias("v")), "_place").alias("_head"),
        F.max_by(F.struct(col(value).alias("v")), "_place").alias("_tail"),
        F.max("_inner").alias("_inner_runs"),
        F.max(col(carry) if carry else F.lit(None).cast("long")).alias("_carry"),
    )
    in_order = Window.partitionBy(*cols(keys)).orderBy("_chunk")
    up_to_here = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*cols(keys))
    offsets = (
        ends.withColumn("_previous", F.lag("_tail").over(in_order))
        .withColumn(
            "_joins",
            F.col("_previous").isNotNull() & F.col("_head.v").eqNullSafe(F.col("_previous.v")),
        )
        .withColumn(
            "_offset",
            F.sum((~F.col("_joins")).cast("long") + F.col("_inner_runs")).over(up_to_here) - F.col("_inner_runs"),
        )
        .withColumn("_carried", F.max("_carry").over(whole))
        .select(
            *[col(k).alias(f"_piece_{k}") for k in keyed], "_offset", "_joins", "_carried"
        )
    )
    on = [col(k).eqNullSafe(col(f"_piece_{k}")) for k in keyed]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return marked.join(offsets, condition).select(
        *cols(df.columns),
        (F.col("_offset") + F.col("_inner")).alias("_run"),
        F.when(F.col("_place") == 1, ~F.col("_joins")).otherwise(F.col("_opens")).alias("_first_of_run"),
        "_carried",
    )
