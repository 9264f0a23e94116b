"""Checks of column lists against the naming and typing rules, all problems at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.rules import RESERVED_COLUMNS, allowed
from sediment.types import cols, normalized_sql_type


def contract_violations(inventory: DataFrame, identity: list[str]) -> DataFrame:
    """Every listed column with `problems`, the codes of the rules it breaks.

    `inventory` has ordinal, name, sql_type, path (array) and source_type.  A name counts as a duplicate
    if a well-formed column before it bears the same name in any case; that first bearer is found by an
    aggregate per name, not by a window over the list.
    """
    well_formed = allowed("identifier", F.col("name")) & ~F.lower("name").isin(*RESERVED_COLUMNS)
    bearers = (
        inventory.where(well_formed)
        .groupBy(*cols(identity), F.lower("name").alias("_lower"))
        .agg(F.min("ordinal").alias("_first"))
    )
    listed = inventory.withColumn("_lower", F.lower("name")).join(
        bearers, [*identity, "_lower"], "left"
    )
    known = normalized_sql_type(F.col("sql_type"))
    cobol = F.col("source_type") == "cobol"
    path = F.col("path")
    segments_ok = (F.size(path) > 0) & F.forall(
        path, lambda p: allowed("path_segment", p)
    )
    checks = [
        ("name_not_identifier", ~allowed("identifier", F.col("name"))),
        ("name_reserved", F.lower("name").isin(*RESERVED_COLUMNS)),
        ("name_duplicate", well_formed & (F.col("ordinal") > F.col("_first"))),
        ("type_unsupported", known.isNull()),
        ("decimal_outside_cobol", known.startswith("DECIMAL(") & ~cobol),
        ("path_outside_cobol", path.isNotNull() & ~cobol),
        ("path_malformed", path.isNotNull() & cobol & ~segments_ok),
    ]
    problems = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks]))
    return listed.select(*cols(inventory.columns), problems.alias("problems"))
