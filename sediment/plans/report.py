"""The counts of a run."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.merge import mark_new
from sediment.operators.runs import COUNTS
from sediment.sources.tables import append, ensure_table

VERSION = 1


def run_report(layer: str, mode: str, tables: dict[str, dict]) -> dict:
    return {
        "v": VERSION,
        "layer": layer,
        "mode": mode,
        "reconciled": all(t["reconciled"] for t in tables.values()),
        "tables": tables,
    }


def report_json(report: dict) -> str:
    return json.dumps(report)


def report_frame(spark: SparkSession, report: dict) -> DataFrame:
    """One row per table of a report."""
    schema = T.StructType(
        [T.StructField("layer", T.StringType()), T.StructField("table_name", T.StringType())]
        + [T.StructField(n, T.StringType()) for n in ("source", "target")]
        + [T.StructField(n, T.LongType()) for n in COUNTS]
        + [T.StructField("reconciled", T.BooleanType())]
    )
    rows = [
        (report["layer"], name, *[t.get(n) for n in ("source", "target", *COUNTS)], t["reconciled"])
        for name, t in report["tables"].items()
    ]
    return spark.createDataFrame(rows, schema)


def recorded(spark: SparkSession, report: dict, reports: str | None, run_id: str | None, at: Column) -> dict:
    """The report, added to the table `reports` if one is named: a row for each table of the run.

    A run has its say once: a run id that the table holds already is not added again, so a job may be repeated.
    """
    if reports is not None:
        rows = report_frame(spark, report).select(
            F.lit(run_id or uuid.uuid4().hex).alias("run_id"), "*", F.lit(report["mode"]).alias("mode"), F.lit(report_json(report)).alias("report"),
            at.cast("timestamp").alias("reported_at"),
        )
        table = ensure_table(spark, reports, rows.schema)
        runs = mark_new(rows, table.select("run_id").distinct(), ["run_id"])
        append(runs.where(F.col("_action") == "insert").drop("_action").coalesce(1), reports)  # one row for each table of one run
    return report


def bronze_counts(rows: int, distinct: int, inserted: int, before: int, after: int, held: int | None, proved: bool) -> dict:
    """The counts of a Bronze table, reconciled: it had the rows that the last run left, it grew by what was inserted, and what was
    inserted was `proved` to hold each record once and none that the table held."""
    already = distinct - inserted
    return {
        "rows_read": rows,
        "duplicates_removed": rows - distinct,
        "distinct_records": distinct,
        "rows_inserted": inserted,
        "already_in_target": already,
        "rows_in_target": after,
        "reconciled": min(inserted, already) >= 0 and before + inserted == after and held in (None, before) and proved,
    }


def silver_counts(valid: int, inserted: int, updated: int, before: int, after: int, held: int | None = None) -> dict:
    """The counts of an entity's merge, reconciled: the table had the rows that the last run left, and every valid key was
    inserted, updated or equal."""
    unchanged = valid - inserted - updated
    return {
        "rows_inserted": inserted,
        "rows_updated": updated,
        "unchanged": unchanged,
        "rows_in_target": after,
        "reconciled": min(inserted, updated, unchanged) >= 0 and after - before == inserted and held in (None, before),
    }
