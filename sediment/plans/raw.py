"""Raw: every load of a source appended as it came, with its lineage."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sediment.operators.projections import with_lineage
from sediment.plans.report import recorded, run_report
from sediment.sources.files import MALFORMED, LoadSpec, scan
from sediment.sources.tables import append, ensure_table, record_rows, recorded_rows, row_count
from sediment.types import LINEAGE_COLUMNS, cols


def load_time(at: datetime | None) -> Column:
    """The time of a load: the one given, or the start of the query."""
    return F.current_timestamp() if at is None else F.lit(at).cast("timestamp")


def raw_rows(spark: SparkSession, spec: LoadSpec, batch_id: str, at: Column) -> DataFrame:
    """The rows of one load with their lineage, and `_malformed` where the format can tell.

    Only the RDD-based reader of fixed records cannot name the file of a row; it gets the path read.
    """
    rows = scan(spark, spec)
    plain_records = spec.format == "fixed"
    return with_lineage(rows, batch_id, at, spec.path if plain_records else None)


def load_raw(
    spark: SparkSession,
    spec: LoadSpec,
    target: str,
    *,
    batch_id: str | None = None,
    at: datetime | None = None,
    reports: str | None = None,
    run_id: str | None = None,
) -> dict:
    """Append one load to a Raw table and return its counts.

    The table is partitioned by load.  The rows are counted by the write itself and compared with the
    load's partition before and after; how many rows there are in all follows from what the load before it has recorded.  A row that does not fit the schema keeps in Raw what fits; its whole
    text goes to the table `<target>_malformed`, so nothing of it is lost.
    """
    batch_id = batch_id or uuid.uuid4().hex
    rows = raw_rows(spark, spec, batch_id, load_time(at))
    kept = rows.drop(MALFORMED)
    table = ensure_table(spark, target, kept.schema, partition_by=["_batch_id"])
    load = F.col("_batch_id") == batch_id
    held, before = recorded_rows(spark, target), table.where(load).count()
    if held is None:  # no load has said how many there are
        held = row_count(spark, target)
    seen = Observation()
    malformed = F.count(F.col(MALFORMED)) if MALFORMED in rows.columns else F.lit(0)
    append(
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), malformed.alias("malformed")).select(*kept.columns),
        target,
    )
    counts = seen.get
    texts = _keep_malformed(rows, f"{target}{MALFORMED}", batch_id) if counts["malformed"] else 0
    written = spark.table(target).where(load).count() - before
    record_rows(spark, target, held + written)
    done = {
        "source": spec.path,
        "target": target,
        "rows_read": counts["rows"],
        "rows_written": written,
        "rows_malformed": counts["malformed"],
        "rows_in_target": held + written,
        "reconciled": written == counts["rows"] and texts == counts["malformed"],
    }
    recorded(spark, run_report("raw", "append", {target: done}), reports, run_id, load_time(at))
    return done


def _keep_malformed(rows: DataFrame, target: str, batch_id: str) -> int:
    """Append the texts of the rows that do not fit; returns by how many the table's load grew.

    Whether a row fits shows only when all its columns are read, so all are asked for.
    """
    whole = F.length(F.to_json(F.struct(*cols(c for c in rows.columns if c != MALFORMED)))) > 0
    texts = rows.where(F.col(MALFORMED).isNotNull() & whole).select(F.col(MALFORMED).alias("_text"), *cols(LINEAGE_COLUMNS))
    table = ensure_table(rows.sparkSession, target, texts.schema, partition_by=["_batch_id"])
    load = F.col("_batch_id") == batch_id
    before = table.where(load).count()
    append(texts, target)
    return rows.sparkSession.table(target).where(load).count() - before


def load_tables(
    spark: SparkSession,
    specs: dict[str, LoadSpec],
    database: str,
    *,
    batch_id: str | None = None,
    at: datetime | None = None,
    reports: str | None = None,
    run_id: str | None = None,
) -> dict:
    """Load several sources, one table each, under one batch; returns the run's report, and adds it to the table `reports`."""
    batch_id = batch_id or uuid.uuid4().hex
    done = {
        name: load_raw(spark, spec, f"{database}.{name}", batch_id=batch_id, at=at)
        for name, spec in specs.items()
    }
    return recorded(spark, run_report("raw", "append", done), reports, run_id, load_time(at))
