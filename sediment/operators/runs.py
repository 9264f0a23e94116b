"""Run history: what ran, how it ended and what it reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.identity import reversed_hex
from sediment.functions.runs import FINISHED, run_status, time_of_millis
from sediment.operators.gather import pieces
from sediment.operators.merge import upsert_changed
from sediment.types import col, cols, quoted


def _began() -> Column:
    return F.coalesce("started_at", "created_at")


def recent_first() -> list[Column]:
    """Newest run first: by start (or creation), then run id, unknown ids last, then id."""
    return [_began().desc(), F.desc_nulls_last("run_id"), F.asc("id")]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of the rows in the given order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def awaiting_reports(runs: DataFrame, n: int = 10) -> DataFrame:
    """The successful runs whose report has not been read yet, first finished first."""
    pending = (F.col("status") == "success") & F.col("metrics").isNull() & F.col("run_id").isNotNull()
    return top_n(runs.where(pending), [F.asc_nulls_last("finished_at"), F.asc("id")], n)


def latest_per_group(runs: DataFrame, group: str) -> DataFrame:
    """The newest run of each group, in the order of `recent_first`; ids are numbers or UUID texts."""
    rest = [c for c in runs.columns if c != group]
    numeric = isinstance(runs.schema["id"].dataType, T.NumericType)
    smallest_id = -F.col("id") if numeric else reversed_hex(F.col("id"))
    newest = F.struct(_began().alias("began"), F.col("run_id"), smallest_id.alias("id"))
    return (
        runs.groupBy(col(group))
        .agg(F.max_by(F.struct(*cols(rest)), newest).alias("_run"))
        .select(col(group), *[F.col(f"_run.{quoted(c)}") for c in rest])
    )


def runs_with_names(runs: DataFrame, pipelines: DataFrame, status: str | None = None) -> DataFrame:
    """Runs with the name of their pipeline, of one status if given."""
    if status is not None:
        runs = runs.where(F.col("status") == status)
    return runs.join(pipelines, "pipeline_id")


def remote_runs(listing: DataFrame) -> DataFrame:
    """A scheduler's listing in the columns of the run history.

    Only an ended run has a finish time, only a failed one an error text.
    """
    status = run_status(F.col("life_cycle"), F.col("result"))
    message = F.trim("message")
    return listing.select(
        "pipeline_id",
        "run_id",
        status.alias("status"),
        F.when(F.col("trigger") == "PERIODIC", "schedule").otherwise("manual").alias("triggered_by"),
        time_of_millis(F.col("start_ms")).alias("started_at"),
        F.when(status.isin(*FINISHED), time_of_millis(F.col("end_ms"))).alias("finished_at"),
        F.when((status == "failed") & (message != ""), message).alias("error_message"),
        F.col("url").alias("run_url"),
    )


#: Error texts are long and compress well, so the size of files or shuffles says little of what a task holds of them.
PIECE_BYTES = 1 << 19


def sync_runs(known: DataFrame, remote: DataFrame) -> DataFrame:
    """The history after a sync, with `_action`; who triggered a known run is never overwritten.

    Known runs that have no run id yet cannot be listed remotely.  They go around the join, where they
    would all meet in one task.  The join has as many tasks as the listing's size asks for, whatever its texts compress to.
    """
    waiting = F.col("run_id").isNull()
    keys = ["pipeline_id", "run_id"]
    n = pieces(remote, PIECE_BYTES)
    merged = upsert_changed(
        known.where(~waiting).repartition(n, *cols(keys)),
        remote.repartition(n, *cols(keys)),
        keys,
        compare=["status", "started_at", "finished_at", "error_message", "run_url"],
        protected=["triggered_by"],
        null_safe=False,
    )
    return merged.unionByName(known.where(waiting).withColumn("_action", F.lit("kept")))


# The counts a report may carry, the layers, and the largest count.
COUNTS = (
    "rows_read", "rows_written", "duplicates_removed", "distinct_records", "rows_inserted",
    "already_in_target", "rows_in_target", "sightings_inserted", "sightings_in_target",
    "null_key_records", "distinct_keys", "conflicting_keys", "quarantined_keys", "rows_updated",
    "unchanged", "unmapped_keys", "crosswalk_rows", "crosswalk_version",
)
LAYERS = ("raw", "bronze", "silver")
MAX_COUNT = 2**53


_MEMBERS = (*COUNTS, "source", "target", "extra_source_columns", "reconciled")
_TABLE = "struct<" + ", ".join(f"{m}: variant" for m in _MEMBERS) + ">"


def _typed(value: Column, type_name: str, kind: str) -> Column:
    """A value, if it really is of the kind; other kinds are not converted."""
    return F.when(F.schema_of_variant(value) == kind, F.try_variant_get(value, "$", type_name))


def _text(value: Column) -> Column:
    return _typed(value, "string", "STRING")


def _flag(value: Column) -> Column:
    return _typed(value, "boolean", "BOOLEAN")


def _count(value: Column) -> Column:
    number = _typed(value, "bigint", "BIGINT")
    return F.when(number.between(0, MAX_COUNT), number)


def _extra(value: Column) -> Column:
    listed = F.when(
        F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")
    )
    texts = F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(texts, lambda x: F.try_variant_get(x, "$", "string"))


def sanitize_reports(reports: DataFrame, text: str = "report") -> DataFrame:
    """Untrusted run reports (JSON text) as one row per report and table, with known values only.

    A count has to be a whole number from 0 to 2**53; booleans, fractions and digits in quotes are none.
    Reports of any length and number of tables are read whole.  The run counts as reconciled only if it says so and no
    table says otherwise.  Anything that is not a report of a known layer is left out.

    Each text is parsed once: exploding the one-element array keeps Spark from repeating the parse for
    every member that is read from it.  A variant carries the names of its whole document, so a table's members become plain
    values while they are still in memory: as variants in a row, every one of them would take the names along.
    """
    others = cols(c for c in reports.columns if c != text)

    def member(name: str, type_name: str = "variant") -> Column:
        return F.try_variant_get("_r", f"$.{name}", type_name)

    report = reports.select(*others, F.explode(F.array(F.try_parse_json(col(text)))).alias("_r")).where(
        _text(member("layer")).isin(*LAYERS) & (_typed(member("v"), "bigint", "BIGINT") == 1)
    )
    entries = F.filter(
        F.map_entries(member("tables", "map<string, variant>")),
        lambda e: F.schema_of_variant(e["value"]).startswith("OBJECT"),
    )
    members = F.transform(
        entries, lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], "$", _TABLE).alias("t"))
    )
    tables = F.transform(
        members,
        lambda e: F.struct(
            e["name"].alias("table_name"),
            *[_count(e["t"][k]).alias(k) for k in COUNTS],
            *[_text(e["t"][k]).alias(k) for k in ("source", "target")],
            _extra(e["t"]["extra_source_columns"]).alias("extra_source_columns"),
            _flag(e["t"]["reconciled"]).alias("reconciled"),
        ),
    )
    listed = report.select(
        *others,
        _text(member("layer")).alias("layer"),
        F.coalesce(member("mode", "string"), F.lit("")).alias("mode"),
        F.coalesce(_flag(member("reconciled")), F.lit(False)).alias("_claimed"),
        F.explode(F.array(tables)).alias("_tables"),
    ).where(F.col("_tables").isNotNull())
    no_objection = F.forall("_tables", lambda e: F.coalesce(e["reconciled"], F.lit(True)))
    # Settled before the tables become rows: next to the explode it would take all tables along with each of them.
    judged = listed.select(*others, "layer", "mode", (F.col("_claimed") & no_objection).alias("run_reconciled"), "_tables")
    return judged.select(*others, "layer", "mode", "run_reconciled", F.explode_outer("_tables").alias("_t")).select(
        *others,
        "layer",
        "mode",
        "run_reconciled",
        *[F.col(f"_t.{k}") for k in ("table_name", *COUNTS, "source", "target", "extra_source_columns", "reconciled")],
    )


def apply_run_counts(assets: DataFrame, reported: DataFrame, now: Column) -> DataFrame:
    """The table registry with the row counts of the latest reports.

    `reported` has producer_id, finished_at, target and rows_in_target.  A report reaches only tables
    its own pipeline produces, named by catalog, schema and table; of several the last finished counts,
    and none replaces the numbers of a later run.
    """
    parts = F.split("target", r"\.")
    latest = (
        reported.where((F.size(parts) == 3) & F.col("rows_in_target").isNotNull())
        .select(
            F.col("producer_id").alias("produced_by"),
            *[parts.getItem(i).alias(n) for i, n in enumerate(("catalog", "schema_name", "table_name"))],
            F.coalesce("finished_at", now.cast("timestamp")).alias("_finished"),
            F.col("rows_in_target").alias("_rows"),
        )
        .groupBy("produced_by", "catalog", "schema_name", "table_name")
        .agg(F.max(F.struct("_finished", "_rows")).alias("_latest"))
    )
    joined = assets.join(latest, ["produced_by", "catalog", "schema_name", "table_name"], "left")
    newer = F.col("_latest").isNotNull() & (
        F.col("last_run_at").isNull() | (F.col("_latest._finished") >= F.col("last_run_at"))
    )
    return joined.withColumns(
        {
            "row_count": F.when(newer, F.col("_latest._rows")).otherwise(F.col("row_count")),
            "last_run_at": F.when(newer, F.col("_latest._finished")).otherwise(F.col("last_run_at")),
        }
    ).select(*cols(assets.columns))
