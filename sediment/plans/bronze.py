"""Bronze: one copy of each distinct record, and the loads it was seen in."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sediment.functions.identity import packed, record_hash
from sediment.operators.bronze import (
    PIECE_BYTES, counted_sightings, dealt_by_hash, distinct_stats, earliest_copies, hashed, sightings, with_record_copies,
)
from sediment.operators.gather import fits_every_task, gathered, whole_pieces
from sediment.operators.merge import mark_new, same
from sediment.operators.projections import guard_schema
from sediment.plans.report import bronze_counts, recorded, run_report
from sediment.sources.tables import append, bucket_count, buckets_for, ensure_table, job_session, record_rows, recorded_rows, refresh, row_count
from sediment.staging import stage, staged_table, staging
from sediment.types import LINEAGE_COLUMNS


#: What is staged and kept is hashes for the most part; only an entropy coder makes less of their hexadecimal digits.
HASH_CODEC = "zstd"

#: So many rows of a bucket are compared with the table's at a time, as a task sorts both; but a plan has no more than so many comparisons.
COMPARED_ROWS, MOST_RANGES = 2_000_000, 32


def _buckets(spark: SparkSession) -> int:
    """The buckets that a job's session is made for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _marked(source: DataFrame, target: DataFrame, keys: list[str], rows: int, null_safe: tuple[str, ...] = ()) -> DataFrame:
    """`mark_new` by ranges of the hash, which is spread evenly; `rows` are those of the larger side.

    A task has a range of a bucket at a time, however few buckets there are.  Files are sorted by the hash, so a range is read without most of the rest.
    """
    slices = min(MOST_RANGES, max(1, -(-rows // (_buckets(source.sparkSession) * COMPARED_ROWS))))
    edges = [f"{i * 2**32 // slices:08x}" for i in range(1, slices)]
    parts = []
    for low, high in zip([None, *edges], [*edges, None]):
        within = (F.lit(True) if low is None else F.col("_record_hash") >= low) & (F.lit(True) if high is None else F.col("_record_hash") < high)
        parts.append(mark_new(source.where(within), target.where(within), keys, null_safe=null_safe))
    return functools.reduce(DataFrame.unionByName, parts)


def _new_records(seen: DataFrame, bronze: DataFrame, held: int) -> tuple[DataFrame, dict]:
    """The hashes Bronze, which has `held` rows, lacks, staged, and the counts of rows, records and new ones.

    A table without rows is not compared with.  The counts are taken in the stage that writes, so a task that runs twice before the shuffle does
    not count twice.
    """
    tally = Observation()
    per_record = seen.where(F.col("_record_copies").isNotNull()).select("_record_hash", F.col("_record_copies").alias("_copies"))
    if held:
        marked = _marked(per_record, bronze, ["_record_hash"], max(seen.count(), held))
    else:
        marked = per_record.withColumn("_action", F.lit("insert"))
    is_new = F.col("_action") == "insert"
    observed = marked.observe(
        tally,
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(is_new).alias("new"),
    )
    fresh = stage(observed.where(is_new).select("_record_hash"), HASH_CODEC)
    return fresh, tally.get


def first_copies(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The first copy of each new record.

    Raw is read a second time here, and may hold more than at the first; only the staged hashes get through,
    so a record that came in between is left to the next run.  Known records are neither shuffled nor sorted
    where Spark finds `fresh` small enough to be sent to all tasks, which it knows, as it is staged.  Else rows are shuffled without
    their hash, which they have all they need to make again, into pieces by the size of Raw, as a task sorts whole rows.
    """
    if not fits_every_task(fresh):
        columns = [c for c in rows.columns if c not in (*LINEAGE_COLUMNS, "_record_hash")]
        n = whole_pieces(rows, PIECE_BYTES, _buckets(rows.sparkSession))
        dealt = rows.drop("_record_hash").repartition(n, record_hash(rows.schema[c] for c in columns))
        rows, fresh = hashed(dealt, columns), dealt_by_hash(fresh, n)
    return earliest_copies(rows.join(fresh, "_record_hash", "left_semi"))


def _append_sightings(seen: DataFrame, target: str) -> int:
    """Append the sightings the table lacks; returns how many.

    Those of loads that the table has no sighting of are all new; only the others are compared with the table's of the same loads.
    The loads, one row each, are sent to all tasks, so that rows stay where they are.
    """
    tally, held = Observation(), seen.sparkSession.table(target)
    loads = mark_new(seen.select("_batch_id").distinct(), held.select("_batch_id").distinct(), ["_batch_id"], null_safe=["_batch_id"])
    loads = stage(loads.withColumnRenamed("_batch_id", "_load"))

    def of(rows, action):
        return rows.join(F.broadcast(loads.where(F.col("_action") == action)), same(F.col("_batch_id"), F.col("_load")), "left_semi")

    rows = seen.select("_record_hash", "_batch_id", "_ingested_at")
    fresh = of(rows, "insert")
    if loads.where(F.col("_action") == "unchanged").count():
        known = of(rows, "unchanged"), of(held, "unchanged")
        marked = _marked(*known, ["_record_hash", "_batch_id"], seen.count(), null_safe=("_batch_id",))
        fresh = fresh.unionByName(marked.where(F.col("_action") == "insert").drop("_action"))
    append(fresh.observe(tally, F.count(F.lit(1)).alias("new")), target)
    return tally.get["new"]


def build_bronze(
    spark: SparkSession,
    raw: str,
    bronze: str,
    columns: list[str],
    *,
    sightings_table: str | None = None,
    batch_ids: list[str] | None = None,
    buckets: int | None = None,
    reports: str | None = None,
    run_id: str | None = None,
) -> dict:
    """Merge a Raw table into its Bronze table and sightings, insert-only, and return the counts.

    `columns` are the compared ones: they are the record's identity and stay fixed; columns that Raw
    gained are reported, one it lost is an error.  `batch_ids` reads only those loads: as nothing in
    Bronze is ever changed, merging the loads added since the last run gives the rows a full run gives.
    Both tables are bucketed by the record hash, so neither this merge nor the Silver join shuffles them;
    `buckets` counts when the tables are created; by default they are as many as Raw's size asks for.

    What a run costs follows what it reads of Raw: of Bronze it reads the hashes to compare, and the footers that say how many rows there are.
    That each record is there once follows from the increment: the staged copies hold each new hash once, new is what the table lacked, the
    table grew by just these, and before it had the rows that the last run left.
    """
    buckets = bucket_count(spark, bronze) or buckets or buckets_for(spark, raw)
    caller, spark = spark, job_session(spark, buckets)
    sightings_table = sightings_table or f"{bronze}_sightings"
    source = spark.table(raw)
    extra = guard_schema(source, columns, raw)
    if batch_ids is not None:
        source = source.where(F.col("_batch_id").isin(*batch_ids))
    rows = hashed(source, columns)
    order = [*columns, "_record_hash", "_ingested_at", "_source_file", "_batch_id"]
    by_hash = {"bucket_by": ["_record_hash"], "buckets": buckets, "codec": HASH_CODEC}
    target = ensure_table(spark, bronze, rows.select(*order).schema, **by_hash)
    ensure_table(spark, sightings_table, sightings(rows).schema, **by_hash)

    incoming = with_record_copies(counted_sightings(rows, buckets, pack=True))
    with staging(spark), staged_table(incoming, bronze, buckets, ["_record_hash"], HASH_CODEC) as seen:
        held, before = recorded_rows(spark, bronze), row_count(spark, bronze)
        fresh, counts = _new_records(seen, target, before)
        proved = True
        if counts["new"]:
            copies = stage(first_copies(rows, fresh), HASH_CODEC)
            added = distinct_stats(gathered(copies.select(packed(F.col("_record_hash")).alias("_record_hash")), ["_record_hash"], PIECE_BYTES)).first()
            proved = added["rows"] == added["distinct_records"] == counts["new"]
            append(copies, bronze)
        new_sightings = _append_sightings(seen, sightings_table)
    after = row_count(spark, bronze)
    record_rows(spark, bronze, after)
    refresh(caller, bronze, sightings_table)
    done = {
        "source": raw,
        "target": bronze,
        **bronze_counts(counts["rows"], counts["records"], counts["new"], before, after, held, proved),
        "sightings_inserted": new_sightings,
        "sightings_in_target": row_count(spark, sightings_table),
        "extra_source_columns": extra,
    }
    recorded(caller, run_report("bronze", "full", {bronze: done}), reports, run_id, F.current_timestamp())
    return done


def build_bronze_tables(spark: SparkSession, tables: dict[str, dict], *, reports: str | None = None, run_id: str | None = None, **options) -> dict:
    """Several Bronze tables in one run; `tables` maps a name to raw, bronze and columns."""
    done = run_report("bronze", "full", {n: build_bronze(spark, **t, **options) for n, t in tables.items()})
    return recorded(spark, done, reports, run_id, F.current_timestamp())
