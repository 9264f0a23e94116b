"""Silver: clean, typed entities, one current row per business key."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.bronze import with_last_seen
from sediment.operators.current import (
    current_per_key, quarantine_rows, split_keyless, split_valid, with_value_hash,
)
from sediment.operators.masterkey import lookup_master, require_unambiguous, restrict_crosswalk
from sediment.operators.merge import mark_new, upsert_changed
from sediment.operators.projections import project_attributes, record_json, stamp
from sediment.plans.raw import load_time
from sediment.plans.report import recorded, run_report, silver_counts
from sediment.plans.spec import Entity, SilverSpec, compile_silver
from sediment.sources.tables import (
    append, bucket_count, bucket_of, buckets_for, ensure_table, job_session, record_rows, recorded_rows, refresh, replace_partitions, row_count, table_version,
)
from sediment.staging import stage, staging
from sediment.types import cols

_SEEN = ["_record_hash", "_seen_at", "_seen_batch"]

#: The partition column of a Silver table: the bucket of the row's business key.
BUCKET = "_bucket"


@dataclass(frozen=True)
class Versions:
    """An entity's records, sorted out: the current version of each key, and the records without one."""

    current: DataFrame
    keyless: DataFrame

    @property
    def valid(self) -> DataFrame:
        return split_valid(self.current)[0]

    @property
    def rejected(self) -> DataFrame:
        """Hash and reasons of everything that goes to quarantine."""
        invalid = split_valid(self.current)[1]
        return invalid.select("_record_hash", "_reasons").unionByName(
            self.keyless.select("_record_hash", "_reasons")
        )


def seen_records(bronze: DataFrame, sightings: DataFrame, entities: tuple[Entity, ...]) -> DataFrame:
    """The columns that the entities need of a Bronze table, each record with its last sighting."""
    needed = list(dict.fromkeys(a.source for e in entities for a in e.attributes))
    return with_last_seen(bronze.select(*cols(needed), "_record_hash", "_ingested_at", "_batch_id"), sightings)


def versions_of(records: DataFrame, entity: Entity) -> Versions:
    """Type and clean records with their last sighting and pick the current version of each key."""
    keys = list(entity.business_key)
    typed = project_attributes(records, entity.attributes, _SEEN)
    keyed, keyless = split_keyless(typed, keys)
    return Versions(current_per_key(with_value_hash(keyed, [a.name for a in entity.attributes]), keys), keyless)


def versions(bronze: DataFrame, sightings: DataFrame, entity: Entity) -> Versions:
    """The versions of one entity, straight from a Bronze table and its sightings."""
    return versions_of(seen_records(bronze, sightings, (entity,)), entity)


def entity_rows(valid: DataFrame, entity: Entity, system: str, at: Column) -> DataFrame:
    """The rows of the Silver table, in its column order."""
    master = [entity.master_key.column, "_master_key_resolved"] if entity.master_key else []
    names = [a.name for a in entity.attributes] + master
    stamped = stamp(valid, system, at)
    return stamped.select(*cols(names), "_source_system", "_record_hash", "_updated_at")


def compared_columns(entity: Entity) -> list[str]:
    """The columns whose change makes an update."""
    master = [entity.master_key.column, "_master_key_resolved"] if entity.master_key else []
    return [a.name for a in entity.attributes if a.name not in entity.business_key] + master


def _quarantine(spark: SparkSession, found: Versions, bronze: DataFrame, entity: Entity, at: Column) -> int:
    """Add the turned-away records the quarantine does not hold yet; returns the records without a key."""
    rejected = stage(
        split_valid(found.current)[1].select("_record_hash", "_reasons", F.lit(False).alias("_keyless"))
        .unionByName(found.keyless.select("_record_hash", "_reasons", F.lit(True).alias("_keyless")))
    )
    schema = "_record_hash string, _reasons string, _record string, _quarantined_at timestamp"
    table = ensure_table(spark, entity.quarantine_table, T.StructType.fromDDL(schema))
    fresh = mark_new(rejected, table, ["_record_hash"]).where(F.col("_action") == "insert")
    append(quarantine_rows(fresh, bronze, record_json(bronze), at), entity.quarantine_table)
    return rejected.agg(F.count_if("_keyless")).first()[0]


def _merge(spark: SparkSession, rows: DataFrame, entity: Entity, buckets: int) -> dict:
    """Bring the entity's table up to date; writes only the buckets in which something changed.

    The table is bucketed by its business key, and each bucket is a partition of its own (`_bucket`): a join by the key
    does not shuffle it, and an update replaces the partitions of the updated keys alone.  New keys of other buckets are
    appended, and no difference writes nothing.
    """
    keys = list(entity.business_key)
    rows = rows.withColumn(BUCKET, bucket_of(keys, buckets))
    target = ensure_table(spark, entity.target, rows.schema, bucket_by=keys, buckets=buckets, partition_by=[BUCKET])
    held, before = recorded_rows(spark, entity.target), row_count(spark, entity.target)
    incoming = stage(
        upsert_changed(target, rows, keys, compare=compared_columns(entity), null_safe=False, incoming_only=True)
    )
    tally = incoming.agg(
        F.count(F.lit(1)).alias("valid"),
        F.count_if(F.col("_action") == "insert").alias("inserted"),
        F.count_if(F.col("_action") == "update").alias("updated"),
        F.collect_set(F.when(F.col("_action") == "update", F.col(BUCKET))).alias("touched"),  # as many as buckets at most
    ).first()
    fresh = incoming.where(F.col("_action").isin("insert", "update")).drop("_action")
    by_bucket = [buckets, *cols(keys)]
    touched = F.col(BUCKET).isin(*tally["touched"])
    if tally["updated"]:
        replaced = incoming.where(F.col("_action") == "update").select(*cols(keys))
        kept = target.where(touched).join(replaced, keys, "left_anti")
        replace_partitions(kept.unionByName(fresh.where(touched)).repartition(*by_bucket), entity.target)
    if tally["inserted"]:
        append(fresh.where(~touched).repartition(*by_bucket), entity.target)
    after = row_count(spark, entity.target)
    record_rows(spark, entity.target, after)
    return silver_counts(tally["valid"], tally["inserted"], tally["updated"], before, after, held)


def build_entity(
    spark: SparkSession, spec: SilverSpec, entity: Entity, records: DataFrame, rows_read: int, at: Column, buckets: int
) -> dict:
    """One entity of staged records: current versions, quarantine, master keys, merge.  Returns its counts."""
    bronze = spark.table(spec.bronze)
    found = versions_of(records, entity)
    current = stage(found.current)
    found = Versions(current, found.keyless)
    tally = current.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count_if("_conflicting").alias("conflicting"),
        F.count_if(F.size("_reasons") > 0).alias("invalid"),
    ).first()
    keyless = _quarantine(spark, found, bronze, entity, at)

    valid, crosswalk = found.valid, {}
    unmapped = 0
    if entity.master_key:
        mk = entity.master_key
        pairs = stage(restrict_crosswalk(spark.table(mk.crosswalk), mk, spec.system))
        require_unambiguous(pairs, mk.crosswalk)
        valid = stage(
            lookup_master(valid, pairs, entity.business_key[0], mk.column, spec.unknown_master_key)
        )
        unmapped = valid.where(~F.col("_master_key_resolved")).count()
        crosswalk["crosswalk_rows"] = pairs.count()
        version = table_version(spark, mk.crosswalk)
        if version is not None:
            crosswalk["crosswalk_version"] = version
    merged = _merge(spark, entity_rows(valid, entity, spec.system, at), entity, bucket_count(spark, entity.target) or buckets)
    return {
        "source": spec.bronze,
        "target": entity.target,
        "rows_read": rows_read,
        "null_key_records": keyless,
        "distinct_keys": tally["keys"],
        "conflicting_keys": tally["conflicting"],
        "quarantined_keys": tally["invalid"],
        "unmapped_keys": unmapped,
        **merged,
        **crosswalk,
    }


def build_entities(
    spark: SparkSession, spec: SilverSpec, *, at: datetime | None = None, buckets: int | None = None,
    reports: str | None = None, run_id: str | None = None,
) -> dict:
    """All entities of a specification from one Bronze table; returns the run's report, and adds it to the table `reports`.

    The specification is checked first, against the tables as they are now.  The records are joined with their
    last sightings once, for all entities.  A Silver table has the buckets it was made with; a new one gets `buckets`, by default as many as Bronze has.
    """
    buckets = buckets or bucket_count(spark, spec.bronze) or buckets_for(spark, spec.bronze)
    caller, spark = spark, job_session(spark, buckets)
    spec = compile_silver(spark, spec)
    time = load_time(at)
    with staging(spark):
        tally = Observation()
        records = seen_records(spark.table(spec.bronze), spark.table(spec.sightings), spec.entities)
        records = stage(records.observe(tally, F.count(F.lit(1)).alias("rows")))
        done = {e.name: build_entity(spark, spec, e, records, tally.get["rows"], time, buckets) for e in spec.entities}
    refresh(caller, *[t for e in spec.entities for t in (e.target, e.quarantine_table)])
    return recorded(caller, run_report("silver", "full", done), reports, run_id, time)
