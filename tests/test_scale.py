"""Plans and results when one key, record or source holds a third of the rows."""

import pytest
from pyspark.sql import functions as F

from checks.loads import CUSTOMER, LINE_COLUMNS, line_raw
from sediment.operators.bronze import earliest_copies, first_seen, hashed, last_seen, sightings
from sediment.operators.current import conflicting_keys, current_per_key, latest_ties, with_value_hash
from sediment.operators.masterkey import lookup_master
from checks.base import spread
from sediment.operators.gather import pieces
from sediment.staging import stage, staging, staging_folder

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def busy_versions(spark, n=3000):
    """Versions of keys; every third row belongs to one key, and many of its versions are seen last."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    df = spark.range(n).select(
        key.alias("k"),
        (F.col("id") % 7).cast("string").alias("v"),
        F.array().cast("array<string>").alias("_reasons"),
        F.sha2(F.col("id").cast("string"), 256).alias("_record_hash"),
        F.timestamp_seconds(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.col("id"))).alias("_seen_at"),
        F.lit("L").alias("_seen_batch"),
    )
    return with_value_hash(df.repartition(6), ["v"])


def test_current_version_of_a_busy_key(spark):
    df = busy_versions(spark)
    rows = df.collect()
    latest = {}
    for r in rows:
        latest[r["k"]] = max(latest.get(r["k"], r["_seen_at"]), r["_seen_at"])
    ties = {}
    for r in rows:
        if r["_seen_at"] == latest[r["k"]]:
            ties.setdefault(r["k"], []).append(r)
    picked = {k: min(t, key=lambda r: (r["_value_hash"], r["_record_hash"]))["_record_hash"] for k, t in ties.items()}
    current = current_per_key(df, ["k"])
    assert {r["k"]: r["_record_hash"] for r in current.collect()} == picked
    assert latest_ties(df, ["k"]).count() == sum(map(len, ties.values()))
    assert [r["k"] for r in conflicting_keys(df, ["k"]).collect()] == [
        k for k, t in ties.items() if len({r["_value_hash"] for r in t}) > 1
    ]
    text = plan(current_per_key(df, ["k"]))
    assert "partial_max_by" in text and "Window" not in text and text.count("Exchange hashpartitioning") == 1


def test_copies_collapse_before_the_shuffle(spark):
    rows = hashed(line_raw(spark, SF), LINE_COLUMNS)
    for df, partial in ((first_seen(rows), "partial_min_by"), (sightings(rows), "partial_min")):
        text = plan(df)
        assert partial in text and "Window" not in text and text.count("Exchange hashpartitioning(_record_hash") == 1


def test_first_copies_are_picked_before_the_shuffle(spark):
    text = plan(earliest_copies(hashed(line_raw(spark, SF), LINE_COLUMNS)))
    assert text.count("WindowGroupLimit") == 2 and text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_the_hash_is_computed_once_per_use(spark):
    rows = hashed(line_raw(spark, SF), LINE_COLUMNS)
    joined = first_seen(rows).join(sightings(rows), "_record_hash", "left")
    assert "isnotnull(" not in plan(joined)


def test_a_scan_reads_only_what_the_entity_needs(spark, db):
    from sediment.plans.silver import versions

    spark.createDataFrame(
        [], "custkey BIGINT, name STRING, seat STRING, segment STRING, balance DECIMAL(15,2), unused STRING, "
        "_record_hash STRING, _ingested_at TIMESTAMP, _source_file STRING, _batch_id STRING",
    ).write.saveAsTable(f"{db}.b")
    spark.createDataFrame([], "_record_hash STRING, _batch_id STRING, _ingested_at TIMESTAMP").write.saveAsTable(f"{db}.s")
    text = plan(versions(spark.table(f"{db}.b"), spark.table(f"{db}.s"), CUSTOMER).valid)
    assert "unused" not in text and "_source_file" not in text and "IsNotNull(custkey)" in text


def test_crosswalk_join_carries_no_hint(spark):
    pairs = spark.range(10).selectExpr("cast(id as string) AS _cw_key", "cast(id as string) AS _cw_master")
    found = lookup_master(spark.range(10), pairs, "id", "mk", "UNKNOWN")
    assert "broadcast" not in found._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("partitions", [1, 7])
def test_results_do_not_depend_on_partitions(spark, partitions):
    rows = hashed(line_raw(spark, SF), LINE_COLUMNS)

    def kept(df):
        return sorted(map(tuple, first_seen(df).drop("_copies").select(*rows.columns).collect()), key=repr)

    assert kept(rows) == sorted(map(tuple, earliest_copies(rows).collect()), key=repr)
    assert kept(rows.repartition(partitions)) == kept(rows.orderBy(F.desc("_record_hash"), F.desc("_ingested_at")))


def test_staging_uses_the_shared_folder_and_cleans_up(spark, tmp_path):
    import os

    base = spark.conf.get("spark.checkpoint.dir")
    assert staging_folder(spark).startswith(base + "/sediment/")
    with staging(spark):
        df = stage(spark.range(5).withColumn("x", F.lit("y")))
        folder = df.inputFiles()[0].replace("file://", "").rsplit("/", 1)[0]
        assert df.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_sources_with_enough_splits_are_not_shuffled(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, ["id"]) is wide
    assert "Exchange" in plan(spread(spark.range(0, 100, 1, 1), ["id"]))


def test_the_bronze_merge_shuffles_once(spark, db):
    from sediment.operators.merge import mark_new
    from sediment.sources.tables import bucket_count, buckets_for, ensure_table, job_session

    job = job_session(spark, 6)
    job.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = hashed(line_raw(job, SF), LINE_COLUMNS)
    by_hash = {"bucket_by": ["_record_hash"], "buckets": 6}
    target = ensure_table(job, f"{db}.b", earliest_copies(rows).schema, **by_hash)
    seen = ensure_table(job, f"{db}.s", sightings(rows).schema, **by_hash)
    incoming = stage(sightings(rows))
    records = plan(mark_new(earliest_copies(rows), target, ["_record_hash"]))
    loads = plan(mark_new(incoming, seen, ["_record_hash", "_batch_id"], null_safe=["_batch_id"]))
    assert records.count("ENSURE_REQUIREMENTS") == 1, records
    assert loads.count("ENSURE_REQUIREMENTS") == 1, loads
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4", "other jobs do not notice"
    assert spark.conf.get("spark.sql.session.timeZone") == job.conf.get("spark.sql.session.timeZone")
    assert (bucket_count(spark, f"{db}.b"), bucket_count(spark, f"{db}.none")) == (6, None)
    assert buckets_for(spark, f"{db}.b") == 8


@pytest.mark.parametrize("hot", [None, 7])
def test_outer_matches_with_a_hot_key(spark, hot):
    """A third of the target's rows have one key, or none; rows of both sides that match nothing are there once."""
    from sediment.operators.merge import backfill, upsert_changed

    old = [(hot if n % 3 == 0 else n, f"old {n}" if n % 2 else None) for n in range(300)]
    new = [(n, f"new {n}") for n in range(290, 310)] + [(hot, "new")]
    target, source = spark.createDataFrame(old, "k INT, v STRING").repartition(4), spark.createDataFrame(new, "k INT, v STRING").repartition(3)
    keys, values = {k for k, _ in old}, dict(new)
    fresh = [(k, v) for k, v in new if k not in keys]
    filled = backfill(target, source, ["k"], ["v"])
    assert sorted(map(tuple, filled.collect()), key=repr) == sorted([(k, v if v is not None else values.get(k)) for k, v in old] + fresh, key=repr)
    merged = upsert_changed(target, source, ["k"])
    expected = [(k, values.get(k, v), "kept" if k not in values else "update") for k, v in old] + [(k, v, "insert") for k, v in fresh]
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(expected, key=repr)
    for df in (filled, merged):
        assert "FullOuter" not in plan(df) and "LeftAnti" in plan(df)


def test_sightings_of_a_record_stay_together(spark):
    """One shuffle, by the hash alone, serves the sightings and what is asked of them next."""
    rows = hashed(line_raw(spark, SF), LINE_COLUMNS)
    text = plan(last_seen(sightings(rows)))
    assert text.count("Exchange hashpartitioning(_record_hash") == 1 and "ENSURE_REQUIREMENTS" not in text.replace(plan(rows), ""), text
    assert text.index("partial_min(") < text.index("Exchange hashpartitioning(_record_hash"), "tasks that read Raw hold no row for each of its rows"


def test_a_large_source_is_cut_into_small_pieces(spark, tmp_path):
    """Distinct line items sort whole rows before the shuffle, so those tasks get pieces by the size of the files."""
    spark.range(0, 50_000, 1, 1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert spread(table, ["id"], 10_000).rdd.getNumPartitions() == pieces(table, 10_000) > spread(table, ["id"]).rdd.getNumPartitions()


def test_a_merge_of_sightings_shuffles_each_side_once(spark):
    from checks import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["merge_insert_only"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ENSURE_REQUIREMENTS" not in text and "LeftAnti" in text, text
