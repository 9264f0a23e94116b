"""Run states, synchronisation and untrusted reports."""

import itertools
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sediment.functions.runs import run_status
from sediment.operators.runs import COUNTS, MAX_COUNT, apply_run_counts, latest_per_group, remote_runs, sanitize_reports, sync_runs

#: What a scheduler says of a run, by what it means here.
WAITING, GOING = {"BLOCKED", "PENDING", "QUEUED", "WAITING_FOR_RETRY"}, {"RUNNING", "TERMINATING"}
ENDED = {"success": {"SUCCESS"}, "cancelled": {"CANCELED", "DISABLED", "EXCLUDED"}, "failed": {"FAILED", "SUCCESS_WITH_FAILURES", "TIMEDOUT", "UPSTREAM_FAILED"}}
UNKNOWN = {None, "", "success", "NEVER_HEARD_OF"}


def meaning(life, result):
    if life in WAITING:
        return "pending"
    if life == "TERMINATED":
        return next((status for status, results in ENDED.items() if result in results), "failed")
    return {"SKIPPED": "cancelled", "INTERNAL_ERROR": "failed"}.get(life, "running")


def test_every_pair_of_states(spark):
    """All that can be said, and words nobody knows: only a success that is said is one."""
    lives, results = WAITING | GOING | UNKNOWN | {"TERMINATED", "SKIPPED", "INTERNAL_ERROR"}, set().union(UNKNOWN, *ENDED.values())
    df = spark.createDataFrame(list(itertools.product(lives, results)), "life STRING, result STRING")
    found = df.select("*", run_status(F.col("life"), F.col("result")).alias("status")).collect()
    assert all(r["status"] == meaning(r["life"], r["result"]) for r in found)
    assert [(r["life"], r["result"]) for r in found if r["status"] == "success"] == [("TERMINATED", "SUCCESS")]


def test_sync_keeps_the_trigger_and_adds_runs(spark):
    ddl = (
        "pipeline_id INT, run_id BIGINT, life_cycle STRING, result STRING, message STRING, trigger STRING, "
        "start_ms BIGINT, end_ms BIGINT, url STRING"
    )
    def listing(*rows):
        return remote_runs(spark.createDataFrame(rows, ddl))

    known = listing((1, 10, "RUNNING", None, "", "ONE_TIME", 5, 9, "u")).withColumn("triggered_by", F.lit("deploy"))
    row = known.first()
    assert (row["status"], row["finished_at"], row["error_message"]) == ("running", None, None)
    remote = listing(
        (1, 10, "TERMINATED", "FAILED", "  " + "e" * 3000, "PERIODIC", 5, 9, "u"),
        (1, 11, "TERMINATED", "SUCCESS", "done", "PERIODIC", 0, 9, "u"),
    )
    found = {r["run_id"]: r for r in sync_runs(known, remote).collect()}
    assert (found[10]["_action"], found[10]["triggered_by"], found[10]["status"]) == ("update", "deploy", "failed")
    assert found[10]["error_message"] == "e" * 3000 and found[10]["finished_at"] is not None
    assert (found[11]["_action"], found[11]["triggered_by"]) == ("insert", "schedule")
    assert (found[11]["started_at"], found[11]["error_message"]) == (None, None)
    settled = sync_runs(known, remote).drop("_action")
    assert {r["_action"] for r in sync_runs(settled, remote).collect()} == {"unchanged"}


def test_latest_of_uuid_runs(spark):
    rows = [("p", "b" * 8, None, datetime(2026, 1, 2), None), ("p", "a" * 8, None, datetime(2026, 1, 2), None),
            ("p", "c" * 8, 7, None, datetime(2026, 1, 2)), ("q", "d" * 8, None, None, datetime(2026, 1, 1))]
    df = spark.createDataFrame(rows, "pipeline STRING, id STRING, run_id BIGINT, started_at TIMESTAMP, created_at TIMESTAMP")
    assert {r["pipeline"]: r["id"] for r in latest_per_group(df, "pipeline").collect()} == {"p": "c" * 8, "q": "d" * 8}
    without = df.where("run_id IS NULL")
    assert {r["pipeline"]: r["id"] for r in latest_per_group(without, "pipeline").collect()}["p"] == "a" * 8


def sanitized(spark, *reports):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(reports)]
    return sanitize_reports(spark.createDataFrame(rows, "id INT, report STRING")).collect()


#: What a report may say for a count, and what is taken of it.
SAID = [(n, n) for n in (0, 1, 7, MAX_COUNT)] + [
    (x, None) for x in (MAX_COUNT + 1, 10**30, -1, 0.5, 1e3, True, False, "4", "", None, [], [3], {}, {"n": 3})
]


def test_a_count_is_a_whole_number_in_its_range(spark):
    """As many tables as there are values; each count has each of them in one of the tables."""
    tables, expected = {}, {}
    for t in range(len(SAID)):
        said = {name: SAID[(t + i) % len(SAID)] for i, name in enumerate(COUNTS)}
        tables[f"t{t}"] = {name: given for name, (given, _) in said.items()} | {f"other{t}": 5, "ROWS_READ": 9}
        expected[f"t{t}"] = {name: taken for name, (_, taken) in said.items()}
    found = sanitized(spark, {"v": 1, "layer": "silver", "reconciled": True, "tables": tables, "more": tables})
    assert {r["table_name"]: {name: r[name] for name in COUNTS} for r in found} == expected
    assert all(set(r.asDict()) >= set(COUNTS) and "other1" not in r.asDict() for r in found)


@pytest.mark.parametrize("member, kind, default", [("source", str, None), ("target", str, None), ("reconciled", bool, None), ("extra_source_columns", list, None)])
def test_other_members_are_of_their_kind_or_nothing(spark, member, kind, default):
    values = ["text", "", "long " * 2000, 3, 2.5, True, False, None, {"a": 1}, [], ["a", 4, None, "b" * 3000]]
    found = {r["table_name"]: r[member] for r in sanitized(spark, {"v": 1, "layer": "raw", "reconciled": True, "tables": {str(i): {member: v} for i, v in enumerate(values)}})}
    for i, v in enumerate(values):
        taken = [x for x in v if isinstance(x, str)] if kind is list and isinstance(v, list) else v
        assert found[str(i)] == (taken if isinstance(v, kind) else default), v


@pytest.mark.parametrize("claim", [True, False, "yes", 1, None])
@pytest.mark.parametrize("of_table", [True, False, "no", None])
def test_a_run_is_reconciled_if_it_says_so_and_no_table_objects(spark, claim, of_table):
    (row,) = sanitized(spark, {"v": 1, "layer": "raw", "mode": "full", "reconciled": claim, "tables": {"t": {"reconciled": of_table}}})
    assert row["run_reconciled"] is (claim is True and of_table is not False)


def test_what_is_no_report_is_left_out(spark):
    good = {"v": 1, "layer": "raw", "reconciled": True, "tables": {"a": {"reconciled": True}, "b": {}}}
    rows = sanitized(
        spark, good, {**good, "v": 2}, {**good, "layer": "gold"}, {**good, "tables": [1]}, "not json", "[]",
        {**good, "tables": {"a": {"reconciled": False}, "c": 5}}, {**good, "tables": {}}, json.dumps(good) + " " * 200_001,
    )
    assert {(r["id"], r["table_name"], r["run_reconciled"]) for r in rows} == {
        (0, "a", True), (0, "b", True), (6, "a", False), (7, None, True), (8, "a", True), (8, "b", True),
    }


@pytest.mark.parametrize("order", [1, -1])
def test_counts_of_the_latest_run_of_the_right_pipeline(spark, order):
    assets = spark.createDataFrame(
        [(1, "main", "bronze", "c", None, None), (2, "main", "raw", "c", None, None),
         (1, "main", "bronze", "measured", 5, datetime(2026, 1, 9, tzinfo=timezone.utc))],
        "produced_by INT, catalog STRING, schema_name STRING, table_name STRING, row_count BIGINT, last_run_at TIMESTAMP",
    )
    reported = [
        (1, datetime(2026, 1, 2, tzinfo=timezone.utc), "main.bronze.c", 20), (1, datetime(2026, 1, 1, tzinfo=timezone.utc), "main.bronze.c", 10),
        (1, datetime(2026, 1, 3, tzinfo=timezone.utc), "main.raw.c", 99), (1, datetime(2026, 1, 3, tzinfo=timezone.utc), "bronze.c", 98),
        (1, datetime(2026, 1, 8, tzinfo=timezone.utc), "main.bronze.measured", 4), (1, datetime(2026, 1, 4, tzinfo=timezone.utc), "main.bronze.c", None),
    ][::order]
    df = spark.createDataFrame(reported, "producer_id INT, finished_at TIMESTAMP, target STRING, rows_in_target BIGINT")
    found = {(r["schema_name"], r["table_name"]): r["row_count"] for r in apply_run_counts(assets, df, F.current_timestamp()).collect()}
    assert found == {("bronze", "c"): 20, ("raw", "c"): None, ("bronze", "measured"): 5}


def test_tables_of_a_report_are_not_copied_along(spark):
    """What explodes the tables carries none of them beside: else the work grows with the square of their number."""
    df = sanitize_reports(spark.createDataFrame([(1, "{}")], "id INT, report STRING"))
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(_tables#" in x]
    assert len(lines) == 1 and lines[0].count("_tables#") == 1, lines


def test_a_sync_has_tasks_by_the_size_of_its_listing(spark, tmp_path):
    """Long equal texts compress to nothing; the join still keeps the partitions it was given, on both sides."""
    from sediment.operators import runs
    from sediment.operators.gather import pieces

    spark.range(0, 20_000, 1, 2).selectExpr(
        "id % 7 AS pipeline_id", "id AS run_id", "'failed' AS status", "'manual' AS triggered_by", "timestamp_seconds(id) AS started_at",
        "timestamp_seconds(id) AS finished_at", "repeat('x', 300) AS error_message", "sha2(cast(id AS string), 256) AS run_url",
    ).write.parquet(f"{tmp_path}/a b")
    remote = spark.read.parquet(f"{tmp_path}/a b")
    n = pieces(remote, runs.PIECE_BYTES)
    cores = spark.sparkContext.defaultParallelism
    assert pieces(remote, 10) > 1000 > n >= cores == pieces(spark.range(3), 1)
    merged = sync_runs(remote.where("run_id % 2 = 0"), remote)
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and f", {n}), REPARTITION_BY_NUM" in text, text
    assert {(r["_action"], r["count"]) for r in merged.groupBy("_action").count().collect()} == {("insert", 10_000), ("unchanged", 10_000)}
