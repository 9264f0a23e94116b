"""Fingerprints, versions, drift and column rules."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sediment.operators.ordered import number_runs
from sediment.operators.quality import contract_violations
from sediment.operators.registry import (
    columns_json, history, number_versions, register_versions, schema_diff, schema_fingerprint, usage_vs_limit,
)
from sediment.types import sql_type_of

INVENTORY = "id STRING, ordinal INT, name STRING, sql_type STRING, path STRING"


@pytest.fixture(scope="module")
def given(spark):
    """The columns of the given line items as (name, type)."""
    return [(f.name, sql_type_of(f.dataType)) for f in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").schema]


def inventory(spark, **lists):
    rows = [
        (key, i, c[0], c[1], c[2] if len(c) > 2 else None) for key, columns in lists.items() for i, c in enumerate(columns)
    ]
    return spark.createDataFrame(rows, INVENTORY).repartition(3)


def changes(columns):
    """Every list that is one step away from a list of columns, by what was done."""
    out = {}
    for i, (name, kind) in enumerate(columns):
        def put(*instead, i=i):
            return [*columns[:i], *instead, *columns[i + 1 :]]

        out |= {
            f"without {i}": put(), f"named anew {i}": put((name + "_", kind)), f"in capitals {i}": put((name.upper(), kind)),
            f"typed anew {i}": put((name, "BINARY")), f"with a path {i}": put((name, kind, f"G.{name}")),
            f"one more before {i}": put(("more", "INT"), (name, kind)), f"twice {i}": put((name, kind), (name, kind)),
        }
        if i:
            out[f"swapped {i}"] = [*columns[: i - 1], columns[i], columns[i - 1], *columns[i + 1 :]]
    for i, scale in enumerate(("DECIMAL(9,2)", "DECIMAL(9,3)", "DECIMAL(10,2)", "DECIMAL(10,29)", "DECIMAL(1,02)")):
        out[f"scale {i}"] = [*columns, ("last", scale)]
    return out


def test_fingerprint_ignores_spelling_and_sees_every_change(spark, given):
    r = random.Random(1)
    lists = {"given": given} | changes(given)
    for n in range(5):
        lists[f"spelled {n}"] = [(name, "".join(r.choice([c.lower(), c.upper(), " " + c, c + "\t"]) for c in kind)) for name, kind in given]
    found = {row["id"]: row["schema_hash"] for row in schema_fingerprint(inventory(spark, **lists), ["id"]).collect()}
    assert {found[k] for k in found if k.startswith("spelled")} == {found["given"]}
    assert len(set(found.values())) == len(lists) - 5


def test_column_list_json_of_any_length(spark, given):
    (row,) = columns_json(inventory(spark, t=given), ["id"]).collect()
    assert json.loads(row["columns"]) == [{"name": name, "sql_type": kind} for name, kind in given]
    wide = spark.range(5001).select(
        F.lit("t").alias("id"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("c"), "id").alias("name"),
        F.lit("INT").alias("sql_type"), F.lit(None).cast("string").alias("path"),
    )
    (row,) = columns_json(wide, ["id"]).collect()
    assert row["columns"].count('"sql_type":"INT"') == 5001 and row["columns"].endswith('{"name":"c5000","sql_type":"INT"}]')


OBSERVED = "source STRING, definition_path STRING, schema_hash STRING, observed_at TIMESTAMP, observation_id BIGINT"
T0 = datetime(2026, 1, 1)


def observations(spark, *rows):
    return spark.createDataFrame(
        [(s, "", h, T0 + timedelta(hours=n), n) for n, (s, h) in enumerate(rows)], OBSERVED
    )


def shown(versions):
    return sorted(
        (r["source"], r["version"], r["schema_hash"], r["record_is_active"], r["record_end_ts"]) for r in versions.collect()
    )


IDENTITY = ["source", "definition_path"]


def test_versions_open_verify_close_and_revert(spark):
    seen = observations(spark, ("a", "x"), ("a", "x"), ("b", "q"), ("a", "y"), ("a", "x"))
    versions = register_versions(seen, IDENTITY)
    assert shown(versions) == [
        ("a", 1, "x", False, T0 + timedelta(hours=3)), ("a", 2, "y", False, T0 + timedelta(hours=4)),
        ("a", 3, "x", True, None), ("b", 1, "q", True, None),
    ]
    verified = {(r["source"], r["version"]): r["last_verified_at"] for r in versions.collect()}
    assert verified[("a", 1)] == T0 + timedelta(hours=1)
    status = {r["observation_id"]: r["_status"] for r in number_versions(seen, IDENTITY).collect()}
    assert [status[i] for i in range(5)] == ["created", "unchanged", "created", "drifted", "drifted"]
    newest = [r["version"] for r in history(versions, {"source": "a", "definition_path": None}).collect()]
    assert newest == [3, 2, 1]


def test_versions_continue_from_the_current_table(spark):
    everything = [("a", "x"), ("a", "y"), ("b", "q"), ("a", "y"), ("c", "z"), ("a", "x"), ("b", "q")]
    whole = observations(spark, *everything)
    cut = T0 + timedelta(hours=3)
    current = register_versions(whole.where(F.col("observed_at") < F.lit(cut)), IDENTITY)
    stepwise = register_versions(whole.where(F.col("observed_at") >= F.lit(cut)), IDENTITY, current)
    at_once = register_versions(whole, IDENTITY)
    assert sorted(map(tuple, stepwise.select(*at_once.columns).collect()), key=repr) == sorted(
        map(tuple, at_once.collect()), key=repr
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_a_busy_key_cross_the_pieces_rightly(spark, seed):
    rng = random.Random(seed)
    rows = [("busy" if rng.random() < 0.7 else f"k{rng.randrange(30)}", n, rng.choice("ab")) for n in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, n INT, v STRING").repartition(5)
    found = {(r["k"], r["n"]): (r["_run"], r["_first_of_run"]) for r in number_runs(df, ["k"], ["n"], "v").collect()}
    last, run = {}, {}
    for k, n, v in rows:
        opens = last.get(k) != v
        run[k] = run.get(k, 0) + opens
        last[k] = v
        assert found[(k, n)] == (run[k], opens)


def test_a_busy_key_is_cut_into_pieces(spark):
    from sediment.staging import stage

    df = spark.range(4000).select(F.lit("busy").alias("k"), F.col("id").alias("n"), (F.col("id") % 2).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = stage(df.repartitionByRange("k", "n").withColumn("_chunk", F.spark_partition_id()))
        sizes = [r["count"] for r in pieces.groupBy("_chunk").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 4000 / 2


def test_diff_names_every_kind_of_change(spark):
    old = inventory(spark, t=[("a", "INT"), ("b", "STRING"), ("c", "decimal(9, 2)"), ("d", "INT"), ("e", "INT", "G.E")])
    new = inventory(spark, t=[("a", "int"), ("c", "DECIMAL(9,2)"), ("d", "BIGINT"), ("f", "INT"), ("e", "INT", "H.E")])
    found = {r["name"]: r["change"] for r in schema_diff(old, new, ["id"]).collect()}
    assert found == {"b": "removed", "c": "moved", "d": "retyped", "e": "moved", "f": "added"}


def test_all_column_problems_are_listed(spark):
    rows = [
        (1, "ok", "INT", None), (2, "OK", "int", None), (3, "1bad", "what", None), (4, "_BATCH_ID", "STRING", None),
        (5, "money", "DECIMAL(9,2)", ["A", "B"]), (6, "1bad", "INT", None),
    ]
    ddl = "ordinal INT, name STRING, sql_type STRING, path ARRAY<STRING>"
    df = spark.createDataFrame(rows, ddl)
    for source_type, money in (("csv", ["decimal_outside_cobol", "path_outside_cobol"]), ("cobol", [])):
        listed = contract_violations(df.withColumns({"t": F.lit("t"), "source_type": F.lit(source_type)}), ["t"])
        found = {r["ordinal"]: r["problems"] for r in listed.collect()}
        assert found == {
            1: [], 2: ["name_duplicate"], 3: ["name_not_identifier", "type_unsupported"], 4: ["name_reserved"], 5: money,
            6: ["name_not_identifier"],
        }


def test_usage_counts_owners_without_items(spark):
    owners = spark.createDataFrame([(1, "free"), (2, "pro")], "owner_id INT, tier STRING")
    tiers = spark.createDataFrame([("free", 1), ("pro", 5)], "tier STRING, item_limit INT")
    items = spark.createDataFrame([(1,)], "owner_id INT")
    found = {r["owner_id"]: (r["item_count"], r["can_add"]) for r in usage_vs_limit(owners, items, tiers).collect()}
    assert found == {1: (1, False), 2: (0, True)}
