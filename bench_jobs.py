"""Time the Bronze job against the same job done step by step, and the Silver job.

The plain job counts, picks and merges in separate actions, as one would write it at first: row and
distinct counts, a window for the first copy, counts of the tables before and after each insert.  Both
start from the same Raw table of line items loaded three times.  The Silver job runs over customers: all new,
nothing new, and one key in a hundred changed.  Prints one JSON line for each.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.loads import CUSTOMER, CUSTOMER_COLUMNS, LINE_COLUMNS, customer_raw, line_raw
from checks.session import local_session
from sediment.operators.bronze import hashed
from sediment.plans.bronze import build_bronze
from sediment.plans.silver import build_entities
from sediment.plans.spec import SilverSpec


def plain_bronze(spark, raw: str, bronze: str, columns: list[str]) -> dict:
    rows = hashed(spark.table(raw), columns)
    kept = [*columns, "_record_hash", "_ingested_at", "_source_file", "_batch_id"]
    for name, names in ((bronze, kept), (f"{bronze}_sightings", ["_record_hash", "_batch_id", "_ingested_at"])):
        if not spark.catalog.tableExists(name):
            rows.select(*names).limit(0).write.saveAsTable(name)
    stats = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_record_hash").alias("records")).first()
    order = Window.partitionBy("_record_hash").orderBy("_ingested_at", "_batch_id", "_source_file")
    first = rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").select(*kept)
    before = spark.table(bronze).count()
    first.join(spark.table(bronze).select("_record_hash"), "_record_hash", "left_anti").select(*kept).write.insertInto(bronze)
    after = spark.table(bronze).count()
    sightings = f"{bronze}_sightings"
    seen_before = spark.table(sightings).count()
    seen = rows.groupBy("_record_hash", "_batch_id").agg(F.min("_ingested_at").alias("_ingested_at"))
    held = spark.table(sightings).select("_record_hash", "_batch_id")
    seen.join(held, ["_record_hash", "_batch_id"], "left_anti").write.insertInto(sightings)
    return {
        "rows_read": stats["rows"], "distinct_records": stats["records"], "rows_inserted": after - before,
        "sightings_inserted": spark.table(sightings).count() - seen_before,
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sql("CREATE DATABASE b")
    line_raw(spark, sf_dir).write.partitionBy("_batch_id").saveAsTable("b.raw")
    result = {}
    for name, job in (
        ("plain", lambda t: plain_bronze(spark, "b.raw", t, LINE_COLUMNS)),
        ("job", lambda t: build_bronze(spark, "b.raw", t, LINE_COLUMNS, buckets=8)),
        ("job, last load only", lambda t: build_bronze(spark, "b.raw", t, LINE_COLUMNS, batch_ids=["L3"], buckets=8)),
    ):
        job("b.warm_up")
        spark.sql("DROP TABLE b.warm_up")
        spark.sql("DROP TABLE b.warm_up_sightings")
        target = "b." + name.split(",")[0].replace(" ", "_")
        counts = {}
        for run in ("first run", "second run"):
            start = time.perf_counter()
            counts = job(target)
            result[f"{name}, {run}"] = round(time.perf_counter() - start, 2)
        assert counts["rows_inserted"] == 0 and counts["sightings_inserted"] == 0
    print(json.dumps({"metric": "Bronze job", "unit": "sec", "runs": result}))
    print(json.dumps({"metric": "Silver job", "unit": "sec", "runs": silver_runs(spark, sf_dir)}))


def silver_runs(spark, sf_dir: str) -> dict:
    entity = replace(CUSTOMER, target="b.customer", master_key=None)
    spec = SilverSpec("b.customer_bronze", "b.customer_bronze_sightings", "BANK", (entity,))
    rows, result = customer_raw(spark, sf_dir).where("_batch_id = 'L1'"), {}
    changed = rows.where("custkey % 100 = 7").withColumns({"segment": F.lit("NEW"), "_batch_id": F.lit("L2"), "_ingested_at": F.expr("_ingested_at + interval 9 days")})
    for name, load in (("all new", rows), ("nothing new", rows.limit(0)), ("one in a hundred changed", changed)):
        load.write.mode("append").partitionBy("_batch_id").saveAsTable("b.customer_raw")
        build_bronze(spark, "b.customer_raw", "b.customer_bronze", CUSTOMER_COLUMNS, buckets=8)
        start = time.perf_counter()
        counts = build_entities(spark, spec, buckets=8)["tables"]["customer"]
        result[name] = {"sec": round(time.perf_counter() - start, 2), **{k: counts[k] for k in ("rows_inserted", "rows_updated", "rows_in_target")}}
    return result


if __name__ == "__main__":
    main()
