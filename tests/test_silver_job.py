"""Silver entities over loads of the given parts: quarantine, master keys, and what a merge writes."""

import json
import random
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.jobs import PART, PART_COLUMNS, part_raw
from sediment.functions.steps import Trim, Upper
from sediment.operators.masterkey import AmbiguousMasterKeys
from sediment.plans.bronze import build_bronze
from sediment.plans.silver import build_entities
from sediment.plans.spec import Attribute, Entity, SilverSpec, SpecError
from sediment.sources.tables import bucket_of, replace_partitions, row_count, table_version

SF = "/root/testdata/sf0.001"
FIELDS = ["part_no", "label", "size", "maker", "price"]


class Plant:
    """The tables of one job, and beside them a plain account of what they have to hold."""

    def __init__(self, spark, db):
        self.spark, self.db = spark, db
        self.latest, self.good, self.records, self.codes = {}, {}, {}, {}
        maker = Entity("maker", f"{db}.maker", ("maker",), (Attribute("maker", "maker", (Trim(), Upper())), Attribute("price", "price")))
        part = replace(PART, target=f"{db}.part", master_key=replace(PART.master_key, crosswalk=f"{db}.catalog"))
        self.spec = SilverSpec(f"{db}.bronze", f"{db}.bronze_sightings", "SHOP", (part, maker))
        self.map()

    def map(self, **codes):
        """Add codes of parts to the catalog, with some of another shop."""
        self.codes |= {int(k[1:]): v for k, v in codes.items()}
        rows = [("SHOP", k[1:], v) for k, v in codes.items()] + [("ELSEWHERE", k[1:], "no " + v) for k, v in codes.items()]
        self.spark.createDataFrame(rows, "shop STRING, number STRING, catalog_no STRING").write.mode("append").saveAsTable(f"{self.db}.catalog")

    def load(self, df):
        df.write.mode("append").saveAsTable(f"{self.db}.raw")
        build_bronze(self.spark, f"{self.db}.raw", f"{self.db}.bronze", PART_COLUMNS, buckets=2)
        for r in sorted(df.collect(), key=lambda r: r["_ingested_at"]):
            self.records[tuple(r[c] for c in PART_COLUMNS)] = self.reasons(r)
            if r["part_no"] is not None:
                self.latest[r["part_no"]] = r

    @staticmethod
    def reasons(r):
        found = []
        if r["part_no"] is None:
            found.append("part_no: required value is empty")
        if not (r["label"] or "").strip():
            found.append("label: required value is empty")
        if not r["size_text"].lstrip("-").isdigit():
            found.append("size: value could not be converted")
        return found

    def run(self, spec=None):
        report = build_entities(self.spark, spec or self.spec, buckets=2)
        for key, r in self.latest.items():
            if not self.reasons(r):
                self.good[key] = (key, r["label"].strip().upper(), int(r["size_text"]), r["maker"].lower(), r["price"])
        return report["tables"]["part"]

    def table(self, name):
        return self.spark.table(f"{self.db}.{name}")

    def check(self):
        held = {tuple(r[c] for c in FIELDS): (r["catalog_no"], r["_master_key_resolved"]) for r in self.table("part").collect()}
        assert held == {row: (self.codes.get(key, "UNKNOWN"), key in self.codes) for key, row in self.good.items()}


@pytest.fixture
def plant(spark, db):
    return Plant(spark, db)


def counts(report):
    return tuple(report[k] for k in ("rows_inserted", "rows_updated", "unchanged", "rows_in_target"))


def test_three_loads_of_parts(plant, spark):
    loads = part_raw(spark, SF)
    numbers = [r["part_no"] for r in loads.select("part_no").distinct().collect() if r["part_no"]]
    plant.map(**{f"p{n}": f"C{n}" for n in numbers if n % 5})
    before = {}
    for batch in ("L1", "L2", "L3"):
        plant.load(loads.where(F.col("_batch_id") == batch))
        report = plant.run()
        plant.check()
        new = [k for k in plant.good if k not in before]
        changed = [k for k, row in plant.good.items() if before.get(k, row) != row]
        assert report["reconciled"] and counts(report)[:2] == (len(new), len(changed)) and report["rows_in_target"] == len(plant.good)
        assert report["distinct_keys"] == len(plant.latest)
        assert report["quarantined_keys"] == sum(bool(plant.reasons(r)) for r in plant.latest.values())
        assert report["null_key_records"] == sum(record[0] is None for record in plant.records)
        assert report["unmapped_keys"] == sum(k % 5 == 0 and not plant.reasons(r) for k, r in plant.latest.items())
        before = dict(plant.good)
    quarantine = plant.table("part_quarantine")
    assert quarantine.count() == quarantine.select("_record_hash").distinct().count() > 0
    for r in quarantine.collect():
        record = json.loads(r["_record"])
        key = tuple(Decimal(str(record[c])) if c == "price" else record.get(c) for c in PART_COLUMNS)
        assert json.loads(r["_reasons"]) == plant.records[key] != []


def one_load(spark, n, *rows):
    """Rows (part_no, label, size_text, maker, price) as load n."""
    values = [(*r[:4], Decimal(r[4]), f"2026-05-{n:02d} 00:00:00", "hand.csv", f"L{n}") for r in rows]
    ddl = "part_no BIGINT, label STRING, size_text STRING, maker STRING, price DECIMAL(15,2), at STRING, _source_file STRING, _batch_id STRING"
    df = spark.createDataFrame(values, ddl)
    return df.select(*PART_COLUMNS, F.col("at").cast("timestamp").alias("_ingested_at"), "_source_file", "_batch_id")


def written(spark, name):
    """The files of each bucket of a table."""
    found = spark.table(name).select("_bucket", "_metadata.file_path", "_metadata.file_modification_time").distinct().collect()
    return {b: {tuple(r[1:]) for r in found if r[0] == b} for b in {r[0] for r in found}}


def test_what_a_run_writes(plant, spark):
    name = f"{plant.db}.part"
    plant.map(p1="C1")
    plant.load(one_load(spark, 1, (1, "bolt", "4", "Acme", "2.50"), (2, "nut", "4", "Acme", "1.00")))
    assert counts(plant.run()) == (2, 0, 0, 2)
    version, files = table_version(spark, name), written(spark, name)
    assert counts(plant.run()) == (0, 0, 2, 2) and (table_version(spark, name), written(spark, name)) == (version, files), "nothing changed, nothing is written"
    plant.load(one_load(spark, 2, (3, "ring", "9", "Acme", "0.10")))
    assert counts(plant.run()) == (1, 0, 2, 3) and table_version(spark, name) == version + 1
    after = written(spark, name)
    assert all(files[b] <= after[b] for b in files), "new keys are appended"
    plant.load(one_load(spark, 3, (2, "", "4", "Acme", "1.00"), (1, "bolt", "5", "Acme", "2.50")))
    report = plant.run()
    assert counts(report) == (0, 1, 1, 3) and report["quarantined_keys"] == 1
    plant.check()  # the nut keeps its last good row
    assert table_version(spark, name) == version + 2
    plant.map(p3="C3")
    assert counts(plant.run()) == (0, 1, 1, 3), "a code that appears is a change"
    plant.check()
    assert counts(plant.run())[:2] == (0, 0)


def test_one_changed_row_writes_one_bucket(plant, spark):
    rows = [(n, f"part {n}", "1", f"Maker {n}", f"{n}.00") for n in range(1, 400)]
    plant.load(one_load(spark, 1, *rows))
    build_entities(spark, plant.spec, buckets=16)
    plant.run()
    before = written(spark, f"{plant.db}.part")
    assert len(before) == 16 and all(len(f) == 1 for f in before.values())
    plant.load(one_load(spark, 2, (77, "part 77", "2", "Maker 77", "77.00"), (1000, "new", "1", "Maker", "1.00")))
    assert counts(plant.run()) == (1, 1, 398, 400)
    plant.check()
    after = written(spark, f"{plant.db}.part")
    (bucket,) = spark.range(77, 78).select(bucket_of(["id"], 16)).first()
    (other,) = spark.range(1000, 1001).select(bucket_of(["id"], 16)).first()
    replaced = {b for b in before if not before[b] <= after[b]}
    assert replaced == {bucket} and len(after[other]) == (1 if other == bucket else 2)
    assert all(after[b] == before[b] for b in before if b not in (bucket, other))


def test_buckets_are_those_that_spark_makes(plant, spark):
    """So a bucket's partition is one file, and a join by the key shuffles nothing."""
    plant.load(one_load(spark, 1, *[(n, "x", "1", "m", "1.00") for n in range(1, 200)]))
    build_entities(spark, plant.spec, buckets=8)
    table = plant.table("part")
    assert all(f"_{b:05}.c000" in next(iter(f))[0] for b, f in written(spark, f"{plant.db}.part").items())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table.join(table.select("part_no", F.col("size").alias("other")), "part_no")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan, plan


def test_a_run_that_fails_leaves_the_old_rows(plant, spark, monkeypatch):
    import sediment.plans.silver as job

    plant.load(one_load(spark, 1, *[(n, "x", "1", "m", "1.00") for n in range(1, 50)]))
    plant.run()
    held = sorted(map(tuple, plant.table("part").collect()))
    plant.load(one_load(spark, 2, *[(n, "x", "2", "m", "1.00") for n in range(1, 50)]))
    broken = lambda df, name: replace_partitions(df.where(F.when(F.col("part_no") < 40, True).otherwise(F.raise_error(F.lit("lost")).cast("boolean"))), name)
    monkeypatch.setattr(job, "replace_partitions", broken)
    with pytest.raises(Exception, match="lost"):
        build_entities(spark, plant.spec, buckets=2)
    spark.catalog.refreshTable(f"{plant.db}.part")
    assert sorted(map(tuple, plant.table("part").collect())) == held
    monkeypatch.undo()
    assert counts(plant.run()) == (0, 49, 0, 49)
    plant.check()


def test_rows_that_came_from_elsewhere_are_reported(plant, spark):
    plant.load(one_load(spark, 1, (1, "bolt", "4", "Acme", "2.50")))
    assert plant.run()["reconciled"]
    plant.table("part").withColumn("part_no", F.lit(9).cast("long")).write.insertInto(f"{plant.db}.part")
    spark.catalog.refreshTable(f"{plant.db}.part")
    report = plant.run()
    assert not report["reconciled"] and report["rows_in_target"] == row_count(spark, f"{plant.db}.part") == 2


def test_an_overwrite_needs_a_session_of_a_job(plant, spark):
    plant.load(one_load(spark, 1, (1, "bolt", "4", "Acme", "2.50")))
    plant.run()
    with pytest.raises(RuntimeError, match="dynamic"):
        replace_partitions(plant.table("part"), f"{plant.db}.part")


def test_a_version_that_comes_back(plant, spark):
    row, other = (1, "bolt", "4", "Acme", "2.50"), (1, "bolt", "4", "Acme", "3.00")
    for n, r in enumerate((row, other, row), 1):
        plant.load(one_load(spark, n, r))
        plant.run()
        plant.check()
    assert plant.table("bronze").count() == 2 and plant.table("part").first()["price"] == Decimal("2.50")


def test_disagreeing_versions_of_one_load(plant, spark):
    rows = [(n, f"part {n}", "1", "Acme" if n % 2 else "Borg", f"{n}.00") for n in range(1, 9)]
    plant.load(one_load(spark, 1, *rows))
    plant.run()
    held = {r["maker"]: r["price"] for r in plant.table("maker").collect()}
    assert set(held) == {"ACME", "BORG"}
    assert build_entities(spark, plant.spec, buckets=2)["tables"]["maker"]["conflicting_keys"] == 2
    random.Random(1).shuffle(rows)
    assert {r["maker"]: r["price"] for r in plant.table("maker").collect()} == held


def test_codes_must_be_unambiguous(plant, spark):
    plant.load(one_load(spark, 1, (1, "bolt", "4", "Acme", "2.50")))
    plant.map(p1="C1")
    plant.run()
    plant.map(p1="C1")  # the same again is fine
    plant.run()
    plant.check()
    spark.createDataFrame([("SHOP", "1", "C9")], "shop STRING, number STRING, catalog_no STRING").write.mode("append").saveAsTable(f"{plant.db}.catalog")
    with pytest.raises(AmbiguousMasterKeys, match="more than one master key") as stopped:
        plant.run()
    assert (stopped.value.keys, stopped.value.sample) == (1, ["1"])
    plant.check()


def test_a_lost_column_stops_the_job(plant, spark):
    plant.load(one_load(spark, 1, (1, "bolt", "4", "Acme", "2.50")))
    part = plant.spec.entities[0]
    broken = replace(part, attributes=(*part.attributes, Attribute("weight", "weight")))
    with pytest.raises(SpecError, match="weight"):
        plant.run(replace(plant.spec, entities=(broken,)))
    assert not spark.catalog.tableExists(f"{plant.db}.part")
