"""From files of each format to Silver, and identity over random records."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sediment.operators.bronze import distinct_stats, first_seen, hashed
from sediment.operators.projections import project_attributes
from sediment.plans.bronze import build_bronze
from sediment.plans.raw import load_raw
from sediment.plans.silver import build_entities
from sediment.plans.spec import Attribute, silver_from_dict
from sediment.functions.steps import Cast, NullIf, Trim
from sediment.sources.files import LoadSpec, folder_specs, scan_folder
from sediment.sources.profile import profile_csv, profile_json, profile_schema, profile_xml
from sediment.types import schema_of

PEOPLE = [(1, "Ada ", "2024-03-14", 10.5), (2, "Bob", "2024-13-01", 3.0), (2, "Bob", "2024-13-01", 3.0)]


def write(folder, kind):
    path = folder / f"people.{kind}"
    if kind == "csv":
        path.write_text("id,name,signup,value\n" + "".join(f"{i},{n},{s},{v}\n" for i, n, s, v in PEOPLE))
    elif kind == "json":
        path.write_text(
            "".join(json.dumps({"id": i, "who": {"name": n, "signup": s}, "value": v}) + "\n" for i, n, s, v in PEOPLE)
        )
    else:
        rows = "".join(
            f"<record><id>{i}</id><name>{n}</name><signup>{s}</signup><value>{v}</value></record>" for i, n, s, v in PEOPLE
        )
        path.write_text(f"<people>{rows}</people>")
    return str(path)


@pytest.mark.parametrize("kind", ["csv", "json", "xml"])
def test_from_file_to_silver(spark, db, tmp_path, kind):
    path = write(tmp_path, kind)
    profile = {"csv": profile_csv, "json": profile_json, "xml": profile_xml}[kind](spark, path)
    schema = profile_schema(profile)
    prefix = "who_" if kind == "json" else ""
    report = load_raw(
        spark, LoadSpec(path, kind, schema), f"{db}.raw", batch_id="L1", at=datetime(2026, 1, 1, tzinfo=timezone.utc)
    )
    assert (report["rows_written"], report["rows_malformed"], report["reconciled"]) == (3, 0, True)
    assert spark.table(f"{db}.raw").first()["_source_file"].endswith(f"/people.{kind}")
    columns = schema.names
    assert build_bronze(spark, f"{db}.raw", f"{db}.b", columns, buckets=2)["distinct_records"] == 2
    spec = silver_from_dict({
        "source": {"bronze": f"{db}.b", "system": "CRM"},
        "entities": [{
            "name": "person", "target": f"{db}.person", "business_key": ["id"],
            "attributes": [
                {"name": "id"},
                {"name": "name", "from": f"{prefix}name", "steps": [{"kind": "trim"}, {"kind": "upper"}]},
                {"name": "signup", "from": f"{prefix}signup", "steps": [{"kind": "parse_date", "format": "yyyy-MM-dd"}]},
                {"name": "value", "steps": [{"kind": "cast", "type": "decimal(9,2)"}]},
            ],
        }],
    })
    person = build_entities(spark, spec, buckets=2)["tables"]["person"]
    assert (person["rows_inserted"], person["quarantined_keys"], person["reconciled"]) == (1, 1, True)
    (row,) = spark.table(f"{db}.person").collect()
    assert (row["id"], row["name"], str(row["signup"]), str(row["value"])) == (1, "ADA", "2024-03-14", "10.50")


def test_folder_in_one_scan(spark, tmp_path):
    for name in ("Jan 24.csv", "feb.csv", "50% a+b.csv"):
        (tmp_path / name).write_text("a\n1\n2\n")
    rows = scan_folder(spark, str(tmp_path), "csv", schema_of({"a": "INT"}))
    assert {(r["_table"], r["count"]) for r in rows.groupBy("_table").count().collect()} == {
        ("jan_24", 2), ("feb", 2), ("t_50__a_b", 2)}


def test_a_folder_of_many_files(spark, tmp_path):
    for n in range(250):
        (tmp_path / f"f{n}.csv").write_text("a\n1\n")
    schema = schema_of({"a": "INT"})
    specs = folder_specs(spark, str(tmp_path), "csv", {f"f{n}.csv": schema for n in range(250)})
    assert sorted(specs) == sorted(f"f{n}" for n in range(250)) and specs["f7"].path.endswith("/f7.csv")
    assert scan_folder(spark, str(tmp_path), "csv", schema).count() == 250


@pytest.mark.parametrize("seed", range(3))
def test_identity_is_equality_of_all_values(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", "a", "ab", "b", "|", "V1:a", "N", "a|V1:b", "1", " ", "é", "\u0000", "😀"]
    numbers = [None, 0, 1, -1, 10, 2**40]
    rows = [
        (rng.choice(texts), rng.choice(texts), rng.choice(numbers), rng.choice([None, True, False])) for _ in range(2000)
    ]
    df = spark.createDataFrame(rows, "a STRING, b STRING, c BIGINT, d BOOLEAN").repartition(5).withColumns(
        {"_ingested_at": F.current_timestamp(), "_source_file": F.lit("f"), "_batch_id": F.lit("b")}
    )
    identified = hashed(df, ["a", "b", "c", "d"])
    assert tuple(distinct_stats(identified).first()) == (2000, len(set(rows)))
    kept = {(r["a"], r["b"], r["c"], r["d"]) for r in first_seen(identified).collect()}
    assert kept == set(rows)


def test_reasons_in_order_of_attributes(spark):
    df = spark.createDataFrame([("x", " ", None), ("1", "n", "k")], "n STRING, name STRING, k STRING")
    attributes = [
        Attribute("number", "n", (Cast("INT"),), True, "INT"),
        Attribute("name", "name", (Trim(), NullIf(("",))), True, "STRING"),
        Attribute("k", "k", (), False, "STRING"),
    ]
    rows = [r["_reasons"] for r in project_attributes(df, attributes).collect()]
    assert rows == [
        ["number: value could not be converted", "number: required value is empty", "name: required value is empty"], [],
    ]
