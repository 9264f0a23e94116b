"""The jobs themselves: what they leave in the tables of the catalog, and what they report."""

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from checks.base import query, table
from checks.loads import LINE_COLUMNS, SQL_LINE, line_raw
from sediment.functions.steps import Cast, Lower, NullIf, Trim, Upper
from sediment.operators.masterkey import AmbiguousMasterKeys
from sediment.plans.bronze import build_bronze
from sediment.plans.raw import load_raw, load_tables
from sediment.plans.report import recorded, run_report
from sediment.plans.silver import build_entities
from sediment.plans.spec import Attribute, Entity, MasterKey, SilverSpec
from sediment.sources.files import LoadSpec, folder_specs
from sediment.sources.profile import profile_folder, profile_schema
from sediment.sources.tables import exists, row_count, table_version
from sediment.staging import stage, staging_folder
from sediment.types import schema_of

BUCKETS = 8
REPORT = "layer STRING, what STRING, n BIGINT"


def _database(spark):
    name = "jobs_" + uuid.uuid4().hex[:12]
    spark.sql(f"CREATE DATABASE {name}")
    return name


def _numbers(spark, layer, counts):
    """Counts of a report as rows."""
    return spark.createDataFrame([(layer, k, int(v)) for k, v in counts.items()], REPORT)


# --- Raw: a file is loaded twice; some of its rows do not fit the schema --------------------------


@query(
    "job_raw",
    """WITH rows AS (SELECT batch, p_partkey, p_name, p_size, p_partkey % 10 = 3 AS odd FROM part, (VALUES ('one'), ('two')) AS b(batch))
    SELECT 'kept' AS layer, batch || ' ' || p_partkey || ' ' || p_name || ' ' || CASE WHEN odd THEN '?' ELSE p_size::VARCHAR END AS what,
        1::BIGINT AS n FROM rows
    UNION ALL SELECT 'malformed', batch || ' ' || p_partkey || ',' || p_name || ',size ' || p_size, 1 FROM rows WHERE odd
    UNION ALL SELECT 'report', k, CASE k WHEN 'rows_read' THEN count(*) WHEN 'rows_written' THEN count(*)
        WHEN 'rows_malformed' THEN count(*) FILTER (p_partkey % 10 = 3) WHEN 'rows_in_target' THEN 2 * count(*) ELSE 1 END
    FROM part, (VALUES ('rows_read'), ('rows_written'), ('rows_malformed'), ('rows_in_target'), ('reconciled')) AS c(k) GROUP BY k""",
)
def job_raw(spark, sf_dir):
    folder, db = staging_folder(spark), _database(spark)
    size = F.concat(F.when(F.col("p_partkey") % 10 == 3, "size ").otherwise(""), F.col("p_size"))
    table(spark, sf_dir, "part").select("p_partkey", "p_name", size.alias("p_size")).write.option("header", True).csv(folder)
    spec = LoadSpec(folder, "csv", schema_of({"p_partkey": "BIGINT", "p_name": "STRING", "p_size": "INT"}))
    for batch in ("one", "two"):
        report = load_raw(spark, spec, f"{db}.part", batch_id=batch)
    kept = spark.table(f"{db}.part").select(
        F.lit("kept").alias("layer"),
        F.concat_ws(" ", "_batch_id", "p_partkey", "p_name", F.coalesce(F.col("p_size").cast("string"), F.lit("?"))).alias("what"),
        F.lit(1).cast("bigint").alias("n"),
    )
    odd = spark.table(f"{db}.part_malformed").select(
        F.lit("malformed").alias("layer"), F.concat_ws(" ", "_batch_id", "_text").alias("what"), F.lit(1).cast("bigint").alias("n")
    )
    names = ("rows_read", "rows_written", "rows_malformed", "rows_in_target", "reconciled")
    return kept.unionByName(odd).unionByName(_numbers(spark, "report", {k: report[k] for k in names}))


# --- a folder of files, two of them alike: profiled, and each loaded into its own table ----------------


def _folder_of(df, folder, by):
    """Rows as CSV files with a header, one for each value of a column and task that writes: `Orders <value> <n>.csv`."""
    spark, parts = df.sparkSession, staging_folder(df.sparkSession)
    df.write.partitionBy(by).option("header", True).csv(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    names = {}
    for at in system.globStatus(path(f"{parts}/{by}=*/part-*")):
        value = at.getPath().getParent().getName().split("=")[1]
        names.setdefault(value, []).append(f"Orders {value} {len(names.get(value, []))}.csv")
        system.rename(at.getPath(), path(f"{folder}/{names[value][-1]}"))
    return names


@query(
    "job_folder",
    """WITH loaded AS (
        SELECT 'orders_' || lower(o_orderstatus) AS name, o_orderkey AS key, CASE o_orderstatus WHEN 'P' THEN o_orderpriority ELSE o_custkey::VARCHAR END AS other
        FROM orders)
    SELECT name AS table_name, 'row' AS what, key || ' ' || other AS value FROM loaded
    UNION ALL SELECT DISTINCT name, 'o_orderkey', 'BIGINT' FROM loaded
    UNION ALL SELECT DISTINCT name, CASE name WHEN 'orders_p' THEN 'o_orderpriority' ELSE 'o_custkey' END,
        CASE name WHEN 'orders_p' THEN 'STRING' ELSE 'BIGINT' END FROM loaded""",
)
def job_folder(spark, sf_dir):
    """Files by status, as many as tasks wrote; each is profiled and loaded into a table of its own."""
    folder, db = staging_folder(spark), _database(spark)
    orders = table(spark, sf_dir, "orders")
    names = _folder_of(orders.where("o_orderstatus <> 'P'").select("o_orderstatus", "o_orderkey", "o_custkey"), folder, "o_orderstatus")
    names |= _folder_of(orders.where("o_orderstatus = 'P'").select("o_orderstatus", "o_orderkey", "o_orderpriority"), folder, "o_orderstatus")
    profile = stage(profile_folder(spark, folder))
    reviewed = {status: profile_schema(profile.where(F.col("file_name") == files[0])) for status, files in names.items()}
    schemas = {f: reviewed[status] for status, files in names.items() for f in files}
    load_tables(spark, folder_specs(spark, folder, "csv", schemas), db, batch_id="one")
    by_status = F.regexp_replace("table_name", "_[0-9]+$", "").alias("table_name")
    found = profile.select(by_status, F.col("name").alias("what"), F.col("sql_type").alias("value")).distinct()
    for status, files in names.items():
        for n in range(len(files)):
            rows = spark.table(f"{db}.orders_{status.lower()}_{n}")
            text = F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns[:2]])
            found = found.unionByName(rows.select(F.lit(f"orders_{status.lower()}").alias("table_name"), F.lit("row").alias("what"), text.alias("value")))
    return found


# --- reports and versions: what runs say is kept once, and every write of a table counts --------------------


@query(
    "job_reports",
    """WITH loads(run_id, layer, table_name, times) AS (VALUES ('first', 'raw', 'raw', 1), ('second', 'raw', 'raw', 2), ('third', 'bronze', 'line', 1))
    SELECT run_id, layer, table_name, true AS reconciled, count(*) AS rows_read, CASE layer WHEN 'raw' THEN count(*) END AS rows_written,
        CASE layer WHEN 'raw' THEN times * count(*) ELSE count(DISTINCT (c_custkey % 100, c_mktsegment)) END AS rows_in_target,
        CASE layer WHEN 'bronze' THEN count(DISTINCT (c_custkey % 100, c_mktsegment)) END AS rows_inserted,
        CASE layer WHEN 'raw' THEN times ELSE 1 END::BIGINT AS version
    FROM customer, loads GROUP BY run_id, layer, table_name, times""",
)
def job_reports(spark, sf_dir):
    """Two loads and a Bronze run of the second; one of the loads is reported twice, as if its job had been repeated."""
    folder, db = staging_folder(spark), _database(spark)
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("no"), F.col("c_mktsegment").alias("segment"))
    rows.write.option("header", True).csv(folder)
    spec, reports = LoadSpec(folder, "csv", schema_of({"no": "INT", "segment": "STRING"})), f"{db}.reports"
    versions = {}
    for run in ("first", "second"):
        done = load_raw(spark, spec, f"{db}.raw", batch_id=run, reports=reports, run_id=run)
        versions[run] = table_version(spark, f"{db}.raw")
    recorded(spark, run_report("raw", "append", {f"{db}.raw": done}), reports, "second", F.current_timestamp())
    build_bronze(spark, f"{db}.raw", f"{db}.line", ["no", "segment"], buckets=BUCKETS, batch_ids=["second"], reports=reports, run_id="third")
    versions["third"] = table_version(spark, f"{db}.line")
    numbers = spark.createDataFrame([*versions.items()], "run_id STRING, version BIGINT")
    return spark.table(reports).join(numbers, "run_id").select(
        "run_id", "layer", F.regexp_replace("table_name", r"^.*\.", "").alias("table_name"), "reconciled", "rows_read", "rows_written", "rows_in_target",
        "rows_inserted", "version",
    )


@query(
    "job_ambiguous_keys",
    """WITH many AS (SELECT p_partkey::VARCHAR AS k FROM part WHERE p_partkey % 7 = 3)
    SELECT 'example' AS what, k AS value FROM (SELECT k FROM many ORDER BY k LIMIT 5)
    UNION ALL SELECT 'keys', count(*)::VARCHAR FROM many
    UNION ALL SELECT 'rows in the entity', '0'""",
)
def job_ambiguous_keys(spark, sf_dir):
    """A crosswalk with two codes for some parts stops the Silver job, which names some of them and writes no row."""
    db = _database(spark)
    codes = table(spark, sf_dir, "part").select(
        F.lit("SHOP").alias("shop"), F.col("p_partkey").cast("string").alias("number"),
        F.explode(F.when(F.col("p_partkey") % 7 == 3, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))).alias("catalog_no"),
    )
    codes.write.saveAsTable(f"{db}.catalog")
    part_raw(spark, sf_dir).write.saveAsTable(f"{db}.raw")
    build_bronze(spark, f"{db}.raw", f"{db}.bronze", PART_COLUMNS, buckets=BUCKETS)
    entity = Entity(PART.name, f"{db}.part", PART.business_key, PART.attributes, MasterKey("catalog_no", f"{db}.catalog", "shop", "number", "catalog_no"))
    try:
        build_entities(spark, SilverSpec(f"{db}.bronze", f"{db}.bronze_sightings", "SHOP", (entity,)), buckets=BUCKETS)
    except AmbiguousMasterKeys as stopped:
        found = [("example", k) for k in stopped.sample] + [("keys", str(stopped.keys))]
    rows = row_count(spark, f"{db}.part") if exists(spark, f"{db}.part") else 0
    return spark.createDataFrame([*found, ("rows in the entity", str(rows))], "what STRING, value STRING")


# --- Bronze: two loads, a run, the third load, a run of that load alone, and a run with nothing new ----

_REPORTED = ("rows_read", "distinct_records", "rows_inserted", "already_in_target", "rows_in_target", "sightings_inserted", "sightings_in_target")


@query(
    "job_bronze",
    f"""WITH {SQL_LINE},
    run(number, low, high, before) AS (VALUES (1, 'L1', 'L2', 'L0'), (2, 'L3', 'L3', 'L2'), (3, 'L1', 'L3', 'L3')),
    part_of AS (SELECT number, h.*, before FROM hashed h JOIN run ON _batch_id BETWEEN low AND high),
    counted AS (
        SELECT number, count(*) AS rows_read, count(DISTINCT _record_hash) AS distinct_records,
            count(DISTINCT _record_hash) FILTER (_record_hash NOT IN (SELECT _record_hash FROM hashed o WHERE o._batch_id <= before)) AS rows_inserted,
            (SELECT count(DISTINCT _record_hash) FROM hashed o WHERE o._batch_id <= high) AS rows_in_target,
            count(DISTINCT _record_hash || _batch_id) FILTER (_batch_id > before) AS sightings_inserted,
            (SELECT count(DISTINCT _record_hash || _batch_id) FROM hashed o WHERE o._batch_id <= high) AS sightings_in_target
        FROM part_of JOIN run USING (number, before) GROUP BY number, before, high
    )
    SELECT 'bronze' AS layer, _record_hash || ' ' || _batch_id AS what, 1::BIGINT AS n FROM bronze
    UNION ALL SELECT 'sighting', _record_hash || ' ' || _batch_id, 1 FROM sightings
    UNION ALL SELECT 'run ' || number, what, n FROM (
        SELECT number, rows_read, distinct_records, rows_inserted, distinct_records - rows_inserted AS already_in_target, rows_in_target,
            sightings_inserted, sightings_in_target, 1::BIGINT AS reconciled FROM counted
    ) UNPIVOT (n FOR what IN (COLUMNS(* EXCLUDE number)))""",
)
def job_bronze(spark, sf_dir):
    db = _database(spark)
    raw, bronze = f"{db}.raw", f"{db}.line"
    loads = line_raw(spark, sf_dir)
    loads.where("_batch_id <= 'L2'").write.partitionBy("_batch_id").saveAsTable(raw)
    runs = [build_bronze(spark, raw, bronze, LINE_COLUMNS, buckets=BUCKETS)]
    loads.where("_batch_id = 'L3'").write.partitionBy("_batch_id").mode("append").saveAsTable(raw)
    runs.append(build_bronze(spark, raw, bronze, LINE_COLUMNS, buckets=BUCKETS, batch_ids=["L3"]))
    runs.append(build_bronze(spark, raw, bronze, LINE_COLUMNS, buckets=BUCKETS))

    def listed(name, layer):
        return spark.table(name).select(
            F.lit(layer).alias("layer"), F.concat_ws(" ", "_record_hash", "_batch_id").alias("what"), F.lit(1).cast("bigint").alias("n")
        )

    found = listed(bronze, "bronze").unionByName(listed(f"{bronze}_sightings", "sighting"))
    for number, report in enumerate(runs, 1):
        found = found.unionByName(_numbers(spark, f"run {number}", {k: report[k] for k in (*_REPORTED, "reconciled")}))
    return found


# --- Silver: parts with sizes that are none, labels that go missing and master keys; a run after the first and the third load ---

PART_COLUMNS = ["part_no", "label", "size_text", "maker", "price"]
PART = Entity(
    "part", "part", ("part_no",),
    (
        Attribute("part_no", "part_no"),
        Attribute("label", "label", (Trim(), NullIf(("",)), Upper()), required=True),
        Attribute("size", "size_text", (Cast("INT"),)),
        Attribute("maker", "maker", (Lower(),)),
        Attribute("price", "price"),
    ),
    MasterKey("catalog_no", "catalog", "shop", "number", "catalog_no"),
)


def part_raw(spark, sf_dir):
    """Three loads of parts; the third holds a quarter of them."""
    key, n = F.col("p_partkey"), F.col("n")
    rows = table(spark, sf_dir, "part").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where((n < 3) | (key % 4 == 0))
    start = F.lit(datetime(2026, 5, 1, tzinfo=timezone.utc)).cast("timestamp")
    return rows.select(
        F.when(key % 23 != 0, key).alias("part_no"),
        F.when((n != 2) & (key % 19 == 0), "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("label"),
        F.concat(F.when((n < 3) & (key % 13 == 0), "about ").otherwise(""), F.col("p_size") + F.when((n == 2) & (key % 6 == 0), 1).otherwise(0)).alias("size_text"),
        F.col("p_brand").alias("maker"),
        F.col("p_retailprice").cast("decimal(15,2)").alias("price"),
        (start + F.make_dt_interval(n)).alias("_ingested_at"),
        F.lit("parts.csv").alias("_source_file"),
        F.concat(F.lit("L"), n).alias("_batch_id"),
    )


SQL_PARTS = """
loads AS (
    SELECT n, CASE WHEN p_partkey % 23 <> 0 THEN p_partkey END AS part_no,
        CASE WHEN n <> 2 AND p_partkey % 19 = 0 THEN '  ' ELSE ' ' || p_name END AS label,
        CASE WHEN n < 3 AND p_partkey % 13 = 0 THEN 'about ' ELSE '' END || (p_size + CASE WHEN n = 2 AND p_partkey % 6 = 0 THEN 1 ELSE 0 END) AS size_text,
        p_brand AS maker, p_retailprice::DECIMAL(15,2) AS price
    FROM part, (VALUES (1), (2), (3)) AS l(n) WHERE n < 3 OR p_partkey % 4 = 0
),
seen AS (
    SELECT run, part_no, label, size_text, maker, price, max(n) AS last
    FROM loads JOIN (VALUES (1), (3)) AS r(run) ON n <= run GROUP BY ALL
),
judged AS (
    SELECT *, upper(nullif(trim(label), '')) AS name, try_cast(size_text AS INT) AS size,
        '[' || concat_ws(',', CASE WHEN part_no IS NULL THEN '"part_no: required value is empty"' END,
            CASE WHEN trim(label) = '' THEN '"label: required value is empty"' END,
            CASE WHEN try_cast(size_text AS INT) IS NULL THEN '"size: value could not be converted"' END) || ']' AS reasons
    FROM seen
),
current AS (SELECT * FROM judged WHERE part_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run, part_no ORDER BY last DESC) = 1),
good AS (SELECT * FROM current WHERE reasons = '[]'),
silver AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY part_no ORDER BY run DESC) = 1),
rejected AS (
    SELECT DISTINCT part_no, label, size_text, maker, price, reasons FROM (
        SELECT * FROM current WHERE reasons <> '[]' UNION ALL BY NAME SELECT * FROM judged WHERE part_no IS NULL)
)"""


@query(
    "job_silver",
    f"""WITH {SQL_PARTS},
    counts AS (
        SELECT (SELECT count(*) FROM current WHERE run = 3) AS distinct_keys, (SELECT count(*) FROM current WHERE run = 3 AND reasons <> '[]') AS quarantined_keys,
            (SELECT count(*) FROM judged WHERE run = 3 AND part_no IS NULL) AS null_key_records,
            (SELECT count(*) FROM good a WHERE run = 3 AND part_no NOT IN (SELECT part_no FROM good WHERE run = 1)) AS rows_inserted,
            (SELECT count(*) FROM good a JOIN good b USING (part_no) WHERE a.run = 3 AND b.run = 1
                AND (a.name, a.size, a.maker, a.price) IS DISTINCT FROM (b.name, b.size, b.maker, b.price)) AS rows_updated,
            (SELECT count(*) FROM good WHERE run = 3 AND part_no % 5 = 0) AS unmapped_keys, (SELECT count(*) FROM silver) AS rows_in_target
    )
    SELECT 'silver' AS layer, concat_ws('|', part_no, name, size, lower(maker), price, CASE WHEN part_no % 5 <> 0 THEN 'C' || part_no ELSE 'UNKNOWN' END,
        part_no % 5 <> 0) AS what, 1::BIGINT AS n FROM silver
    UNION ALL SELECT 'quarantine', reasons, count(*) FROM rejected GROUP BY reasons
    UNION ALL SELECT 'report', what, n FROM (SELECT *, 1::BIGINT AS reconciled FROM counts) UNPIVOT (n FOR what IN (COLUMNS(*)))""",
)
def job_silver(spark, sf_dir):
    db = _database(spark)
    catalog = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(
        F.lit("SHOP").alias("shop"), F.col("p_partkey").cast("string").alias("number"), F.concat(F.lit("C"), "p_partkey").alias("catalog_no")
    )
    catalog.write.saveAsTable(f"{db}.catalog")
    entity = Entity(
        PART.name, f"{db}.part", PART.business_key, PART.attributes,
        MasterKey("catalog_no", f"{db}.catalog", "shop", "number", "catalog_no"),
    )
    spec = SilverSpec(f"{db}.bronze", f"{db}.bronze_sightings", "SHOP", (entity,))
    loads = part_raw(spark, sf_dir)
    for batches in ("'L1'", "'L2', 'L3'"):
        loads.where(f"_batch_id IN ({batches})").write.mode("append").saveAsTable(f"{db}.raw")
        build_bronze(spark, f"{db}.raw", f"{db}.bronze", PART_COLUMNS, buckets=BUCKETS)
        report = build_entities(spark, spec, at=datetime(2026, 6, 1, tzinfo=timezone.utc) + timedelta(days=1), buckets=BUCKETS)["tables"]["part"]
    shown = ["part_no", "label", "size", "maker", "price", "catalog_no", "_master_key_resolved"]
    silver = spark.table(f"{db}.part").select(
        F.lit("silver").alias("layer"), F.concat_ws("|", *[F.col(c).cast("string") for c in shown]).alias("what"), F.lit(1).cast("bigint").alias("n")
    )
    quarantine = spark.table(f"{db}.part_quarantine").groupBy(F.lit("quarantine").alias("layer"), F.col("_reasons").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    names = ("distinct_keys", "quarantined_keys", "null_key_records", "rows_inserted", "rows_updated", "unmapped_keys", "rows_in_target", "reconciled")
    return silver.unionByName(quarantine).unionByName(_numbers(spark, "report", {k: report[k] for k in names}))
