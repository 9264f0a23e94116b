"""Identity, distinct records and sightings."""

from pyspark.sql import functions as F

from checks.base import query, spread_table, sql_canonical, sql_hash, table
from checks.loads import (
    CUSTOMER_COLUMNS, LINE_COLUMNS, SQL_CUSTOMER, SQL_LINE, customer_hashed, customer_layers, customer_raw,
    line_bronze, line_hashed, line_raw, line_sightings,
)
from sediment.functions.identity import canonical_text, hash_text, record_hash, value_hash
from sediment.operators.bronze import (
    PIECE_BYTES, distinct_stats, duplicates, first_seen, hashed, last_seen, latest_version_of, orphans, sightings, with_last_seen,
)
from sediment.operators.gather import gathered, pieces
from sediment.operators.merge import mark_new, merge_insert_only
from sediment.operators.projections import column_diff, guard_schema
from sediment.sources.tables import job_session
from sediment.types import LINEAGE_COLUMNS

_TIMES = "epoch_us(_ingested_at) AS seen_us, _source_file, _batch_id"


def _hash():
    """The packed hash of the line items as text."""
    return hash_text(F.col("_record_hash")).alias("_record_hash")


def _times():
    return [F.unix_micros("_ingested_at").alias("seen_us"), F.col("_source_file"), F.col("_batch_id")]


@query(
    "bronze_distinct",
    f"WITH {SQL_LINE} SELECT order_id, part_id, supplier_id, line, quantity, price::VARCHAR AS price, flag, status,"
    f" shipped::VARCHAR AS shipped, _record_hash, {_TIMES} FROM bronze",
)
def bronze_distinct(spark, sf_dir):
    return line_bronze(spark, sf_dir).select(
        "order_id", "part_id", "supplier_id", "line", "quantity", F.col("price").cast("string").alias("price"),
        "flag", "status", F.col("shipped").cast("string").alias("shipped"), _hash(), *_times(),
    )


@query(
    "bronze_first_seen",
    f"WITH {SQL_CUSTOMER} SELECT b._record_hash, custkey, segment, copies, {_TIMES} FROM bronze b"
    " JOIN (SELECT _record_hash, count(*) AS copies FROM hashed GROUP BY 1) USING (_record_hash)",
)
def bronze_first_seen(spark, sf_dir):
    return first_seen(customer_hashed(spark, sf_dir)).select(
        "_record_hash", "custkey", "segment", F.col("_copies").alias("copies"), *_times()
    )


@query(
    "sightings",
    f"WITH {SQL_LINE} SELECT _record_hash, _batch_id, epoch_us(_ingested_at) AS seen_us FROM sightings",
)
def line_sightings_rows(spark, sf_dir):
    return line_sightings(spark, sf_dir).select(
        _hash(), "_batch_id", F.unix_micros("_ingested_at").alias("seen_us")
    )


@query(
    "distinct_stats",
    f"WITH {SQL_LINE} SELECT count(*) AS rows, count(DISTINCT _record_hash) AS distinct_records FROM hashed",
)
def stats(spark, sf_dir):
    return distinct_stats(line_hashed(spark, sf_dir))


@query(
    "records_last_seen",
    f"WITH {SQL_CUSTOMER} SELECT _record_hash, custkey, segment, epoch_us(_seen_at) AS seen_us, _seen_batch FROM records",
)
def records_last_seen(spark, sf_dir):
    records = with_last_seen(*customer_layers(spark, sf_dir))
    return records.select(
        "_record_hash", "custkey", "segment", F.unix_micros("_seen_at").alias("seen_us"), "_seen_batch"
    )


@query(
    "last_sighting",
    f"WITH {SQL_LINE} SELECT _record_hash, epoch_us(_seen_at) AS seen_us, _seen_batch FROM seen",
)
def last_sighting(spark, sf_dir):
    return last_seen(line_sightings(spark, sf_dir)).select(
        _hash(), F.unix_micros("_seen_at").alias("seen_us"), "_seen_batch"
    )


@query(
    "latest_seen_version",
    f"""WITH {SQL_CUSTOMER}
    SELECT custkey, segment, balance::VARCHAR AS balance, _seen_batch FROM records WHERE custkey IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY _seen_at DESC, _seen_batch DESC, _record_hash DESC) = 1""",
)
def latest_seen_version(spark, sf_dir):
    bronze, seen = customer_layers(spark, sf_dir)
    return latest_version_of(bronze.where("custkey IS NOT NULL"), seen, ["custkey"]).select(
        "custkey", "segment", F.col("balance").cast("string").alias("balance"), "_seen_batch"
    )


@query(
    "duplicate_keys",
    f"""WITH {SQL_LINE}
    SELECT _record_hash, _batch_id, count(*) AS copies FROM hashed GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT _record_hash, 'bronze', count(*) FROM bronze GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT l_orderkey || '/' || l_linenumber, 'lineitem', count(*) FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    rows = line_hashed(spark, sf_dir).select("_record_hash", "_batch_id")
    in_raw = duplicates(gathered(rows, ["_record_hash"], PIECE_BYTES), ["_record_hash", "_batch_id"]).withColumn("_record_hash", _hash())
    in_bronze = duplicates(line_bronze(spark, sf_dir), ["_record_hash"]).select(
        _hash(), F.lit("bronze").alias("_batch_id"), "copies"
    )
    in_lines = duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("_record_hash"),
        F.lit("lineitem").alias("_batch_id"), "copies",
    )
    return in_raw.unionByName(in_bronze).unionByName(in_lines)


@query(
    "orphan_sightings",
    f"""WITH {SQL_CUSTOMER}, old AS (SELECT * FROM bronze WHERE _batch_id <> 'L2')
    SELECT _record_hash, _batch_id FROM sightings s
    WHERE NOT EXISTS (SELECT 1 FROM old b WHERE b._record_hash = s._record_hash)""",
)
def orphan_sightings(spark, sf_dir):
    # The records that only the second load brought are missing from this Bronze table.
    bronze, seen = customer_layers(spark, sf_dir)
    return orphans(seen, bronze.where("_batch_id <> 'L2'"), "_record_hash").select("_record_hash", "_batch_id")


@query(
    "merge_insert_only",
    f"""WITH {SQL_LINE}, target AS (SELECT _record_hash, _batch_id, _ingested_at, 'target' AS origin FROM sightings
        WHERE _batch_id = 'L1')
    SELECT _record_hash, _batch_id, epoch_us(_ingested_at) AS seen_us, origin FROM target
    UNION ALL SELECT _record_hash, _batch_id, epoch_us(_ingested_at), 'source' FROM sightings s
    WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t._record_hash = s._record_hash
        AND t._batch_id IS NOT DISTINCT FROM s._batch_id)""",
)
def insert_only(spark, sf_dir):
    # A sighting is of one load, so those of the first are among those of all.  Both sides lie by the hash in as many pieces, which
    # serves the join in a job's session; staged, they would be shuffled once more.
    job = job_session(spark, pieces(table(spark, sf_dir, "lineitem"), PIECE_BYTES))
    seen = line_sightings(job, sf_dir)
    first = seen.where("_batch_id = 'L1'").withColumn("origin", F.lit("target"))
    everything = seen.withColumn("origin", F.lit("source"))
    merged = merge_insert_only(first, everything, ["_record_hash", "_batch_id"], null_safe=["_batch_id"])
    return merged.select(_hash(), "_batch_id", F.unix_micros("_ingested_at").alias("seen_us"), "origin")


@query(
    "bronze_reconciliation",
    f"""WITH {SQL_LINE},
    target AS (SELECT DISTINCT _record_hash FROM hashed WHERE _batch_id = 'L1'),
    totals AS (SELECT (SELECT count(*) FROM hashed) AS rows_read, (SELECT count(*) FROM bronze) AS distinct_records,
        (SELECT count(*) FROM bronze WHERE _record_hash NOT IN (SELECT _record_hash FROM target)) AS rows_inserted,
        (SELECT count(*) FROM target) AS rows_before)
    SELECT rows_read, rows_read - distinct_records AS duplicates_removed, distinct_records, rows_inserted,
        distinct_records - rows_inserted AS already_in_target, rows_before + rows_inserted AS rows_in_target,
        distinct_records - rows_inserted = rows_before AS reconciled
    FROM totals""",
)
def bronze_reconciliation(spark, sf_dir):
    """A full re-read of Raw merged into the Bronze table its first load made, as counts."""
    rows = line_raw(spark, sf_dir)
    target = hashed(rows.where("_batch_id = 'L1'"), LINE_COLUMNS).select("_record_hash").distinct()
    incoming = first_seen(hashed(rows, LINE_COLUMNS)).select("_record_hash", "_copies")
    marked = mark_new(incoming, target, ["_record_hash"])
    counts = marked.agg(
        F.sum("_copies").alias("rows_read"),
        F.count(F.lit(1)).alias("distinct_records"),
        F.count_if(F.col("_action") == "insert").alias("rows_inserted"),
    )
    before = target.agg(F.count(F.lit(1))).scalar()
    already = F.col("distinct_records") - F.col("rows_inserted")
    return counts.withColumn("rows_before", before).select(
        "rows_read",
        (F.col("rows_read") - F.col("distinct_records")).alias("duplicates_removed"),
        "distinct_records",
        "rows_inserted",
        already.alias("already_in_target"),
        (F.col("rows_before") + F.col("rows_inserted")).alias("rows_in_target"),
        (already == F.col("rows_before")).alias("reconciled"),
    )


@query(
    "schema_guard_report",
    f"""WITH {SQL_CUSTOMER}, wider AS (SELECT *, length(name) AS name_length FROM raw)
    SELECT 'name_length' AS extra, 'region_id' AS missing, count(*) AS rows,
        (SELECT count(*) FROM bronze) AS distinct_records, count(name_length) AS extra_values FROM wider""",
)
def schema_guard_report(spark, sf_dir):
    """Raw gained a column: it is reported, and the records keep their identity."""
    wider = customer_raw(spark, sf_dir).withColumn("name_length", F.length("name"))
    extra = guard_schema(wider, CUSTOMER_COLUMNS)
    missing, _ = column_diff(wider.columns, [*CUSTOMER_COLUMNS, *LINEAGE_COLUMNS, "region_id"])
    per_record = (
        hashed(wider, CUSTOMER_COLUMNS)
        .withColumn("name_length", F.length("name"))
        .groupBy("_record_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.count("name_length").alias("filled"))
    )
    return per_record.agg(
        F.lit(",".join(extra)).alias("extra"),
        F.lit(",".join(missing)).alias("missing"),
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_records"),
        F.sum("filled").alias("extra_values"),
    )


_CUSTOMER_FIELDS = ["c_custkey", "c_name", "c_mktsegment"]


@query(
    "record_hash",
    f"SELECT c_custkey, {sql_hash(*_CUSTOMER_FIELDS)} AS record_hash FROM customer",
)
def customer_record_hash(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", record_hash([c.schema[f] for f in _CUSTOMER_FIELDS]).alias("record_hash"))


@query(
    "value_hash",
    f"""SELECT l_orderkey, l_linenumber, {sql_hash('l_extendedprice::DECIMAL(15,2)', 'l_shipdate::DATE',
        'epoch_us(l_shipdate)', "nullif(l_returnflag, 'N')")} AS value_hash FROM lineitem""",
)
def line_value_hash(spark, sf_dir):
    typed = spread_table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").cast("decimal(15,2)").alias("price"),
        F.col("l_shipdate").cast("date").alias("shipped"),
        # The wall-clock time as the instant it names in UTC, whatever the session's time zone.
        F.timestamp_seconds(F.unix_date(F.col("l_shipdate").cast("date")) * 86400).alias("instant"),
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
    )
    fields = [typed.schema[f] for f in ("price", "shipped", "instant", "flag")]
    return typed.select("l_orderkey", "l_linenumber", value_hash(fields).alias("value_hash"))


@query(
    "canonical_text",
    f"""SELECT o_orderkey, {sql_canonical('o_custkey')} AS whole, {sql_canonical('o_totalprice::DECIMAL(12,2)')} AS money,
        {sql_canonical("nullif(o_orderstatus, 'F')")} AS status, {sql_canonical('o_orderdate::DATE')} AS day,
        {sql_canonical('epoch_us(o_orderdate)')} AS instant, {sql_canonical("o_orderstatus = 'O'")} AS flag,
        {sql_canonical('hex(encode(o_orderpriority))')} AS bytes
    FROM orders""",
)
def canonical_texts(spark, sf_dir):
    typed = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("whole"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("money"),
        F.nullif("o_orderstatus", F.lit("F")).alias("status"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.timestamp_seconds(F.unix_date(F.col("o_orderdate").cast("date")) * 86400).alias("instant"),
        (F.col("o_orderstatus") == "O").alias("flag"),
        F.encode("o_orderpriority", "UTF-8").alias("bytes"),
    )
    names = [c for c in typed.columns if c != "o_orderkey"]
    return typed.select(
        "o_orderkey", *[canonical_text(F.col(n), typed.schema[n].dataType).alias(n) for n in names]
    )
