"""Cleaning steps, current versions, quarantine, master keys and the change-aware merge."""

from dataclasses import replace

from pyspark.sql import functions as F

from checks.base import query, spread_table, table
from checks.loads import (
    CUSTOMER, MASTER, SEGMENT, SQL_CROSSWALK, SQL_CUSTOMER, SQL_SEGMENTS, SQL_TYPED, START, SYSTEM, crosswalk,
    customer_layers,
)
from sediment.functions.steps import (
    Cast, Default, Lower, NullIf, ParseDate, ParseTimestamp, Trim, Upper, compile_steps,
)
from sediment.operators.bronze import with_last_seen
from sediment.operators.current import (
    conflicting_keys, current_per_key, latest_ties, quarantine_rows, split_keyless, still_invalid, with_value_hash,
)
from sediment.operators.masterkey import ambiguous, lookup_master, restrict_crosswalk
from sediment.operators.merge import action_counts, backfill, changed_rows, upsert_changed
from sediment.operators.projections import project_attributes, record_json, required_reason
from sediment.plans.silver import Versions, entity_rows, seen_records, versions, versions_of
from sediment.staging import stage

_SEEN = ["_record_hash", "_seen_at", "_seen_batch"]
_NAMES = [a.name for a in CUSTOMER.attributes]


def _typed(spark, sf_dir, entity=CUSTOMER):
    """Records of the customer loads with their attributes, reasons and value hash."""
    records = with_last_seen(*customer_layers(spark, sf_dir))
    typed = project_attributes(records, entity.attributes, _SEEN)
    return with_value_hash(typed, [a.name for a in entity.attributes])


def _shown(df, *more):
    return df.select(
        "account_no", "holder", F.col("nation").cast("string").alias("nation"), "segment",
        F.col("balance").cast("string").alias("balance"), *more,
    )


_SHOWN = "account_no, holder, nation::VARCHAR AS nation, segment, balance::VARCHAR AS balance"
_ALL = f"{SQL_CUSTOMER},{SQL_TYPED}"

# --- steps ---------------------------------------------------------------------------------------


def _steps(df, name, steps):
    return compile_steps(F.col(name), df.schema[name].dataType, tuple(steps))


@query(
    "step_text",
    """SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, upper(p_name) AS uppered, lower(p_type) AS lowered,
        upper(trim(' ' || p_size || ' ')) AS number_text FROM part""",
)
def step_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("padded", F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return p.select(
        "p_partkey",
        _steps(p, "padded", [Trim()]).value.alias("trimmed"),
        _steps(p, "p_name", [Upper()]).value.alias("uppered"),
        _steps(p, "p_type", [Lower()]).value.alias("lowered"),
        _steps(p, "p_size", [Trim(), Upper()]).value.alias("number_text"),
    )


@query(
    "step_null_if",
    """SELECT p_partkey, CASE WHEN trim(p_brand) IN ('Brand#1', 'Brand#2') THEN NULL ELSE p_brand END AS brand,
        CASE WHEN p_size IN (1, 5, 7) THEN NULL ELSE p_size END AS size FROM part""",
)
def step_null_if(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        _steps(p, "p_brand", [NullIf(("Brand#1", "Brand#2"))]).value.alias("brand"),
        _steps(p, "p_size", [NullIf(("1", "5", "7"))]).value.alias("size"),
    )


@query(
    "step_cast",
    """SELECT l_orderkey, l_linenumber, l_partkey::INT AS part, l_quantity::BIGINT AS quantity,
        CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_suppkey END AS supplier, l_returnflag = 'A' AS failed
    FROM lineitem""",
)
def step_cast(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem").withColumn(
        "code", F.when(F.col("l_returnflag") == "A", F.concat(F.lit("A"), "l_suppkey")).otherwise(F.col("l_suppkey").cast("string"))
    )
    supplier = _steps(lines, "code", [Trim(), Cast("BIGINT")])
    return lines.select(
        "l_orderkey", "l_linenumber",
        _steps(lines, "l_partkey", [Cast("INT")]).value.alias("part"),
        _steps(lines, "l_quantity", [Cast("BIGINT")]).value.alias("quantity"),
        supplier.value.alias("supplier"),
        supplier.failed.alias("failed"),
    )


@query(
    "step_parse_date",
    """SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS iso, o_orderdate::DATE::VARCHAR AS compact,
        o_orderdate::DATE::VARCHAR AS us, o_orderstatus = 'P' AS failed,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE::VARCHAR END AS partly FROM orders""",
)
def step_parse_date(spark, sf_dir):
    o = spread_table(spark, sf_dir, "orders")
    o = o.select(
        "o_orderkey", "o_orderstatus",
        *[
            F.date_format("o_orderdate", p).alias(n)
            for n, p in [("iso", "yyyy-MM-dd"), ("compact", "yyyyMMdd"), ("us", "MM/dd/yyyy")]
        ],
    ).withColumn("partly", F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("iso")))
    partly = _steps(o, "partly", [Trim(), ParseDate("yyyy-MM-dd")])
    return o.select(
        "o_orderkey",
        _steps(o, "iso", [ParseDate("yyyy-MM-dd")]).value.cast("string").alias("iso"),
        _steps(o, "compact", [Cast("INT"), ParseDate("yyyyMMdd")]).value.cast("string").alias("compact"),
        _steps(o, "us", [ParseDate("MM/dd/yyyy")]).value.cast("string").alias("us"),
        partly.failed.alias("failed"),
        partly.value.cast("string").alias("partly"),
    )


@query(
    "step_parse_timestamp",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS plain,
        strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS with_t, event_type = 'error' AS failed FROM events""",
)
def step_parse_timestamp(spark, sf_dir):
    e = spread_table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("plain"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("with_t"),
        F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyyMMddHHmmss")).alias("compact"),
    )
    return e.select(
        "event_id",
        *[
            F.date_format(_steps(e, n, [ParseTimestamp(p)]).value, "yyyy-MM-dd HH:mm:ss").alias(n)
            for n, p in [("plain", "yyyy-MM-dd HH:mm:ss"), ("with_t", "yyyy-MM-dd'T'HH:mm:ss")]
        ],
        _steps(e, "compact", [ParseTimestamp("yyyyMMddHHmmss")]).failed.alias("failed"),
    )


@query(
    "step_default",
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'none' ELSE p_brand END AS brand,
        CASE WHEN p_size IN (1, 2) THEN -1 ELSE p_size END AS size FROM part""",
)
def step_default(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        _steps(p, "p_brand", [NullIf(("Brand#1",)), Default("none")]).value.alias("brand"),
        _steps(p, "p_size", [NullIf(("1", "2")), Default("-1")]).value.alias("size"),
    )


@query(
    "step_failures",
    f"""WITH {_ALL} SELECT _record_hash, nation::VARCHAR AS nation, bad_nation AS failed FROM typed""",
)
def step_failures(spark, sf_dir):
    bronze, _ = customer_layers(spark, sf_dir)
    nation = _steps(bronze, "seat", [NullIf(("-",)), Cast("SMALLINT")])
    return bronze.select(
        "_record_hash", nation.value.cast("string").alias("nation"), nation.failed.alias("failed")
    )


# --- current versions and quarantine -------------------------------------------------------------


@query(
    "split_keyless",
    f"""WITH {_ALL} SELECT CASE WHEN account_no IS NULL THEN 'keyless' ELSE 'keyed' END AS side,
        _record_hash, holder FROM typed""",
)
def keyless_split(spark, sf_dir):
    keyed, keyless = split_keyless(_typed(spark, sf_dir), ["account_no"])
    shown = [F.col("_record_hash"), F.col("holder")]
    return keyed.select(F.lit("keyed").alias("side"), *shown).unionByName(
        keyless.select(F.lit("keyless").alias("side"), *shown)
    )


@query(
    "quarantine_reasons",
    f"WITH {_ALL} SELECT _record_hash, n_reasons, reasons, n_reasons = 0 AS valid FROM typed",
)
def quarantine_reasons(spark, sf_dir):
    return _typed(spark, sf_dir).select(
        "_record_hash",
        F.size("_reasons").alias("n_reasons"),
        F.array_join("_reasons", "; ").alias("reasons"),
        (F.size("_reasons") == 0).alias("valid"),
    )


@query(
    "required_values",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'kind: required value is empty' END AS reason FROM events""",
)
def required_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("kind", F.nullif("event_type", F.lit("error")))
    return e.select("event_id", required_reason("kind").alias("reason"))


@query("latest_per_key_ties", f"WITH {_ALL} SELECT account_no, _record_hash, _seen_batch, _value_hash FROM ties")
def latest_per_key_ties(spark, sf_dir):
    keyed, _ = split_keyless(_typed(spark, sf_dir), ["account_no"])
    return latest_ties(stage(keyed), ["account_no"]).select("account_no", "_record_hash", "_seen_batch", "_value_hash")


@query(
    "segment_ties",
    f"WITH {SQL_CUSTOMER},{SQL_SEGMENTS} SELECT segment_code, description, _record_hash, _seen_batch FROM segment_ties",
)
def segment_ties(spark, sf_dir):
    """The same with few keys that hold a fifth of the rows each."""
    return latest_ties(stage(_typed(spark, sf_dir, SEGMENT)), ["segment_code"]).select(
        "segment_code", "description", "_record_hash", "_seen_batch"
    )


@query("current_per_key", f"WITH {_ALL} SELECT {_SHOWN}, _record_hash, _seen_batch FROM latest")
def current_versions(spark, sf_dir):
    keyed, _ = split_keyless(_typed(spark, sf_dir), ["account_no"])
    return _shown(current_per_key(keyed, ["account_no"]), "_record_hash", "_seen_batch")


@query(
    "conflicting_keys",
    f"""WITH {SQL_CUSTOMER},{SQL_SEGMENTS}
    SELECT segment_code FROM segment_ties GROUP BY 1 HAVING count(DISTINCT _value_hash) > 1""",
)
def conflicts(spark, sf_dir):
    return conflicting_keys(_typed(spark, sf_dir, SEGMENT), ["segment_code"])


def _versions(spark, sf_dir):
    return versions(*customer_layers(spark, sf_dir), CUSTOMER)


def _at():
    return F.timestamp_seconds(F.lit(START + 10 * 86400))


@query(
    "quarantine_rows",
    f"""WITH {_ALL}, rejected AS (
        SELECT _record_hash, reasons FROM typed WHERE account_no IS NULL
        UNION ALL SELECT _record_hash, reasons FROM latest WHERE n_reasons > 0)
    SELECT _record_hash, '["' || replace(reasons, '; ', '","') || '"]' AS _reasons,
        '{{' || CASE WHEN custkey IS NULL THEN '' ELSE '"custkey":' || custkey || ',' END
        || '"name":"' || name || '","seat":"' || seat || '","segment":"' || segment || '","segment_text":"'
        || segment_text || '","balance":' || balance || '}}' AS _record
    FROM rejected JOIN bronze USING (_record_hash)""",
)
def quarantine(spark, sf_dir):
    """As the job does it: the records, which are used three times, and the current versions are staged."""
    bronze, seen = customer_layers(spark, sf_dir)
    bronze = stage(bronze)
    found = versions_of(stage(seen_records(bronze, seen, (CUSTOMER,))), CUSTOMER)
    rejected = Versions(stage(found.current), found.keyless).rejected
    return quarantine_rows(rejected, bronze, record_json(bronze), _at()).drop("_quarantined_at")


@query(
    "still_invalid",
    f"""WITH {_ALL}, ever AS (SELECT _record_hash FROM typed WHERE n_reasons > 0),
    rejected AS (SELECT _record_hash FROM typed WHERE account_no IS NULL
        UNION ALL SELECT _record_hash FROM latest WHERE n_reasons > 0)
    SELECT _record_hash FROM ever WHERE _record_hash IN (SELECT _record_hash FROM rejected)""",
)
def quarantined_today(spark, sf_dir):
    ever = _typed(spark, sf_dir).where(F.size("_reasons") > 0).select("_record_hash")
    return still_invalid(ever, _versions(spark, sf_dir).rejected)


@query(
    "record_json",
    """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"'
        || o_orderstatus || '"' || CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE ',"priority":"' || o_orderpriority || '"' END
        || '}' AS record FROM orders""",
)
def record_as_json(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")
    )
    return o.select("o_orderkey", record_json(o).alias("record"))


# --- master keys ---------------------------------------------------------------------------------

_PAIRS = """pairs AS (
    SELECT DISTINCT local_key, golden_key FROM crosswalk
    WHERE subject = 'account' AND origin = 'BANK' AND local_key IS NOT NULL AND golden_key IS NOT NULL
)"""


@query("crosswalk_filter", f"WITH {SQL_CROSSWALK},{_PAIRS} SELECT local_key, golden_key FROM pairs")
def crosswalk_filter(spark, sf_dir):
    pairs = restrict_crosswalk(crosswalk(spark, sf_dir), MASTER, SYSTEM)
    return pairs.select(F.col("_cw_key").alias("local_key"), F.col("_cw_master").alias("golden_key"))


@query(
    "ambiguous_mappings",
    f"""WITH {SQL_CROSSWALK}
    SELECT local_key, count(DISTINCT golden_key) AS n FROM crosswalk
    WHERE origin = 'BANK' AND local_key IS NOT NULL AND golden_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT golden_key) > 1""",
)
def ambiguous_mappings(spark, sf_dir):
    # Without the entity type, the product keys clash with the customer keys.
    mixed = replace(MASTER, entity_type_column=None, entity_type=None)
    pairs = restrict_crosswalk(crosswalk(spark, sf_dir), mixed, SYSTEM)
    return ambiguous(pairs).withColumnRenamed("_cw_key", "local_key")


@query(
    "master_key_lookup",
    f"""WITH {SQL_CROSSWALK},{_PAIRS}
    SELECT o_orderkey, o_custkey, coalesce(golden_key, 'UNKNOWN') AS golden, golden_key IS NOT NULL AS resolved
    FROM orders LEFT JOIN pairs ON o_custkey::VARCHAR = local_key""",
)
def master_key_lookup(spark, sf_dir):
    pairs = restrict_crosswalk(crosswalk(spark, sf_dir), MASTER, SYSTEM)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookup_master(o, pairs, "o_custkey", "golden", "UNKNOWN").withColumnRenamed(
        "_master_key_resolved", "resolved"
    )


# --- entities and merges -------------------------------------------------------------------------


@query(
    "silver_current_customer",
    f"""WITH {_ALL},{SQL_CROSSWALK},{_PAIRS}
    SELECT {_SHOWN}, coalesce(golden_key, 'UNKNOWN') AS golden, golden_key IS NOT NULL AS _master_key_resolved,
        'BANK' AS _source_system, _record_hash
    FROM latest LEFT JOIN pairs ON account_no::VARCHAR = local_key WHERE n_reasons = 0""",
)
def silver_current_customer(spark, sf_dir):
    found = _versions(spark, sf_dir)
    pairs = restrict_crosswalk(crosswalk(spark, sf_dir), MASTER, SYSTEM)
    valid = lookup_master(found.valid, pairs, "account_no", "golden", "UNKNOWN")
    rows = entity_rows(valid, CUSTOMER, SYSTEM, _at())
    return _shown(rows, "golden", "_master_key_resolved", "_source_system", "_record_hash")


@query(
    "silver_split_customer_segment",
    f"""WITH {_ALL},{SQL_SEGMENTS}
    SELECT 'customer' AS entity, account_no::VARCHAR AS key, holder AS text, _record_hash FROM latest WHERE n_reasons = 0
    UNION ALL SELECT 'segment', segment_code, description, _record_hash FROM segment_latest""",
)
def silver_split(spark, sf_dir):
    """Two entities from one Bronze table."""
    bronze, seen = customer_layers(spark, sf_dir)
    customers = versions(bronze, seen, CUSTOMER).valid.select(
        F.lit("customer").alias("entity"), F.col("account_no").cast("string").alias("key"),
        F.col("holder").alias("text"), "_record_hash",
    )
    segments = versions(bronze, seen, SEGMENT).valid.select(
        F.lit("segment").alias("entity"), F.col("segment_code").alias("key"), F.col("description").alias("text"),
        "_record_hash",
    )
    return customers.unionByName(segments)


# The merge queries bring a table of line items, one row per order and line, up to date with the
# sums over all copies of the line.  The old table lacks open orders and has other prices for returns.
_SQL_MERGE = """
old AS (
    SELECT l_orderkey, l_linenumber, sum(l_quantity::INT)::BIGINT AS quantity, min(nullif(l_linestatus, 'O')) AS status,
        min(l_shipdate::DATE) AS shipped
    FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2
),
new AS (
    SELECT l_orderkey, l_linenumber, sum(l_quantity::INT)::BIGINT AS quantity, min(nullif(l_linestatus, 'O')) AS status,
        min(l_shipdate::DATE) AS shipped
    FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2
),
merged AS (
    SELECT coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey, coalesce(o.l_linenumber, n.l_linenumber) AS l_linenumber,
        CASE WHEN n.l_orderkey IS NULL THEN o.quantity ELSE n.quantity END AS quantity,
        CASE WHEN n.l_orderkey IS NULL THEN o.status ELSE n.status END AS status,
        CASE WHEN n.l_orderkey IS NULL THEN o.shipped ELSE n.shipped END::VARCHAR AS shipped,
        CASE WHEN o.l_orderkey IS NULL THEN 'insert' WHEN n.l_orderkey IS NULL THEN 'kept'
            WHEN o.quantity IS DISTINCT FROM n.quantity OR o.status IS DISTINCT FROM n.status
                OR o.shipped IS DISTINCT FROM n.shipped THEN 'update'
            ELSE 'unchanged' END AS _action
    FROM old o FULL JOIN new n ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber
)"""
_MERGE_KEYS = ["l_orderkey", "l_linenumber"]


def _merge_sides(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem")

    def side(without):
        return (
            lines.where(F.col("l_returnflag") != without)
            .groupBy(*_MERGE_KEYS)
            .agg(
                F.sum(F.col("l_quantity").cast("int")).alias("quantity"),
                F.min(F.nullif("l_linestatus", F.lit("O"))).alias("status"),
                F.min(F.col("l_shipdate").cast("date")).alias("shipped"),
            )
        )

    return side("N"), side("R")


@query("merge_upsert_changed", f"WITH {_SQL_MERGE} SELECT * FROM merged")
def merge_upsert_changed(spark, sf_dir):
    old, new = _merge_sides(spark, sf_dir)
    return upsert_changed(old, new, _MERGE_KEYS).withColumn("shipped", F.col("shipped").cast("string"))


@query("changed_rows", f"WITH {_SQL_MERGE} SELECT * EXCLUDE (_action) FROM merged WHERE _action = 'update'")
def changed(spark, sf_dir):
    old, new = _merge_sides(spark, sf_dir)
    return changed_rows(old, new, _MERGE_KEYS).withColumn("shipped", F.col("shipped").cast("string"))


@query(
    "reconciliation_report",
    f"""WITH {_SQL_MERGE}
    SELECT count(*) FILTER (_action = 'insert') AS rows_insert, count(*) FILTER (_action = 'update') AS rows_update,
        count(*) FILTER (_action = 'unchanged') AS rows_unchanged, count(*) FILTER (_action = 'kept') AS rows_kept,
        count(*) AS rows_in_target FROM merged""",
)
def reconciliation_report(spark, sf_dir):
    old, new = _merge_sides(spark, sf_dir)
    merged = upsert_changed(old, new, _MERGE_KEYS)
    return merged.agg(*action_counts(merged), F.count(F.lit(1)).alias("rows_in_target"))


@query(
    "silver_run_counts",
    f"""WITH {_ALL},{SQL_CROSSWALK},{_PAIRS}
    SELECT (SELECT count(*) FROM typed WHERE account_no IS NULL) AS null_key_records,
        (SELECT count(*) FROM latest) AS distinct_keys,
        (SELECT count(*) FROM latest WHERE n_reasons > 0) AS quarantined_keys,
        (SELECT count(*) FROM (SELECT account_no FROM ties GROUP BY 1 HAVING count(DISTINCT _value_hash) > 1)) AS conflicting_keys,
        (SELECT count(*) FROM latest LEFT JOIN pairs ON account_no::VARCHAR = local_key
            WHERE n_reasons = 0 AND golden_key IS NULL) AS unmapped_keys,
        (SELECT count(*) FROM pairs) AS crosswalk_rows""",
)
def silver_run_counts(spark, sf_dir):
    found = _versions(spark, sf_dir)
    pairs = restrict_crosswalk(crosswalk(spark, sf_dir), MASTER, SYSTEM)
    current = lookup_master(found.current, pairs, "account_no", "golden", "UNKNOWN")
    valid = F.size("_reasons") == 0
    counts = current.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(~valid).alias("quarantined_keys"),
        F.count_if("_conflicting").alias("conflicting_keys"),
        F.count_if(valid & ~F.col("_master_key_resolved")).alias("unmapped_keys"),
    )
    return counts.withColumns(
        {
            "null_key_records": found.keyless.agg(F.count(F.lit(1))).scalar(),
            "crosswalk_rows": pairs.agg(F.count(F.lit(1))).scalar(),
        }
    )


@query(
    "backfill_missing",
    """WITH known AS (SELECT o_custkey AS id, min(CASE WHEN o_orderstatus = 'F' THEN 'late' END) AS note, count(*) AS orders
        FROM orders GROUP BY 1)
    SELECT coalesce(id, c_custkey) AS id, CASE WHEN id IS NULL THEN c_mktsegment ELSE coalesce(note, c_mktsegment) END AS note,
        CASE WHEN id IS NULL THEN 0 ELSE orders END AS orders
    FROM known FULL JOIN customer ON id = c_custkey""",
)
def backfill_missing(spark, sf_dir):
    known = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("id"))
        .agg(F.min(F.when(F.col("o_orderstatus") == "F", "late")).alias("note"), F.count(F.lit(1)).alias("orders"))
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("note"), F.lit(0).cast("bigint").alias("orders")
    )
    return backfill(known, customers, ["id"], only_if_empty=["note"])
