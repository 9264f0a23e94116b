"""The Raw tables the queries start from: every row of a given table, loaded several times.

Each load holds the whole table.  The second load changes some values, the third takes part of the
changes back, so records repeat, change and revert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import spread_table, sql_hash, table
from sediment.functions.identity import packed
from sediment.functions.steps import Cast, NullIf, Trim, Upper
from sediment.operators.bronze import PIECE_BYTES, earliest_copies, hashed, sightings
from sediment.plans.spec import Attribute, Entity, MasterKey

DAY = 86400
START = 1767225600  # 2026-01-01 00:00:00 UTC

_LOADS = [(1, "a"), (1, "b"), (2, "a"), (3, "a")]


def _each_load(df: DataFrame, loads) -> DataFrame:
    """Every row once per load, with the load's number `n` and file `f`."""
    listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("f")) for n, f in loads])
    return df.select("*", F.explode(listed).alias("_load")).select("*", "_load.n", "_load.f").drop("_load")


def _lineage(prefix: str):
    seconds = F.lit(START) + F.col("n") * DAY + F.when(F.col("f") == "b", 60).otherwise(0)
    return [
        F.timestamp_seconds(seconds).alias("_ingested_at"),
        F.concat(F.lit(prefix), F.col("f"), F.lit(".csv")).alias("_source_file"),
        F.concat(F.lit("L"), F.col("n").cast("string")).alias("_batch_id"),
    ]


def _sql_lineage(prefix: str) -> str:
    return f"""
        TIMESTAMP '2026-01-01' + to_days(n) + CASE WHEN f = 'b' THEN INTERVAL 60 SECOND ELSE INTERVAL 0 SECOND END
            AS _ingested_at,
        '{prefix}' || f || '.csv' AS _source_file,
        'L' || n AS _batch_id"""


# --- customers: dirty attributes, missing keys -------------------------------------------------

CUSTOMER_COLUMNS = ["custkey", "name", "seat", "segment", "segment_text", "balance"]


def customer_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("c_custkey"), F.col("n")
    changed = ((n == 2) & (key % 10 == 0)) | ((n == 3) & (key % 20 == 10))
    return _each_load(spread_table(spark, sf_dir, "customer"), _LOADS).select(
        F.when(key % 29 != 0, key).alias("custkey"),
        F.when(key % 31 == 0, F.lit(" # ")).otherwise(F.concat(F.lower("c_name"), F.lit("  "))).alias("name"),
        F.when(key % 17 == 0, F.lit("-")).otherwise(F.concat(F.when(key % 13 == 12, "N").otherwise(""), F.col("c_nationkey").cast("string"))).alias("seat"),
        F.concat(F.col("c_mktsegment"), F.when(changed, "_X").otherwise("")).alias("segment"),
        F.concat(F.lit("about "), F.lower("c_mktsegment"), F.when(key % 1000 == 7, " (old)").otherwise("")).alias("segment_text"),
        F.col("c_acctbal").cast("decimal(15,2)").alias("balance"),
        *_lineage("customer_"),
    )


_CUSTOMER_HASH = sql_hash(*CUSTOMER_COLUMNS)

SQL_CUSTOMER_RAW = f"""
loads(n, f) AS (VALUES (1, 'a'), (1, 'b'), (2, 'a'), (3, 'a')),
raw AS (
    SELECT
        CASE WHEN c_custkey % 29 <> 0 THEN c_custkey END AS custkey,
        CASE WHEN c_custkey % 31 = 0 THEN ' # ' ELSE lower(c_name) || '  ' END AS name,
        CASE WHEN c_custkey % 17 = 0 THEN '-' ELSE CASE WHEN c_custkey % 13 = 12 THEN 'N' ELSE '' END || c_nationkey END AS seat,
        c_mktsegment || CASE WHEN (n = 2 AND c_custkey % 10 = 0) OR (n = 3 AND c_custkey % 20 = 10)
            THEN '_X' ELSE '' END AS segment,
        'about ' || lower(c_mktsegment) || CASE WHEN c_custkey % 1000 = 7 THEN ' (old)' ELSE '' END AS segment_text,
        c_acctbal::DECIMAL(15,2) AS balance,
        {_sql_lineage('customer_')}
    FROM customer, loads
),
hashed AS (SELECT *, {_CUSTOMER_HASH} AS _record_hash FROM raw)"""

_SQL_BRONZE = """
bronze AS (
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY _record_hash
            ORDER BY _ingested_at NULLS LAST, _batch_id NULLS LAST, _source_file NULLS LAST) AS rn FROM hashed
    ) WHERE rn = 1
),
sightings AS (
    SELECT _record_hash, _batch_id, min(_ingested_at) AS _ingested_at FROM hashed GROUP BY 1, 2
),
seen AS (
    SELECT _record_hash, _ingested_at AS _seen_at, _batch_id AS _seen_batch FROM (
        SELECT *, row_number() OVER (PARTITION BY _record_hash ORDER BY _ingested_at DESC, _batch_id DESC) AS rn
        FROM sightings
    ) WHERE rn = 1
),
records AS (SELECT b.*, s._seen_at, s._seen_batch FROM bronze b LEFT JOIN seen s USING (_record_hash))"""

SQL_CUSTOMER = f"{SQL_CUSTOMER_RAW},{_SQL_BRONZE}"


def customer_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(customer_raw(spark, sf_dir), CUSTOMER_COLUMNS)


def customer_layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(Bronze, sightings) of the customer loads."""
    rows = customer_hashed(spark, sf_dir)
    return earliest_copies(rows), sightings(rows)


# --- line items: the large table ---------------------------------------------------------------

LINE_COLUMNS = ["order_id", "part_id", "supplier_id", "line", "quantity", "price", "flag", "status", "shipped"]


def line_raw(spark: SparkSession, sf_dir: str, piece_bytes: int | None = None) -> DataFrame:
    changed = (F.col("n") == 2) & (F.col("l_partkey") % 10 == 0)
    return _each_load(spread_table(spark, sf_dir, "lineitem", piece_bytes), [(1, "a"), (2, "a"), (3, "a")]).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_quantity").cast("int") + F.when(changed, 1).otherwise(0)).alias("quantity"),
        F.col("l_extendedprice").cast("decimal(15,2)").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").cast("date").alias("shipped"),
        *_lineage("lineitem_"),
    )


SQL_LINE = f"""
loads(n, f) AS (VALUES (1, 'a'), (2, 'a'), (3, 'a')),
raw AS (
    SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id, l_linenumber AS line,
        l_quantity::INT + CASE WHEN n = 2 AND l_partkey % 10 = 0 THEN 1 ELSE 0 END AS quantity,
        l_extendedprice::DECIMAL(15,2) AS price, l_returnflag AS flag, l_linestatus AS status,
        l_shipdate::DATE AS shipped,
        {_sql_lineage('lineitem_')}
    FROM lineitem, loads
),
hashed AS (SELECT *, {sql_hash(*LINE_COLUMNS)} AS _record_hash FROM raw),{_SQL_BRONZE}"""


def line_hashed(spark: SparkSession, sf_dir: str, piece_bytes: int | None = None) -> DataFrame:
    """The line items with their identity in 32 bytes, as most of what is shuffled of them is that."""
    return hashed(line_raw(spark, sf_dir, piece_bytes), LINE_COLUMNS).withColumn("_record_hash", packed("_record_hash"))


def line_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct line items.  Whole rows are sorted before the shuffle, so the tasks that do it get small pieces."""
    return earliest_copies(line_hashed(spark, sf_dir, PIECE_BYTES))


def line_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(line_hashed(spark, sf_dir))


# --- the Silver entities built from the customer loads -----------------------------------------

SYSTEM = "BANK"

MASTER = MasterKey("golden", "crosswalk", "origin", "local_key", "golden_key", "subject", "account")

#: A customer as an account: `#` stands for no name and `-` for no nation; a nation with a letter is none.
CUSTOMER = Entity(
    "customer",
    "customer",
    ("account_no",),
    (
        Attribute("account_no", "custkey", required=True, type="BIGINT"),
        Attribute("holder", "name", (Trim(), NullIf(("#",)), Upper()), required=True, type="STRING"),
        Attribute("nation", "seat", (NullIf(("-",)), Cast("SMALLINT")), type="SMALLINT"),
        Attribute("segment", "segment", (Trim(), Upper()), type="STRING"),
        Attribute("balance", "balance", type="DECIMAL(15,2)"),
    ),
    MASTER,
)

SEGMENT = Entity(
    name="segment",
    target="segment",
    business_key=("segment_code",),
    attributes=(
        Attribute("segment_code", "segment", (Trim(), Upper()), True, "STRING"),
        Attribute("description", "segment_text", (Trim(),), False, "STRING"),
    ),
)

_VALUE_HASH = sql_hash("account_no", "holder", "nation", "segment", "balance")
_SEGMENT_HASH = sql_hash("segment_code", "description")

# Typed customers with their reasons; a nation with a letter cannot be converted.
SQL_TYPED = f"""
cleaned AS (
    SELECT custkey AS account_no, upper(nullif(trim(name), '#')) AS holder,
        CASE WHEN seat <> '-' THEN try_cast(seat AS SMALLINT) END AS nation,
        seat <> '-' AND try_cast(seat AS SMALLINT) IS NULL AS bad_nation,
        upper(trim(segment)) AS segment, balance, _record_hash, _seen_at, _seen_batch
    FROM records
),
typed AS (
    SELECT *, {_VALUE_HASH} AS _value_hash,
        (account_no IS NULL)::INT + (holder IS NULL)::INT + bad_nation::INT AS n_reasons,
        concat_ws('; ',
            CASE WHEN account_no IS NULL THEN 'account_no: required value is empty' END,
            CASE WHEN holder IS NULL THEN 'holder: required value is empty' END,
            CASE WHEN bad_nation THEN 'nation: value could not be converted' END) AS reasons
    FROM cleaned
),
ties AS (
    SELECT * FROM typed WHERE account_no IS NOT NULL
    QUALIFY rank() OVER (PARTITION BY account_no ORDER BY _seen_at DESC, _seen_batch DESC) = 1
),
latest AS (
    SELECT * FROM ties
    QUALIFY row_number() OVER (PARTITION BY account_no ORDER BY _value_hash, n_reasons, _record_hash) = 1
)"""

SQL_SEGMENTS = f"""
segment_typed AS (
    SELECT upper(trim(segment)) AS segment_code, trim(segment_text) AS description,
        _record_hash, _seen_at, _seen_batch FROM records
),
segment_ties AS (
    SELECT *, {_SEGMENT_HASH} AS _value_hash FROM segment_typed
    QUALIFY rank() OVER (PARTITION BY segment_code ORDER BY _seen_at DESC, _seen_batch DESC) = 1
),
segment_latest AS (
    SELECT * FROM segment_ties
    QUALIFY row_number() OVER (PARTITION BY segment_code ORDER BY _value_hash, _record_hash) = 1
)"""


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of the customers' keys, with other systems and kinds, repeats and gaps in between."""
    key = F.col("c_custkey")
    kinds = F.array(
        *[
            F.struct(F.lit(e).alias("subject"), F.lit(s).alias("origin"), F.lit(p).alias("p"))
            for e, s, p in [
                ("account", "BANK", "G"), ("account", "BANK", "G"), ("account", "SHOP", "S"), ("device", "BANK", "D"),
            ]
        ]
    )
    return (
        table(spark, sf_dir, "customer")
        .select(key, F.explode(kinds).alias("k"))
        .select(
            "k.subject", "k.origin", F.when(key % 7 != 0, key.cast("string")).alias("local_key"),
            F.when(key % 3 != 0, F.concat("k.p", key.cast("string"))).alias("golden_key"),
        )
    )


SQL_CROSSWALK = """
kinds(subject, origin, p) AS (
    VALUES ('account', 'BANK', 'G'), ('account', 'BANK', 'G'), ('account', 'SHOP', 'S'), ('device', 'BANK', 'D')
),
crosswalk AS (
    SELECT subject, origin, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey::VARCHAR END AS local_key,
        CASE WHEN c_custkey % 3 <> 0 THEN p || c_custkey END AS golden_key
    FROM customer, kinds
)"""
