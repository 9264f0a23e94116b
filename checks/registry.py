"""Schema versions, drift, lineage, usage and the checks of column lists."""

from pyspark.sql import functions as F

from checks.base import query, spread_table, sql_canonical, sql_time_text, table, time_text
from sediment.operators.quality import contract_violations
from sediment.operators.registry import (
    clean_edges, columns_json, degrees, neighbors, newest_first, number_versions, register_versions, schema_diff,
    schema_fingerprint, stale_consumers, usage_vs_limit,
)
from sediment.types import normalized_sql_type

# --- versions: every user is a source, every event an observation of its shape ---------------------

_SQL_VERSIONS = """
marked AS (
    SELECT user_id, event_type AS schema_hash, ts, event_id,
        (lag(event_type) OVER w IS DISTINCT FROM event_type)::INT AS opens
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
numbered AS (
    SELECT *, (sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS version FROM marked
),
spans AS (
    SELECT user_id, schema_hash, version, min(ts) AS started, max(ts) AS verified FROM numbered GROUP BY ALL
),
versions AS (
    SELECT *, lead(started) OVER (PARTITION BY user_id ORDER BY version) AS ended FROM spans
)"""


def _observations(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("schema_hash"), F.col("ts").alias("observed_at"),
        F.col("event_id").alias("observation_id"),
    )


def _versions_shown(versions):
    return versions.select(
        "user_id", "schema_hash", "version", time_text("record_start_ts").alias("started"),
        time_text("record_end_ts").alias("ended"), "record_is_active", time_text("last_verified_at").alias("verified"),
    )


_SQL_SHOWN = f"""SELECT user_id, schema_hash, version, {sql_time_text('started')} AS started,
    {sql_time_text('ended')} AS ended, ended IS NULL AS record_is_active, {sql_time_text('verified')} AS verified
    FROM versions"""


@query("scd2_versions", f"WITH {_SQL_VERSIONS} {_SQL_SHOWN}")
def scd2_versions(spark, sf_dir):
    return _versions_shown(register_versions(_observations(spark, sf_dir), ["user_id"]))


@query("scd2_incremental", f"WITH {_SQL_VERSIONS} {_SQL_SHOWN}")
def scd2_incremental(spark, sf_dir):
    """The same table reached in two runs: the later half of the events merged into the versions of the
    first half gives what one run over all of them gives."""
    seen = _observations(spark, sf_dir)
    middle = seen.agg(
        F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(observed_at), max(observed_at)) div 2, min(observed_at))")
    )
    first = seen.where(F.col("observed_at") < middle.scalar())
    second = seen.where(F.col("observed_at") >= middle.scalar())
    current = register_versions(first, ["user_id"])
    return _versions_shown(register_versions(second, ["user_id"], current))


@query(
    "scd2_status",
    f"""WITH {_SQL_VERSIONS} SELECT user_id, event_id, version,
        CASE WHEN opens = 0 THEN 'unchanged' WHEN version = 1 THEN 'created' ELSE 'drifted' END AS status FROM numbered""",
)
def scd2_status(spark, sf_dir):
    return number_versions(_observations(spark, sf_dir), ["user_id"]).select(
        "user_id", F.col("observation_id").alias("event_id"), "version", F.col("_status").alias("status")
    )


@query(
    "scd2_history",
    f"""WITH {_SQL_VERSIONS} SELECT user_id, schema_hash, version, ended IS NULL AS record_is_active,
        row_number() OVER (PARTITION BY user_id ORDER BY version DESC) AS place FROM versions""",
)
def scd2_history(spark, sf_dir):
    """The versions of every source, newest first."""
    versions = register_versions(_observations(spark, sf_dir), ["user_id"])
    return newest_first(versions, ["user_id"]).select("user_id", "schema_hash", "version", "record_is_active", "place")


@query(
    "stale_consumers",
    """WITH versions AS (SELECT o_orderkey AS version_id, 'src' || o_custkey AS source_path,
            o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS active,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders)
    SELECT s_name AS job_name, 'line' || l_linenumber AS table_name, u.version_id AS built_from_id, u.source_path,
        u.version AS built_from_version, c.version_id AS current_id, c.version AS current_version
    FROM lineitem JOIN versions u ON u.version_id = l_orderkey
    JOIN versions c ON c.source_path = u.source_path AND c.active AND c.version_id <> u.version_id
    JOIN supplier ON s_suppkey = l_suppkey""",
)
def stale(spark, sf_dir):
    """Suppliers' jobs built from orders; the last order of a customer is the active version."""
    observed = table(spark, sf_dir, "orders").select(
        F.lit("table").alias("source_type"),
        F.concat(F.lit("src"), "o_custkey").alias("source_path"),
        F.col("o_orderkey").cast("string").alias("schema_hash"),
        F.timestamp_seconds("o_orderkey").alias("observed_at"),
        F.col("o_orderkey").alias("observation_id"),
    )
    versions = register_versions(observed, ["source_type", "source_path"]).select(
        F.col("schema_hash").cast("bigint").alias("version_id"), "source_type", "source_path",
        F.lit(None).cast("string").alias("definition_path"), "version", "record_is_active",
    )
    links = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("consumer_id"), F.concat(F.lit("line"), "l_linenumber").alias("table_name"),
        F.col("l_orderkey").alias("version_id"),
    )
    consumers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("consumer_id"), F.col("s_name").alias("job_name")
    )
    return stale_consumers(consumers, links, versions).select(
        "job_name", "table_name", "built_from_id", "source_path", "built_from_version", "current_id", "current_version"
    )


# --- column lists ----------------------------------------------------------------------------------

# Every order is a table, every line a column of it.
_SQL_INVENTORY = """
inventory AS (
    SELECT l_orderkey AS id, l_linenumber AS ordinal, 'c' || l_linenumber || l_returnflag AS name,
        CASE l_returnflag WHEN 'A' THEN 'decimal(15, 2)' WHEN 'N' THEN 'BIGINT' ELSE ' string' END AS sql_type,
        nullif(l_linestatus, 'O') AS path
    FROM lineitem
)"""


def _inventory(spark, sf_dir):
    flag = F.col("l_returnflag")
    return spread_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("ordinal"),
        F.concat(F.lit("c"), "l_linenumber", flag).alias("name"),
        F.when(flag == "A", "decimal(15, 2)").when(flag == "N", "BIGINT").otherwise(" string").alias("sql_type"),
        F.nullif("l_linestatus", F.lit("O")).alias("path"),
    )


_ONE = f"""sha256(concat_ws('|', ordinal::VARCHAR, {sql_canonical('name')},
    {sql_canonical("upper(regexp_replace(sql_type, '[[:space:]]+', '', 'g'))")}, {sql_canonical('path')}))"""
_PARTS = ", ".join(f"sum(('0x' || substr(one, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(4))


@query(
    "schema_fingerprint",
    f"""WITH {_SQL_INVENTORY}, hashed AS (SELECT id, {_ONE} AS one FROM inventory)
    SELECT id, count(*) AS n_columns, sha256(concat_ws('|', count(*)::VARCHAR, {_PARTS})) AS schema_hash
    FROM hashed GROUP BY id""",
)
def fingerprint(spark, sf_dir):
    return schema_fingerprint(_inventory(spark, sf_dir), ["id"])


@query(
    "column_list_json",
    f"""WITH {_SQL_INVENTORY}
    SELECT id, '[' || string_agg('{{"name":"' || name || '","sql_type":"' || sql_type || '"}}', ','
        ORDER BY ordinal, name, sql_type) || ']' AS columns
    FROM (SELECT DISTINCT id, ordinal, name, sql_type FROM inventory) GROUP BY id""",
)
def column_list(spark, sf_dir):
    return columns_json(_inventory(spark, sf_dir), ["id"])


@query(
    "normalize_sql_types",
    """WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN ' decimal( ' || l_quantity::INT || ', 2)'
            WHEN 'N' THEN 'big int' ELSE 'varchar' END AS sql_type, l_quantity::INT AS p, l_returnflag FROM lineitem)
    SELECT l_orderkey, l_linenumber, sql_type, CASE l_returnflag WHEN 'A' THEN CASE WHEN p BETWEEN 2 AND 38
        THEN 'DECIMAL(' || p || ',2)' END WHEN 'N' THEN 'BIGINT' END AS normalized FROM t""",
)
def normalize_types(spark, sf_dir):
    flag = F.col("l_returnflag")
    text = (
        F.when(flag == "A", F.concat(F.lit(" decimal( "), F.col("l_quantity").cast("int"), F.lit(", 2)")))
        .when(flag == "N", "big int")
        .otherwise("varchar")
    )
    lines = spread_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("sql_type"))
    return lines.withColumn("normalized", normalized_sql_type(F.col("sql_type")))


# Every part is a table; the lines that ship it are its columns, closed lines before, open lines now.
_SQL_SIDE = """SELECT l_partkey AS id, 'c' || l_linenumber AS name, min(l_suppkey % 3)::BIGINT AS ordinal,
    CASE max(l_returnflag) WHEN 'R' THEN 'big int' WHEN 'N' THEN 'BIGINT' ELSE 'STRING' END AS sql_type,
    min(nullif(l_returnflag, 'A')) AS path FROM lineitem"""


@query(
    "schema_diff",
    f"""WITH old AS ({_SQL_SIDE} WHERE l_linestatus = 'F' GROUP BY l_partkey, l_linenumber),
    new AS ({_SQL_SIDE} WHERE l_linestatus = 'O' GROUP BY l_partkey, l_linenumber),
    paired AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name,
        CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
            WHEN upper(replace(o.sql_type, ' ', '')) <> upper(replace(n.sql_type, ' ', '')) THEN 'retyped'
            WHEN o.ordinal <> n.ordinal OR o.path IS DISTINCT FROM n.path THEN 'moved' END AS change,
        o.ordinal AS old_ordinal, n.ordinal AS new_ordinal, o.sql_type AS old_sql_type, n.sql_type AS new_sql_type
        FROM old o FULL JOIN new n ON o.id = n.id AND o.name = n.name)
    SELECT * FROM paired WHERE change IS NOT NULL""",
)
def diff(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")

    def side(status):
        kind = F.max("l_returnflag")
        return (
            lines.where(F.col("l_linestatus") == status)
            .groupBy(F.col("l_partkey").alias("id"), F.concat(F.lit("c"), "l_linenumber").alias("name"))
            .agg(
                F.min(F.col("l_suppkey") % 3).alias("ordinal"),
                F.when(kind == "R", "big int").when(kind == "N", "BIGINT").otherwise("STRING").alias("sql_type"),
                F.min(F.nullif("l_returnflag", F.lit("A"))).alias("path"),
            )
        )

    return schema_diff(side("F"), side("O"), ["id"])


@query(
    "contract_violations",
    """WITH inventory AS (
        SELECT p_brand AS id, p_partkey AS ordinal,
            CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '_') || p_size
                WHEN p_size % 7 = 0 THEN '_Batch_ID' ELSE upper(replace(p_name, ' ', '_')) || p_size END AS name,
            CASE WHEN p_size % 5 = 0 THEN 'decimal(9, 2)' WHEN p_size % 5 = 1 THEN 'decimal(9,12)' ELSE 'string' END AS sql_type,
            CASE WHEN p_size % 2 = 0 THEN 'cobol' ELSE 'csv' END AS source_type,
            CASE WHEN p_size % 4 = 0 THEN p_type WHEN p_size % 4 = 1 THEN p_type || '.' END AS path
        FROM part),
    ruled AS (SELECT *, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]{0,127}') AS named,
        lower(name) IN ('_ingested_at', '_source_file', '_batch_id') AS reserved FROM inventory),
    placed AS (SELECT *, min(ordinal) FILTER (named AND NOT reserved) OVER (PARTITION BY id, lower(name)) AS first FROM ruled)
    SELECT id, ordinal, name, concat_ws(',',
        CASE WHEN NOT named THEN 'name_not_identifier' END,
        CASE WHEN reserved THEN 'name_reserved' END,
        CASE WHEN named AND NOT reserved AND ordinal > first THEN 'name_duplicate' END,
        CASE WHEN sql_type = 'decimal(9,12)' THEN 'type_unsupported' END,
        CASE WHEN sql_type = 'decimal(9, 2)' AND source_type <> 'cobol' THEN 'decimal_outside_cobol' END,
        CASE WHEN path IS NOT NULL AND source_type <> 'cobol' THEN 'path_outside_cobol' END,
        CASE WHEN source_type = 'cobol' AND path IS NOT NULL AND (regexp_matches(path, '[^A-Za-z0-9_ -]')
            OR len(string_split(path, ' ')) > 10) THEN 'path_malformed' END) AS problems
    FROM placed""",
)
def violations(spark, sf_dir):
    size = F.col("p_size")
    plain = F.replace("p_name", F.lit(" "), F.lit("_"))
    inventory = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("id"),
        F.col("p_partkey").alias("ordinal"),
        F.when(size % 3 == 0, F.col("p_name"))
        .when(size % 3 == 1, F.concat(plain, size))
        .when(size % 7 == 0, "_Batch_ID")
        .otherwise(F.concat(F.upper(plain), size))
        .alias("name"),
        F.when(size % 5 == 0, "decimal(9, 2)").when(size % 5 == 1, "decimal(9,12)").otherwise("string").alias("sql_type"),
        F.when(size % 2 == 0, "cobol").otherwise("csv").alias("source_type"),
        F.when(size % 4 == 0, F.split("p_type", " "))
        .when(size % 4 == 1, F.split(F.concat("p_type", F.lit(".")), " "))
        .alias("path"),
    )
    return contract_violations(inventory, ["id"]).select(
        "id", "ordinal", "name", F.array_join("problems", ",").alias("problems")
    )


# --- lineage and usage -------------------------------------------------------------------------------

# Tables: every region, nation, customer, supplier and part.  Lines tie suppliers to parts, and every
# line is an edge, so pairs repeat; regions are also tied to themselves.
_SQL_GRAPH = """
tables AS (
    SELECT 'r' || r_regionkey AS table_id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation
    UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier
    UNION ALL SELECT 'p' || p_partkey FROM part
),
edges AS (
    SELECT DISTINCT * FROM (
        SELECT 'n' || n_nationkey AS downstream, 'r' || n_regionkey AS upstream FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
        UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
        UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region)
    WHERE downstream <> upstream
)"""


def _graph(spark, sf_dir):
    def ids(name, letter, key):
        return table(spark, sf_dir, name).select(F.concat(F.lit(letter), key).alias("table_id"))

    def tie(name, down, down_key, up, up_key):
        source = spread_table if name == "lineitem" else table
        return source(spark, sf_dir, name).select(
            F.concat(F.lit(down), down_key).alias("downstream"), F.concat(F.lit(up), up_key).alias("upstream")
        )

    tables = (
        ids("region", "r", "r_regionkey")
        .unionByName(ids("nation", "n", "n_nationkey"))
        .unionByName(ids("customer", "c", "c_custkey"))
        .unionByName(ids("supplier", "s", "s_suppkey"))
        .unionByName(ids("part", "p", "p_partkey"))
    )
    edges = (
        tie("nation", "n", "n_nationkey", "r", "n_regionkey")
        .unionByName(tie("customer", "c", "c_custkey", "n", "c_nationkey"))
        .unionByName(tie("supplier", "s", "s_suppkey", "n", "s_nationkey"))
        .unionByName(tie("lineitem", "p", "l_partkey", "s", "l_suppkey"))
        .unionByName(tie("region", "r", "r_regionkey", "r", "r_regionkey"))
    )
    return tables, clean_edges(edges)


@query(
    "lineage_degrees",
    f"""WITH {_SQL_GRAPH}
    SELECT table_id, (SELECT count(*) FROM edges WHERE downstream = table_id) AS upstream_count,
        (SELECT count(*) FROM edges WHERE upstream = table_id) AS downstream_count FROM tables""",
)
def lineage_degrees(spark, sf_dir):
    return degrees(*_graph(spark, sf_dir))


@query(
    "lineage_neighbors",
    f"""WITH {_SQL_GRAPH}
    SELECT 's' || s_suppkey AS of_table, upstream AS table_id, 'upstream' AS direction
        FROM supplier JOIN edges ON downstream = 's' || s_suppkey
    UNION ALL SELECT 's' || s_suppkey, downstream, 'downstream' FROM supplier JOIN edges ON upstream = 's' || s_suppkey""",
)
def lineage_neighbors(spark, sf_dir):
    tables, edges = _graph(spark, sf_dir)
    of = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("table_id"))
    return neighbors(tables, edges, of).select("of_table", "table_id", "direction")


@query(
    "usage_vs_limit",
    """WITH tiers AS (SELECT c_mktsegment AS tier, length(c_mktsegment) AS item_limit FROM customer GROUP BY 1)
    SELECT c_custkey AS owner_id, tier, item_limit, count(o_orderkey) AS item_count,
        count(o_orderkey) < item_limit AS can_add
    FROM customer JOIN tiers ON tier = c_mktsegment LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
)
def usage(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    owners = customers.select(F.col("c_custkey").alias("owner_id"), F.col("c_mktsegment").alias("tier"))
    tiers = owners.select("tier").distinct().withColumn("item_limit", F.length("tier"))
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner_id"))
    return usage_vs_limit(owners, items, tiers).select("owner_id", "tier", "item_limit", "item_count", "can_add")
