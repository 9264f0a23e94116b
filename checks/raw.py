"""Scans, lineage, folder loads, mainframe fields and schema discovery.

The sources are files the query writes from a given table into the shared folder and reads back.
"""

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import query, spread_table, table
from checks.loads import START
from sediment.functions import ebcdic
from sediment.functions.names import column_name, slug, table_name
from sediment.functions.rules import allowed
from sediment.operators.projections import flatten_struct, with_lineage
from sediment.plans.raw import load_raw
from sediment.sources.files import MALFORMED, LoadSpec, scan_csv, scan_folder, scan_json, scan_xml
from sediment.sources.fixed import decode_records, layout_schema, read_copybook, record_length, scan_fixed
from sediment.sources.profile import (
    profile_columns, profile_csv, profile_json, profile_json_text, profile_xml,
)
from sediment.sources.xsd import read_xsd
from sediment.staging import staging_folder


def _at(n=0):
    return F.timestamp_seconds(F.lit(START + n * 86400))


def _database(spark):
    name = "raw_" + uuid.uuid4().hex[:12]
    spark.sql(f"CREATE DATABASE {name}")
    return name


def _written(df, how, **options):
    """The folder the DataFrame was written to."""
    folder = staging_folder(df.sparkSession)
    df.write.options(**options).format(how).save(folder)
    return folder


def _schema(ddl, **headers):
    parsed = T.StructType.fromDDL(ddl)
    return T.StructType(
        [T.StructField(f.name, f.dataType, True, {"header": headers[f.name]} if f.name in headers else {}) for f in parsed]
    )


# --- scans -----------------------------------------------------------------------------------------


@query(
    "scan_csv_fixed_schema",
    """SELECT p_partkey, p_name, CASE WHEN p_size = 7 THEN NULL ELSE p_size END AS p_size,
        p_retailprice::DECIMAL(15,2)::VARCHAR AS price, p_size = 7 AS malformed FROM part""",
)
def scan_csv_fixed_schema(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Part Key"),
        F.col("p_name").alias("Name"),
        F.when(F.col("p_size") == 7, "seven").otherwise(F.col("p_size").cast("string")).alias("Size"),
        F.col("p_retailprice").cast("decimal(15,2)").alias("Price"),
    )
    schema = _schema(
        "p_partkey BIGINT, p_name STRING, p_size INT, price DECIMAL(15,2)",
        p_partkey="Part Key", p_name="Name", p_size="Size", price="Price",
    )
    rows = scan_csv(spark, _written(parts, "csv", header=True, sep="|"), schema, delimiter="|")
    return rows.select(
        "p_partkey", "p_name", "p_size", F.col("price").cast("string").alias("price"),
        F.col(MALFORMED).isNotNull().alias("malformed"),
    )


def _nested_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("type")).alias("kind")).alias("user"),
        F.array(F.lit(1), F.col("user_id")).alias("tags"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 2).alias("twice"),
    )


@query(
    "scan_json_flatten",
    """SELECT event_id, user_id AS user_id, event_type AS user_kind_type, '[1,' || user_id || ']' AS tags,
        CASE WHEN event_id % 4 <> 0 THEN event_id * 2 END AS twice FROM events""",
)
def scan_json_flatten(spark, sf_dir):
    path = _written(_nested_events(spark, sf_dir), "json")
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("user_id", T.LongType(), True, {"path": ["user", "id"]}),
            T.StructField("user_kind_type", T.StringType(), True, {"path": ["user", "kind", "type"]}),
            T.StructField("tags", T.StringType()),
            T.StructField("twice", T.LongType()),
        ]
    )
    return scan_json(spark, path, schema).drop(MALFORMED)


@query(
    "flatten_struct",
    """SELECT event_id, user_id AS user_id, event_type AS user_kind_type, '[1,' || user_id || ']' AS tags,
        CASE WHEN event_id % 4 <> 0 THEN event_id * 2 END AS twice FROM events""",
)
def flatten(spark, sf_dir):
    return flatten_struct(_nested_events(spark, sf_dir))


def _supplier_xml(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.col("s_nationkey").alias("nation"),
        F.col("s_acctbal").alias("balance"), (F.col("s_acctbal") > 5000).alias("rich"),
    )
    return _written(suppliers, "xml", rowTag="record", rootTag="suppliers")


_SQL_XML = """SELECT s_suppkey, s_name, s_nationkey AS nation, s_acctbal::DECIMAL(15,2)::VARCHAR AS balance,
    s_acctbal > 5000 AS rich FROM supplier"""


def _xml_rows(spark, sf_dir, schema):
    rows = scan_xml(spark, _supplier_xml(spark, sf_dir), schema).drop(MALFORMED)
    return rows.withColumn("balance", F.col("balance").cast("decimal(15,2)").cast("string"))


@query("scan_xml_rows", _SQL_XML)
def scan_xml_rows(spark, sf_dir):
    return _xml_rows(spark, sf_dir, _schema("s_suppkey BIGINT, s_name STRING, nation INT, balance DOUBLE, rich BOOLEAN"))


_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:simpleType name="Money"><xs:restriction base="xs:decimal"><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="Balance"><xs:restriction base="Money"/></xs:simpleType>
  <xs:group name="standing"><xs:choice>
    <xs:element name="balance" type="Balance"/>
    <xs:element name="debt" type="Balance"/>
  </xs:choice></xs:group>
  <xs:complexType name="Named"><xs:all>
    <xs:element name="s_suppkey" type="xs:long"/>
    <xs:element name="s_name" type="xs:string"/>
  </xs:all></xs:complexType>
  <xs:complexType name="Supplier"><xs:complexContent><xs:extension base="Named"><xs:sequence>
    <xs:element name="nation" type="xs:short"/>
    <xs:group ref="standing"/>
    <xs:sequence minOccurs="0"><xs:element name="rich" type="xs:boolean"/></xs:sequence>
  </xs:sequence></xs:extension></xs:complexContent></xs:complexType>
  <xs:element name="suppliers"><xs:complexType><xs:sequence>
    <xs:element name="record" type="Supplier" maxOccurs="unbounded"/>
  </xs:sequence></xs:complexType></xs:element>
</xs:schema>"""


@query("scan_xml_by_xsd", _SQL_XML)
def scan_xml_by_xsd(spark, sf_dir):
    """Rows by a schema with an extension, a group, a choice and an optional sequence."""
    rows = _xml_rows(spark, sf_dir, read_xsd(_XSD))
    return rows.where(F.col("debt").isNull()).drop("debt")


_ORDER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:group name="line"><xs:sequence>
    <xs:element name="number" type="xs:int"/>
    <xs:element name="flag" type="xs:string" minOccurs="0"/>
  </xs:sequence></xs:group>
  <xs:element name="record"><xs:complexType><xs:sequence>
    <xs:element name="l_orderkey" type="xs:long"/>
    <xs:choice><xs:element name="few" type="xs:boolean"/><xs:element name="many" type="xs:boolean"/></xs:choice>
    <xs:group ref="line" maxOccurs="unbounded"/>
  </xs:sequence></xs:complexType></xs:element>
</xs:schema>"""


@query(
    "scan_xml_repeated",
    """SELECT l_orderkey, CASE WHEN count(*) < 4 THEN true END AS few, CASE WHEN count(*) >= 4 THEN true END AS many,
        '[' || string_agg(l_linenumber, ',' ORDER BY l_linenumber) || ']' AS number,
        '["' || string_agg(l_returnflag, '","' ORDER BY l_linenumber, l_returnflag) FILTER (l_returnflag <> 'N') || '"]' AS flag
    FROM lineitem GROUP BY l_orderkey""",
)
def scan_xml_repeated(spark, sf_dir):
    """Children that a row has several times: all their values, whether the row has one or many."""
    line = F.struct("l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    flags = F.filter("lines.flag", lambda x: x.isNotNull())
    rows = orders.select(
        "l_orderkey", F.when(F.size("lines") < 4, True).alias("few"), F.when(F.size("lines") >= 4, True).alias("many"),
        F.col("lines.l_linenumber").alias("number"), F.when(F.size(flags) > 0, flags).alias("flag"),
    )
    path = _written(rows, "xml", rowTag="record", rootTag="orders")
    return scan_xml(spark, path, read_xsd(_ORDER_XSD)).drop(MALFORMED)


# --- lineage, appends, folders -----------------------------------------------------------------------


@query(
    "with_lineage",
    f"""SELECT o_orderkey, o_orderstatus, {START * 1000000} AS ingested_us, 'orders.dat' AS _source_file, 'L1' AS _batch_id
    FROM orders""",
)
def lineage(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return with_lineage(rows, "L1", _at(), "orders.dat").select(
        "o_orderkey", "o_orderstatus", F.unix_micros("_ingested_at").alias("ingested_us"), "_source_file", "_batch_id"
    )


@query(
    "lineage_from_scan",
    """SELECT l_orderkey, l_linenumber, 'lineitem.parquet' AS file_name, 'L1' AS _batch_id FROM lineitem""",
)
def lineage_from_scan(spark, sf_dir):
    """The file of a row comes from the scan, below a projection."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return with_lineage(rows, "L1", _at()).select(
        "l_orderkey", "l_linenumber", F.element_at(F.split("_source_file", "/"), -1).alias("file_name"), "_batch_id"
    )


@query(
    "raw_append_twice",
    f"""SELECT c_custkey, c_name, batch AS _batch_id, {START * 1000000} + day * 86400000000 AS ingested_us
    FROM customer, (VALUES ('L1', 0), ('L2', 1)) AS l(batch, day)""",
)
def raw_append_twice(spark, sf_dir):
    """The same file loaded twice: duplicates stay."""
    name = f"{_database(spark)}.customer"
    folder = _written(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "csv", header=True)
    for n in (0, 1):
        at = datetime.fromtimestamp(START + n * 86400, timezone.utc)
        load_raw(spark, LoadSpec(folder, "csv", _schema("c_custkey BIGINT, c_name STRING")), name, batch_id=f"L{n + 1}", at=at)
    return spark.table(name).select("c_custkey", "c_name", "_batch_id", F.unix_micros("_ingested_at").alias("ingested_us"))


@query(
    "raw_load_report",
    """SELECT 'L1' AS _batch_id, count(*) AS rows_read, count(*) AS rows_written,
        count(*) FILTER (o_orderstatus = 'P') AS rows_malformed, count(o_custkey) - count(*) FILTER (o_orderstatus = 'P')
        AS customers FROM orders""",
)
def raw_load_report(spark, sf_dir):
    """One CSV load: what came in, what does not fit the schema, what is in the table."""
    source = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "n/k").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        "o_orderpriority",
    )
    schema = _schema("o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING")
    name = f"{_database(spark)}.orders"
    report = load_raw(spark, LoadSpec(_written(source, "csv", header=True), "csv", schema), name, batch_id="L1")
    return spark.table(name).groupBy("_batch_id").agg(
        *[F.lit(report[n]).cast("bigint").alias(n) for n in ("rows_read", "rows_written", "rows_malformed")], F.count("o_custkey").alias("customers"),
    )


@query(
    "load_folder_per_file",
    """SELECT o_orderpriority, count(*) AS rows, sum(o_custkey)::BIGINT AS customers, true AS named FROM orders GROUP BY 1""",
)
def load_folder_per_file(spark, sf_dir):
    """A folder of files with one schema in one scan; every file names its table."""
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    schema = _schema("o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING")
    rows = scan_folder(spark, _written(source, "csv", header=True), "csv", schema)
    return rows.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("o_custkey").alias("customers"),
        F.bool_and(allowed("identifier", F.col("_table"))).alias("named"),
    )


# --- names -------------------------------------------------------------------------------------------


@query(
    "normalize_names",
    """WITH n AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN ' ' || p_size || ' ' || p_name || '.'
            WHEN p_size % 4 = 1 THEN upper(p_name) || '-(' || p_size || ')' WHEN p_size % 4 = 2 THEN '_' || p_name ELSE '!?' END
            AS title FROM part),
    t AS (SELECT *, trim(regexp_replace(lower(trim(title)), '[^0-9a-z_]', '_', 'g'), '_') AS plain,
        trim(regexp_replace(title, '[^A-Za-z0-9_.-]+', '_', 'g'), '._-') AS short FROM n)
    SELECT p_partkey, CASE WHEN plain = '' THEN 'table' WHEN plain SIMILAR TO '[0-9].*' THEN 't_' || plain ELSE plain END AS table_name,
        regexp_replace(trim(title), '[. ]', '_', 'g') AS column_name, CASE WHEN short = '' THEN 'pipeline' ELSE short END AS slug
    FROM t""",
)
def normalize_names(spark, sf_dir):
    size = F.col("p_size")
    title = (
        F.when(size % 4 == 0, F.concat(F.lit(" "), size, F.lit(" "), "p_name", F.lit(".")))
        .when(size % 4 == 1, F.concat(F.upper("p_name"), F.lit("-("), size, F.lit(")")))
        .when(size % 4 == 2, F.concat(F.lit("_"), "p_name"))
        .otherwise("!?")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    text = F.col("title")
    return parts.select(
        "p_partkey", table_name(text).alias("table_name"), column_name(text).alias("column_name"), slug(text).alias("slug")
    )


@query(
    "text_rules",
    r"""SELECT page_id, regexp_full_match(url, '[A-Za-z_][A-Za-z0-9_]{0,127}') AS identifier,
        regexp_full_match(url, '[A-Za-z0-9 _./+:@#-]{0,64}') AS simple_text, false AS path,
        length(path) <= 2048 AND NOT regexp_matches(path, '["''`\\${}]') AND NOT list_contains(string_split(path, '/'), '..') AS good_path,
        length(url) <= 255 AND NOT contains(url, '/') AS file_name
    FROM (SELECT *, '/' || url AS path FROM pages)""",
)
def text_rules(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", allowed("identifier", url).alias("identifier"), allowed("simple_text", url).alias("simple_text"),
        allowed("path", url).alias("path"), allowed("path", F.concat(F.lit("/"), url)).alias("good_path"),
        allowed("file_name", url).alias("file_name"),
    )


# --- mainframe fields ----------------------------------------------------------------------------------


def _money(name):
    return F.round(F.col(name) * 100).cast("bigint")


@query(
    "decode_comp",
    """SELECT l_orderkey, l_linenumber, (l_partkey % 20000 - 10000)::INT AS half, (l_suppkey - 50)::INT AS word,
        -l_orderkey * 1000003 AS long, round(l_extendedprice * 100)::BIGINT / 100 AS price_check FROM lineitem""",
)
def decode_comp(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        ebcdic.encode_comp((F.col("l_partkey") % 20000 - 10000).cast("int"), 2).alias("half"),
        ebcdic.encode_comp(F.col("l_suppkey") - 50, 4).alias("word"),
        ebcdic.encode_comp(-F.col("l_orderkey") * 1000003, 8).alias("long"),
        ebcdic.encode_comp(_money("l_extendedprice"), 8).alias("price"),
    )
    return lines.select(
        "l_orderkey", "l_linenumber",
        ebcdic.decode_comp(F.col("half"), 2, 4).alias("half"),
        ebcdic.decode_comp(F.col("word"), 4, 9).alias("word"),
        ebcdic.decode_comp(F.col("long"), 8, 18).alias("long"),
        ebcdic.decode_comp(F.col("price"), 8, 18, 2).cast("double").alias("price_check"),
    )


_SQL_SIGNED = """(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_extendedprice)::DECIMAL(9,2)::VARCHAR AS price,
    l_quantity::INT AS quantity"""


def _signed_cents():
    return F.when(F.col("l_returnflag") == "R", -_money("l_extendedprice")).otherwise(_money("l_extendedprice"))


@query("decode_comp3", f"SELECT l_orderkey, l_linenumber, {_SQL_SIGNED}, true AS refused FROM lineitem")
def decode_comp3(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem")
    raw = lines.select(
        "l_orderkey", "l_linenumber",
        ebcdic.encode_comp3(_signed_cents(), 9).alias("price"),
        ebcdic.encode_comp3(F.col("l_quantity").cast("bigint"), 4).alias("quantity"),
    )
    return raw.select(
        "l_orderkey", "l_linenumber",
        ebcdic.decode_comp3(F.col("price"), 9, 2).cast("string").alias("price"),
        ebcdic.decode_comp3(F.col("quantity"), 4).alias("quantity"),
        ebcdic.decode_comp3(F.concat(F.unhex(F.lit("AB")), F.col("price")), 11).isNull().alias("refused"),
    )


@query("decode_zoned", f"SELECT l_orderkey, l_linenumber, {_SQL_SIGNED}, true AS refused FROM lineitem")
def decode_zoned(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem")
    raw = lines.select(
        "l_orderkey", "l_linenumber",
        ebcdic.encode_zoned(_signed_cents(), 9).alias("price"),
        ebcdic.encode_zoned(F.col("l_quantity").cast("bigint"), 4, signed=False).alias("quantity"),
    )
    return raw.select(
        "l_orderkey", "l_linenumber",
        ebcdic.decode_zoned(F.col("price"), 9, 2).cast("string").alias("price"),
        ebcdic.decode_zoned(F.col("quantity"), 4, signed=False).alias("quantity"),
        ebcdic.decode_zoned(F.concat(F.unhex(F.lit("40")), F.col("quantity")), 5).isNull().alias("refused"),
    )


_COPYBOOK = """
      * An account as a mainframe would write it.
       01  ACCOUNT.
           05  C-CUSTKEY             PIC 9(8).
           05  OWNER.
               10  C-NAME            PIC X(25).
               10  C-MKTSEGMENT      PIC X(12).
               88  IS-BUILDING       VALUE 'BUILDING'.
           05  C-ACCTBAL             PIC S9(9)V99 COMP-3.
           05  OWED                  PIC S9(7)V99.
           05  HOME.
               10  C-NATIONKEY       PIC S9(4) USAGE IS COMP.
           05  MARK                  PIC X(2) OCCURS 2 TIMES.
           05  ENTRY OCCURS 2 TIMES.
               10  SIDE              PIC X.
               10  AMOUNT            PIC S9(9)V99 COMP-3.
           05  FILLER                PIC X(10).
"""
_BLANK = "@"  # in code page 037 a blank is what "@" is in ASCII


def _account_records(spark, sf_dir):
    """Customers as binary records of the copybook's layout."""
    cents = _money("c_acctbal")
    return spread_table(spark, sf_dir, "customer").select(
        F.concat(
            ebcdic.encode_zoned(F.col("c_custkey"), 8, signed=False),
            ebcdic.encode_text(F.concat("c_name", F.lit("é!")), 25),
            ebcdic.encode_text(F.col("c_mktsegment"), 12),
            ebcdic.encode_comp3(cents, 11),
            ebcdic.encode_zoned(-cents, 9),
            ebcdic.encode_comp(F.col("c_nationkey") - 12, 2),
            ebcdic.encode_text(F.left("c_mktsegment", F.lit(2)), 2),
            ebcdic.encode_text(F.lit("x"), 2),
            ebcdic.encode_text(F.lit("D"), 1), ebcdic.encode_comp3(cents, 11),
            ebcdic.encode_text(F.lit("C"), 1), ebcdic.encode_comp3(-cents, 11),
            ebcdic.encode_text(F.lit(""), 10),
        ).alias("value")
    )


_SQL_RECORDS = """SELECT c_custkey::INT AS C_CUSTKEY, c_name || 'é!' AS OWNER_C_NAME,
    c_mktsegment AS OWNER_C_MKTSEGMENT, c_acctbal::DECIMAL(11,2)::VARCHAR AS C_ACCTBAL,
    (-c_acctbal)::DECIMAL(9,2)::VARCHAR AS OWED, (c_nationkey - 12)::INT AS HOME_C_NATIONKEY,
    '["' || left(c_mktsegment, 2) || '","x"]' AS MARK,
    '[{"SIDE":"D","AMOUNT":' || c_acctbal::DECIMAL(11,2) || '},{"SIDE":"C","AMOUNT":' || (-c_acctbal)::DECIMAL(11,2) || '}]' AS ENTRY
    FROM customer"""


def _shown_records(rows, layout):
    return rows.select(*[
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in layout_schema(layout)
    ])


@query("scan_fixed_ebcdic", _SQL_RECORDS)
def scan_fixed_ebcdic(spark, sf_dir):
    layout = read_copybook(_COPYBOOK)
    assert record_length(layout) == 8 + 25 + 12 + 6 + 9 + 2 + 4 + 14 + 10
    return _shown_records(decode_records(_account_records(spark, sf_dir), layout), layout)


def _binary_file(records):
    """Records one after the other in files; each ends with a blank, which is what stands between lines here."""
    folder = staging_folder(records.sparkSession)
    short = records.select(F.expr("cast(substring(value, 1, octet_length(value) - 1) as string)").alias("value"))
    short.write.option("lineSep", _BLANK).text(folder)
    return folder


@query("scan_fixed_file", _SQL_RECORDS)
def scan_fixed_file(spark, sf_dir):
    """Records of one length, read from files."""
    layout = read_copybook(_COPYBOOK)
    return _shown_records(scan_fixed(spark, _binary_file(_account_records(spark, sf_dir)), layout), layout)


@query("scan_fixed_sequence", _SQL_RECORDS)
def scan_fixed_sequence(spark, sf_dir):
    """Records of several lengths behind their lengths, read from files: some end before their last blanks."""
    layout = read_copybook(_COPYBOOK)
    records = _account_records(spark, sf_dir).select(
        F.expr("substring(value, 1, octet_length(value) - pmod(crc32(value), 10))").alias("value")
    )
    header = F.unhex(F.concat(F.lpad(F.hex(F.octet_length("value")), 4, "0"), F.lit("0000")))
    folder = _binary_file(records.select(F.concat(header, F.col("value")).alias("value")))
    return _shown_records(scan_fixed(spark, folder, layout, is_record_sequence=True, big_endian=True), layout)


_CLAUSES_COPYBOOK = """
       01  BILL.
           05  C-CUSTKEY             PIC 9(8) VALUE ZERO COMP-3.
           05  MARK                  PIC X(9) VALUE 'none. yet'.
           05  AMOUNTS COMP-3.
               10  C-ACCTBAL         PIC S9(9)V99.
               10  OWED              VALUE 0 PIC S9(9)V99.
           05  BALANCE               SIGN IS LEADING SEPARATE CHARACTER
                                     PIC S9(9)V99.
           05  CHANGE                PIC S9(9)V99 TRAILING SEPARATE.
           05  PLACE                 PIC X(6).
           05  PLACE-PARTS REDEFINES PLACE.
               10  C-NATIONKEY       PIC 9(2).
               10  SEGMENT           PIC X(4).
           05  RATE                  USAGE COMP-1.
           05  N-NOTES               PIC 9.
           05  NOTE                  OCCURS 0 TO 3 TIMES DEPENDING ON
                                     N-NOTES INDEXED BY I, J.
               10  KIND              PIC X.
               10  AMOUNT            PIC S9(5) COMP-3.
           05  SHOWN                 PIC ZZ9.99-.
           05  PIC X.
"""

_SQL_CLAUSES = """SELECT c_custkey::INT AS C_CUSTKEY, 'a. "b' AS MARK, c_acctbal::DECIMAL(11,2)::VARCHAR AS AMOUNTS_C_ACCTBAL,
    (-c_acctbal)::DECIMAL(11,2)::VARCHAR AS AMOUNTS_OWED, c_acctbal::DECIMAL(11,2)::VARCHAR AS BALANCE, (-c_acctbal)::DECIMAL(11,2)::VARCHAR AS CHANGE,
    lpad(c_nationkey::VARCHAR, 2, '0') || c_mktsegment[1:4] AS PLACE, c_nationkey::INT AS PLACE_PARTS_C_NATIONKEY,
    c_mktsegment[1:4] AS PLACE_PARTS_SEGMENT, (c_nationkey - 12)::FLOAT AS RATE, (c_custkey % 4)::INT AS N_NOTES,
    '[' || array_to_string(list_transform(range(1, c_custkey % 4 + 1), lambda i: '{"KIND":"' || i || '","AMOUNT":' || (c_nationkey - 12) * i || '}'), ',') || ']' AS NOTE,
    '  ' || (c_custkey % 10) || '.50-' AS SHOWN FROM customer"""


def _bills(spark, sf_dir, room_for):
    """Customers as records of the copybook; `room_for` notes of each record's number of them take room."""
    cents, nation = _money("c_acctbal"), F.col("c_nationkey") - 12
    digits = ebcdic.encode_zoned(F.abs(cents), 11, signed=False)
    plus, minus = F.unhex(F.when(cents < 0, "60").otherwise("4E")), F.unhex(F.when(cents > 0, "60").otherwise("4E"))
    head = F.hex(F.when(nation < 0, 0xC6).otherwise(0x46))  # six hexadecimal places before the point
    notes = [F.concat(ebcdic.encode_text(F.lit(str(i)), 1), ebcdic.encode_comp3(nation * i, 5)) for i in (1, 2, 3)]
    taken = [F.when(room_for(F.col("c_custkey") % 4) >= i, note).otherwise(F.unhex(F.lit(""))) for i, note in enumerate(notes, 1)]
    return spread_table(spark, sf_dir, "customer").select(
        F.concat(
            ebcdic.encode_comp3(F.col("c_custkey"), 8), ebcdic.encode_text(F.lit('a. "b'), 9), ebcdic.encode_comp3(cents, 11), ebcdic.encode_comp3(-cents, 11),
            plus, digits, digits, minus, ebcdic.encode_zoned(F.col("c_nationkey"), 2, signed=False), ebcdic.encode_text(F.col("c_mktsegment"), 4),
            F.unhex(F.concat(head, F.lpad(F.hex(F.abs(nation)), 6, "0"))), ebcdic.encode_zoned(F.col("c_custkey") % 4, 1, signed=False), *taken,
            ebcdic.encode_text(F.concat(F.lit("  "), F.col("c_custkey") % 10, F.lit(".50-")), 7), ebcdic.encode_text(F.lit(""), 1),
        ).alias("value")
    )


@query("scan_fixed_clauses", _SQL_CLAUSES)
def scan_fixed_clauses(spark, sf_dir):
    """Clauses in any order, a group's usage, separate signs, alternatives, floats; a table that takes the room of its most entries."""
    layout = read_copybook(_CLAUSES_COPYBOOK)
    return _shown_records(decode_records(_bills(spark, sf_dir, lambda n: F.lit(3)), layout), layout)


@query("scan_fixed_variable", _SQL_CLAUSES)
def scan_fixed_variable(spark, sf_dir):
    """The same with a table that takes the room of the entries it has, in records behind their lengths."""
    layout = read_copybook(_CLAUSES_COPYBOOK, variable_size_occurs=True)
    records = _bills(spark, sf_dir, lambda n: n)
    header = F.unhex(F.concat(F.lpad(F.hex(F.octet_length("value")), 4, "0"), F.lit("0000")))
    folder = _binary_file(records.select(F.concat(header, F.col("value")).alias("value")))
    return _shown_records(scan_fixed(spark, folder, layout, is_record_sequence=True, big_endian=True), layout)


# Bytes as manuals print them, with what they mean.
_KNOWN_BYTES = [
    ("F0F0C3", 3, "7FFF", 32767, "12345C", 12345, "C885939396", "Hello"), ("F4F5D6", -456, "FF85", -123, "00987D", -987, "C14B405A", "A. !"),
    ("F1F2F3", 123, "0000", 0, "00001F", 1, "F1F2615BF9", "12/$9"), ("F9F9D0", -990, "8000", -32768, "99999D", -99999, "D9A28140", "Rsa"),
    ("F0F0D0", 0, "0101", 257, "00000C", 0, "6C50C2F0", "%&B0"),
]


@query(
    "decode_known_bytes",
    "SELECT n_nationkey, zoned, comp, comp3, text FROM nation JOIN (VALUES "
    + ", ".join(f"({i}, {z}, {c}, {d}, '{t}')" for i, (_, z, _, c, _, d, _, t) in enumerate(_KNOWN_BYTES))
    + ") AS v(i, zoned, comp, comp3, text) ON n_nationkey % 5 = i",
)
def decode_known_bytes(spark, sf_dir):
    """Each nation gets one of the known rows of bytes."""
    known = F.array(*[F.struct(*[F.unhex(F.lit(b)).alias(n) for n, b in zip("zcdt", row[::2])]) for row in _KNOWN_BYTES])
    rows = table(spark, sf_dir, "nation").withColumn("b", F.get(known, F.col("n_nationkey") % 5))
    return rows.select(
        "n_nationkey",
        ebcdic.decode_zoned(F.col("b.z"), 3).cast("int").alias("zoned"), ebcdic.decode_comp(F.col("b.c"), 2, 4).cast("int").alias("comp"),
        ebcdic.decode_comp3(F.col("b.d"), 5).cast("int").alias("comp3"), ebcdic.decode_text(F.col("b.t")).alias("text"),
    )


_TEXT_COPYBOOK = """
       01  ORDER-RECORD.
           05  ORD-ID                PIC 9(10).
           05  ORD-STATUS            PIC X(3).
           05  ORD-TOTAL             PIC S9(9)V99.
"""


@query(
    "scan_fixed_text",
    """SELECT o_orderkey AS ORD_ID, o_orderstatus AS ORD_STATUS,
        (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_totalprice)::DECIMAL(11,2)::VARCHAR AS ORD_TOTAL FROM orders""",
)
def scan_fixed_text(spark, sf_dir):
    """Lines of display digits; negative totals carry an overpunched last digit."""
    cents = _money("o_totalprice")
    digits = F.lpad(cents.cast("string"), 11, "0")
    punched = F.concat(
        F.left(digits, F.lit(10)),
        F.translate(F.right(digits, F.lit(1)), "0123456789", ebcdic.OVERPUNCH_MINUS),
    )
    lines = table(spark, sf_dir, "orders").select(
        F.concat(
            F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.rpad("o_orderstatus", 3, " "),
            F.when(F.col("o_orderstatus") == "F", punched).otherwise(digits),
        ).alias("value")
    )
    rows = scan_fixed(spark, _written(lines, "text"), read_copybook(_TEXT_COPYBOOK), is_text=True)
    return rows.withColumn("ORD_TOTAL", F.col("ORD_TOTAL").cast("string"))


# --- discovery -------------------------------------------------------------------------------------------

_INT, _NUM = r"^\s*[+-]?[0-9]+\s*$", r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _sql_profile(columns):
    """The profile of text expressions in SQL, by patterns instead of casts."""
    rows = [
        f"""SELECT {i}::INT AS ordinal, '{name}' AS name, CASE
            WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'BOOLEAN' WHEN bool_and(regexp_matches(v, '{_INT}')) THEN 'BIGINT'
            WHEN bool_and(regexp_matches(v, '{_NUM}')) THEN 'DOUBLE' ELSE 'STRING' END AS sql_type,
            count(v) < count(*) AS nullable FROM (SELECT {expr} AS v FROM src)"""
        for i, (name, expr) in enumerate(columns.items())
    ]
    return " UNION ALL ".join(rows)


_ORDER_TEXTS = {
    "o_orderkey": "o_orderkey::VARCHAR", "cust": "CASE WHEN o_orderstatus <> 'P' THEN o_custkey::VARCHAR END",
    "total": "o_totalprice::VARCHAR", "open": "CASE WHEN o_orderstatus = 'O' THEN 'TRUE' ELSE 'false' END",
    "mixed": "CASE WHEN o_orderkey = 3 THEN '1.5f' ELSE o_custkey::VARCHAR END", "priority_text": "o_orderpriority",
}


def _order_texts(spark, sf_dir):
    status = F.col("o_orderstatus")
    return spread_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(status != "P", F.col("o_custkey").cast("string")).alias("cust"),
        F.col("o_totalprice").cast("string").alias("total"),
        F.when(status == "O", "TRUE").otherwise("false").alias("open"),
        F.when(F.col("o_orderkey") == 3, "1.5f").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
        F.col("o_orderpriority").alias("priority text"),
    )


@query("profile_columns", f"WITH src AS (SELECT * FROM orders) {_sql_profile(_ORDER_TEXTS)}")
def profile(spark, sf_dir):
    return profile_columns(_order_texts(spark, sf_dir))


@query("profile_csv", f"WITH src AS (SELECT * FROM orders) {_sql_profile(_ORDER_TEXTS)}")
def profile_csv_files(spark, sf_dir):
    path = _written(_order_texts(spark, sf_dir), "csv", header=True)
    return profile_csv(spark, path)


_BIG_TEXTS = {
    "l_orderkey": "l_orderkey::VARCHAR", "l_quantity": "l_quantity::VARCHAR", "l_extendedprice": "l_extendedprice::VARCHAR",
    "l_returnflag": "nullif(l_returnflag, 'A')", "l_linestatus": "l_linestatus", "l_linenumber": "l_linenumber::VARCHAR",
}


@query("profile_lineitem", f"WITH src AS (SELECT * FROM lineitem) {_sql_profile(_BIG_TEXTS)}")
def profile_lineitem(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem")
    texts = [F.col(c).cast("string").alias(c) for c in _BIG_TEXTS if c != "l_returnflag"]
    texts.insert(3, F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"))
    return profile_columns(lines.select(*texts))


@query(
    "profile_folder",
    """WITH src AS (SELECT * FROM orders)
    SELECT o_orderstatus, 'cust' AS name, 'BIGINT' AS sql_type, false AS nullable FROM src GROUP BY 1
    UNION ALL SELECT o_orderstatus, 'text', CASE WHEN o_orderstatus = 'F' THEN 'DOUBLE' ELSE 'STRING' END, o_orderstatus = 'O'
        FROM src GROUP BY 1""",
)
def profile_by_folder(spark, sf_dir):
    """Sub-folders that hold the files of one table each, profiled in one pass."""
    status = F.col("o_orderstatus")
    source = table(spark, sf_dir, "orders").select(
        "o_orderstatus",
        F.col("o_custkey").alias("cust"),
        F.when(status == "F", F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
        .when((status == "P") | (F.col("o_custkey") % 2 == 0), F.col("o_orderpriority"))
        .alias("text"),
    )
    folder = staging_folder(spark)
    source.write.partitionBy("o_orderstatus").option("header", True).csv(folder)
    rows = spark.read.option("header", True).csv(folder)
    return profile_columns(rows, by="o_orderstatus").drop("ordinal")


_SQL_JSON_PROFILE = """SELECT name, sql_type, nullable, path FROM (VALUES
    ('event_id', 'BIGINT', false, 'event_id'), ('user_id', 'BIGINT', false, 'user.id'),
    ('user_kind_type', 'STRING', false, 'user.kind.type'), ('tags', 'STRING', false, 'tags'),
    ('twice', 'BIGINT', (SELECT bool_or(event_id % 4 = 0) FROM events), 'twice')) AS p(name, sql_type, nullable, path)"""


@query("profile_json_paths", _SQL_JSON_PROFILE)
def profile_json_files(spark, sf_dir):
    return profile_json(spark, _written(_nested_events(spark, sf_dir), "json")).drop("ordinal")


@query(
    "profile_json_text",
    """SELECT 'k' AS name, CASE WHEN bool_and(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) THEN 'BIGINT' ELSE 'STRING' END
        AS sql_type, count(*) <> count(json_extract(props, '$.k')) AS nullable, 'k' AS path FROM events""",
)
def profile_props(spark, sf_dir):
    return profile_json_text(table(spark, sf_dir, "events"), "props").drop("ordinal")


@query(
    "profile_xml",
    "WITH src AS (SELECT * FROM supplier) SELECT * EXCLUDE (ordinal) FROM ("
    + _sql_profile(
        {
            "s_suppkey": "s_suppkey::VARCHAR", "s_name": "s_name", "nation": "s_nationkey::VARCHAR",
            "balance": "s_acctbal::VARCHAR", "rich": "(s_acctbal > 5000)::VARCHAR",
        }
    )
    + ")",
)
def profile_xml_rows(spark, sf_dir):
    return profile_xml(spark, _supplier_xml(spark, sf_dir)).drop("ordinal")
