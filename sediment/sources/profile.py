"""Schema discovery: the type and nullability of every column of a source, in one pass over it."""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.names import column_name, column_name_of, table_name
from sediment.operators.projections import leaves
from sediment.sources.files import MALFORMED, listed_files, scan_xml, scanned_name
from sediment.types import col, parse_sql_type, quoted, sql_type_of

PROFILE = "ordinal int, name string, sql_type string, nullable boolean"

# Texts of a CSV cell that mean "no value".
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _sampled(df: DataFrame, sample_rows: int | None) -> DataFrame:
    return df if sample_rows is None else df.limit(sample_rows)


def _present(text: Column, missing: tuple[str, ...]) -> Column:
    return F.when(~text.isin(*missing), text) if missing else text


# Casts of texts that are no numbers are costly, so a pattern decides first.
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)\s*$"


def _is_whole(text: Column) -> Column:
    return F.when(text.rlike(_WHOLE), (F.length(text) <= 18) | text.try_cast("bigint").isNotNull())


def _is_number(text: Column) -> Column:
    return text.rlike(_NUMBER)


def _is_boolean(text: Column) -> Column:
    return F.lower(text).isin("true", "false")


def type_counts(text: Column, missing: tuple[str, ...] = MISSING) -> Column:
    """Aggregate of a text column: how many values there are, and how many fit each type."""
    value = _present(text, missing)
    return F.struct(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("present"),
        F.count_if(_is_boolean(value)).alias("booleans"),
        F.count_if(_is_whole(value)).alias("wholes"),
        F.count_if(_is_number(value)).alias("numbers"),
    )


def type_of_counts(counts: Column) -> Column:
    """The narrowest type all present values fit.  A column without any value is DOUBLE, as all of its
    (zero) values are numbers."""
    present = counts["present"]
    return (
        F.when((present > 0) & (counts["booleans"] == present), "BOOLEAN")
        .when((present > 0) & (counts["wholes"] == present), "BIGINT")
        .when(counts["numbers"] == present, "DOUBLE")
        .otherwise("STRING")
    )


def _profile_row(ordinal: int, name: str, counts: Column) -> Column:
    return F.struct(
        F.lit(ordinal).alias("ordinal"),
        F.lit(name).alias("name"),
        type_of_counts(counts).alias("sql_type"),
        (counts["present"] < counts["n"]).alias("nullable"),
    )


def profile_columns(
    df: DataFrame,
    *,
    sample_rows: int | None = None,
    by: str | None = None,
    missing: tuple[str, ...] = MISSING,
) -> DataFrame:
    """One row per text column: position, name, type and whether a value was missing.

    All columns are measured by one aggregate of counters, over all rows.  `by` profiles each value of a
    column (the file of a folder) on its own.  `sample_rows` reads the head only, which can miss what comes
    later; it would miss whole groups, so it does not go together with `by`.
    """
    if by and sample_rows is not None:
        raise ValueError("a sample of rows says nothing about each group")
    names = [c for c in df.columns if c != by]
    rows = _sampled(df, sample_rows)
    measures = [type_counts(col(c).cast("string"), missing).alias(f"c{i}") for i, c in enumerate(names)]
    measured = rows.groupBy(col(by)).agg(*measures) if by else rows.agg(*measures)
    listed = F.array(
        *[_profile_row(i, column_name_of(c), F.col(f"c{i}")) for i, c in enumerate(names)]
    )
    keys = [col(by)] if by else []
    return measured.select(*keys, F.inline(listed))


def _texts(spark: SparkSession, path, header: bool, delimiter: str) -> DataFrame:
    """A CSV source with every column as text, headerless columns named col_0, col_1 ..."""
    df = spark.read.option("header", header).option("sep", delimiter).option("inferSchema", False).csv(path)
    return df if header else df.toDF(*[f"col_{i}" for i in range(len(df.columns))])


def profile_csv(
    spark: SparkSession, path, *, header: bool = True, delimiter: str = ",", sample_rows: int | None = None
) -> DataFrame:
    return profile_columns(_texts(spark, path, header, delimiter), sample_rows=sample_rows)


def _flat_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DecimalType):
        return "DOUBLE"
    return sql_type_of(data_type)


def profile_nested(df: DataFrame) -> DataFrame:
    """One row per leaf of a nested table: flat name, type, whether a value was missing, and its path.

    Arrays and maps are STRING.
    """
    found = leaves(df.schema)
    if not found:
        raise ValueError("no records found")
    counters, rows = [], []
    for i, (path, field) in enumerate(found):
        value = F.col(".".join(quoted(p) for p in path))
        counters.append(F.count(value).alias(f"c{i}"))
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType))
        rows.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(column_name_of("_".join(path))).alias("name"),
                F.lit("STRING" if nested else _flat_type(field.dataType)).alias("sql_type"),
                (F.col(f"c{i}") < F.col("n")).alias("nullable"),
                F.lit(".".join(path)).alias("path"),
            )
        )
    measured = df.agg(F.count(F.lit(1)).alias("n"), *counters)
    return measured.select(F.inline(F.array(*rows)))


def profile_json(
    spark: SparkSession, path, *, multiline: bool = False, sample_rows: int | None = None
) -> DataFrame:
    """Columns of JSON files, nested members flattened."""
    reader = spark.read.option("multiLine", multiline)
    if sample_rows is not None and not multiline:
        lines = spark.read.text(path).where("trim(value) <> ''").limit(sample_rows)
        shape = lines.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0]
        schema = _from_variant_type(shape, str(path))
        return profile_nested(lines.select(F.from_json("value", schema).alias("r")).select("r.*"))
    df = reader.json(path)
    if not df.columns:
        raise ValueError(f"no records found in {path}")
    return profile_nested(_sampled(df, sample_rows))


def _from_variant_type(text: str | None, where: str) -> T.StructType:
    """The schema behind the type text of a variant (OBJECT<...> is a struct)."""
    if not (text or "").startswith("OBJECT<"):
        raise ValueError(f"no records found in {where}")
    as_struct = text.replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING").replace("VOID", "STRING")
    return T.StructType.fromDDL(f"r {as_struct}")["r"].dataType


def profile_json_text(df: DataFrame, text: str) -> DataFrame:
    """Columns of JSON records held in a text column.

    The shape is a distributed aggregate over all records; a second pass counts the missing values.
    """
    shape = df.agg(F.schema_of_variant_agg(F.parse_json(col(text)))).first()[0]
    parsed = F.from_json(col(text), _from_variant_type(shape, f"column {text}"))
    return profile_nested(df.select(parsed.alias("r")).select("r.*"))


def profile_xml(
    spark: SparkSession, path, *, row_tag: str = "record", sample_rows: int | None = None
) -> DataFrame:
    """Columns of XML rows, from the texts of their children; attributes are ignored.  A child that a row has several times is STRING,
    as the scan gives the JSON array of its values.

    The children's names come from the rows as variants, so a sample reads no more than its rows.
    """
    read = spark.read.option("rowTag", row_tag).option("ignoreNamespace", True).option("excludeAttribute", True)
    rows = _sampled(read.option("singleVariantColumn", "row").xml(path), sample_rows)
    members = F.map_keys(F.try_variant_get("row", "$", "map<string, variant>"))
    children = [r["name"] for r in rows.select(F.explode(members).alias("name")).distinct().orderBy("name").collect()]
    if not children:
        raise ValueError(f"no <{row_tag}> rows in {path}; it has the elements {xml_tags(spark, path)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in children])
    return profile_columns(scan_xml(spark, path, schema, row_tag=row_tag).drop(MALFORMED), sample_rows=sample_rows, missing=())


def xml_tags(spark: SparkSession, path) -> list[str]:
    """The distinct element names of XML files, for a message about a wrong row tag."""
    found = (
        spark.read.text(path)
        .select(F.explode(F.regexp_extract_all("value", F.lit(r"<([A-Za-z_][\w.\-:]*)"), 1)).alias("tag"))
        .distinct()
        .orderBy("tag")
        .limit(50)
    )
    return [r["tag"] for r in found.collect()]


def _heads(spark: SparkSession, paths: list[str], threads: int = 16) -> list[str]:
    """The first line of each file, of which no more is read than it takes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def head(path: str) -> str:
        place = jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(conf).open(place)
        try:
            codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
            source = codec.createInputStream(stream) if codec else stream
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8"), 1 << 13)
            line = reader.readLine()
            while line is not None and not line.strip():  # a scan passes over empty lines, too
                line = reader.readLine()
            return (line or "").removeprefix("\ufeff")
        finally:
            stream.close()

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(head, paths))


def header_cells(line: str, delimiter: str) -> list[str]:
    """The cells of one line of CSV."""
    cells, cell, quoted_, at = [], "", False, 0
    while at < len(line):
        if line[at] == '"':
            if quoted_ and line[at : at + 2] == '""':
                cell += '"'
                at += 1
            else:
                quoted_ = not quoted_
            at += 1
        elif not quoted_ and line.startswith(delimiter, at):
            cells, cell, at = [*cells, cell], "", at + len(delimiter)
        else:
            cell, at = cell + line[at], at + 1
    return [*cells, cell]


def _titles(line: str, header: bool, delimiter: str) -> list[str]:
    """The names of a file's columns; an empty title and one that is there twice get their place for a name or at its end, as in a scan."""
    if not line:  # an empty file
        return []
    cells = header_cells(line, delimiter)
    if not header:
        return [f"col_{i}" for i in range(len(cells))]
    cells = [c.strip() for c in cells]
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def profile_folder(
    spark: SparkSession, folder: str, *, header: bool = True, delimiter: str = ",", sample_rows: int | None = None
) -> DataFrame:
    """The profile of every CSV file of a folder, with the table it would load.

    All files are read once, in one scan, whatever their headers: as rows (file, ordinal, text), which one aggregate of counters
    measures.  The headers come from the files' first lines.  A sample is taken of each file, so then files are read one by one.
    """
    paths = {r["file_name"]: r["path"] for r in listed_files(spark, folder, "csv")}
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    if sample_rows is not None:
        found = [
            profile_csv(spark, path, header=header, delimiter=delimiter, sample_rows=sample_rows).select(F.lit(name).alias("file_name"), "*")
            for name, path in paths.items()
        ]
        united = functools.reduce(DataFrame.unionByName, found)
        return united.select("file_name", table_name(stem).alias("table_name"), *[c for c in united.columns if c != "file_name"])

    titles = {name: _titles(line, header, delimiter) for name, line in zip(paths, _heads(spark, list(paths.values())))}
    cells = [f"c{i}" for i in range(max(1, *map(len, titles.values())))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    read = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("sep", delimiter)
    texts = read.csv(list(paths.values())).select(scanned_name().alias("file_name"), F.array(*cells).alias("cells"))
    names = spark.createDataFrame([(k, v) for k, v in titles.items()], "file_name string, titles array<string>")
    long = texts.join(names, "file_name").select("file_name", F.posexplode(F.slice("cells", F.lit(1), F.size("titles"))).alias("ordinal", "text"))
    measured = long.groupBy("file_name", "ordinal").agg(type_counts(F.col("text")).alias("counts"))
    listed = names.select("file_name", F.posexplode("titles").alias("ordinal", "title"))
    profiled = listed.join(measured, ["file_name", "ordinal"], "left")
    none = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("n", "present", "booleans", "wholes", "numbers")])
    counts = F.coalesce("counts", none)
    return profiled.select(
        "file_name", table_name(stem).alias("table_name"), "ordinal", column_name("title").alias("name"), type_of_counts(counts).alias("sql_type"),
        (counts["present"] < counts["n"]).alias("nullable"),
    )


def profile_schema(profile: DataFrame) -> T.StructType:
    """The fixed schema a (reviewed) profile stands for; nullability stays a remark, reads do not enforce it."""
    fields = []
    for r in profile.orderBy("ordinal").collect():
        path = r["path"].split(".") if "path" in profile.columns else [r["name"]]
        fields.append(
            T.StructField(r["name"], parse_sql_type(r["sql_type"]), True, {"path": path, "nullable": r["nullable"]})
        )
    return T.StructType(fields)
