"""Scans of CSV, JSON and XML files under a reviewed, fixed schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.names import table_name, table_name_of
from sediment.functions.rules import require
from sediment.types import col, parse_sql_type

MALFORMED = "_malformed"


@dataclass(frozen=True)
class LoadSpec:
    """What to read and how.

    Fields of `schema` may carry metadata: `header`, the column's title in a CSV file, and `path`, its
    place in a nested JSON record.
    """

    path: str
    format: str
    schema: T.StructType
    options: dict = field(default_factory=dict)
    layout: tuple = ()  # fixed-width sources


def _lenient(schema: T.StructType) -> T.StructType:
    """The schema with room for the text of a row that does not fit it."""
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    return T.StructType([*fields, T.StructField(MALFORMED, T.StringType(), True)])


def scan_csv(
    spark: SparkSession, path, schema: T.StructType, *, header: bool = True, delimiter: str = ","
) -> DataFrame:
    """Rows of CSV files, with `_malformed`: the text of a row that does not fit the schema.

    Files are read under their own titles, which are checked against the header of every file, so a
    file with moved columns is an error and not silently wrong.
    """
    require("delimiter", delimiter, "delimiter")
    titles = [f.metadata.get("header", f.name) if header else f.name for f in schema.fields]
    as_written = T.StructType([T.StructField(t, f.dataType) for t, f in zip(titles, schema.fields)])
    df = (
        spark.read.schema(_lenient(as_written))
        .option("header", header)
        .option("sep", delimiter)
        .option("enforceSchema", not header)
        .option("columnNameOfCorruptRecord", MALFORMED)
        .csv(path)
    )
    return df.select(*[col(t).alias(f.name) for t, f in zip(titles, schema.fields)], MALFORMED)


def nested_schema(schema: T.StructType) -> T.StructType:
    """The record shape behind flat columns that carry their `path`."""
    tree: dict = {}
    for f in schema.fields:
        *groups, leaf = f.metadata.get("path") or [f.name]
        node = tree
        for g in groups:
            node = node.setdefault(g, {})
        node[leaf] = f.dataType

    def build(node: dict) -> T.StructType:
        return T.StructType(
            [T.StructField(k, build(v) if isinstance(v, dict) else v) for k, v in node.items()]
        )

    return build(tree)


def scan_json(spark: SparkSession, path, schema: T.StructType, *, multiline: bool = False) -> DataFrame:
    """Rows of JSON files: one record a line, or whole documents; nested members become flat columns.

    A member declared STRING that holds an array comes as its JSON text.
    """
    df = (
        spark.read.schema(_lenient(nested_schema(schema)))
        .option("multiLine", multiline)
        .option("columnNameOfCorruptRecord", MALFORMED)
        .json(path)
    )
    picked = []
    for f in schema.fields:
        first, *rest = f.metadata.get("path") or [f.name]
        value = col(first)
        for name in rest:
            value = value.getField(name)
        picked.append(value.alias(f.name))
    return df.select(*picked, MALFORMED)


def _one_or_all(values: Column) -> Column:
    """The only text of a child, or the JSON array of all."""
    return F.when(F.size(values) > 1, F.to_json(values)).otherwise(F.get(values, F.lit(0)))


def scan_xml(spark: SparkSession, path, schema: T.StructType, *, row_tag: str = "record") -> DataFrame:
    """Rows of XML files: the elements named `row_tag`; name spaces are ignored.

    A field whose metadata has `items`, a SQL type, is a child that a row may have several times: its values come as a JSON array.
    Any other STRING child that a row happens to have several times comes as such an array, too; none of its values is lost.
    """
    require("row_tag", row_tag, "row tag")
    items = {f.name: parse_sql_type(f.metadata["items"]) for f in schema.fields if "items" in f.metadata}
    texts = [f.name for f in schema.fields if f.name not in items and isinstance(f.dataType, T.StringType)]
    as_written = T.StructType([
        T.StructField(f.name, T.ArrayType(items.get(f.name, T.StringType())) if f.name in items or f.name in texts else f.dataType)
        for f in schema.fields
    ])
    df = (
        spark.read.schema(_lenient(as_written))
        .option("rowTag", row_tag)
        .option("ignoreNamespace", True)
        .option("columnNameOfCorruptRecord", MALFORMED)
        .xml(path)
    )
    shown = {**{n: F.to_json(col(n)) for n in items}, **{n: _one_or_all(col(n)) for n in texts}}
    return df.select(*[shown.get(f.name, col(f.name)).alias(f.name) for f in schema.fields], MALFORMED)


def scan(spark: SparkSession, spec: LoadSpec) -> DataFrame:
    """The rows a LoadSpec describes."""
    from sediment.sources.fixed import scan_fixed

    readers = {"csv": scan_csv, "json": scan_json, "xml": scan_xml}
    if spec.format == "fixed":
        return scan_fixed(spark, spec.path, spec.layout, **spec.options)
    if spec.format not in readers:
        raise ValueError(f"unknown source format {spec.format!r}")
    return readers[spec.format](spark, spec.path, spec.schema, **spec.options)


# Which files of a folder belong to a format.
PATTERNS = {"csv": "*.csv", "json": "*.json", "xml": "*.xml"}


def folder_files(spark: SparkSession, folder: str, format: str) -> DataFrame:
    """The files of a folder that belong to the format: path, file name and table name, by name."""
    if format not in PATTERNS:
        raise ValueError(f"no file pattern for format {format!r}")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", PATTERNS[format])
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))
        .orderBy("file_name")
    )


def listed_files(spark: SparkSession, folder: str, format: str) -> list:
    """The names of the files of a folder that become one table each, however many they are."""
    found = folder_files(spark, folder, format).collect()
    if not found:
        raise ValueError(f"no {PATTERNS[format]} files in {folder}")
    return found


def scanned_name() -> Column:
    """The name of the file a scanned row is from.

    The scan gives it as part of a URI, in which a blank is %20 but a plus sign stands for itself.
    """
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def scan_folder(spark: SparkSession, folder: str, format: str, schema: T.StructType, **options) -> DataFrame:
    """All files of a folder that share one schema, in one scan, each row with the `_table` of its file."""
    if format not in PATTERNS:
        raise ValueError(f"no file pattern for format {format!r}")
    readers = {"csv": scan_csv, "json": scan_json, "xml": scan_xml}
    rows = readers[format](spark, f"{folder.rstrip('/')}/{PATTERNS[format]}", schema, **options)
    stem = F.regexp_replace(scanned_name(), r"\.[^.]*$", "")
    return rows.withColumn("_table", table_name(stem))


def folder_specs(spark: SparkSession, folder: str, format: str, schemas: dict, **options) -> dict[str, LoadSpec]:
    """One LoadSpec per file of a folder, keyed by table name; `schemas` maps a file name to its schema."""
    specs = {}
    for row in listed_files(spark, folder, format):
        table = table_name_of(row["file_name"])
        if table in specs:
            raise ValueError(f"two files of {folder} give the table name {table!r}")
        specs[table] = LoadSpec(row["path"], format, schemas[row["file_name"]], options)
    return specs

