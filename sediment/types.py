"""The closed set of column types a table may have."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The SQL type names that may appear in a table, besides DECIMAL(p,s).
SQL_TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "TINYINT": T.ByteType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "BINARY": T.BinaryType(),
}

_DECIMAL = re.compile(r"DECIMAL\((\d{1,2}),(\d{1,2})\)")

LINEAGE_COLUMNS = ("_ingested_at", "_source_file", "_batch_id")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column, whatever characters its name holds."""
    return F.col(quoted(name))


def cols(names) -> list[Column]:
    return [col(n) for n in names]


def normalize_sql_type(text: str | None) -> str | None:
    """'decimal(15, 2)' -> 'DECIMAL(15,2)'; None for a type outside the closed set."""
    compact = "".join((text or "").split()).upper()
    if compact in SQL_TYPES:
        return compact
    found = _DECIMAL.fullmatch(compact)
    if found:
        precision, scale = int(found[1]), int(found[2])
        if 1 <= precision <= 38 and scale <= precision:
            return compact
    return None


def normalized_sql_type(text: Column) -> Column:
    """`normalize_sql_type` over a column of type names."""
    compact = F.upper(F.regexp_replace(text, r"\s+", ""))
    decimal = r"^DECIMAL\((\d{1,2}),(\d{1,2})\)$"
    precision = F.regexp_extract(compact, decimal, 1).cast("int")
    scale = F.regexp_extract(compact, decimal, 2).cast("int")
    return F.when(compact.isin(*SQL_TYPES), compact).when(
        compact.rlike(decimal), F.when(precision.between(1, 38) & (scale <= precision), compact)
    )


def parse_sql_type(text: str) -> T.DataType:
    name = normalize_sql_type(text)
    if name is None:
        raise ValueError(f"unsupported column type {text!r}")
    found = _DECIMAL.fullmatch(name)
    return T.DecimalType(int(found[1]), int(found[2])) if found else SQL_TYPES[name]


def sql_type_of(data_type: T.DataType) -> str:
    """The type name a column is registered under; anything outside the closed set is STRING."""
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    if isinstance(data_type, T.TimestampNTZType):
        return "TIMESTAMP"
    for name, known in SQL_TYPES.items():
        if type(known) is type(data_type):
            return name
    return "STRING"


def schema_of(columns: dict[str, str]) -> T.StructType:
    """The schema of a reviewed column list: names and SQL types, in order."""
    return T.StructType([T.StructField(name, parse_sql_type(text)) for name, text in columns.items()])


def ddl(schema: T.StructType) -> str:
    """Column list of a CREATE TABLE statement."""
    return ", ".join(f"{quoted(f.name)} {sql_type_of(f.dataType)}" for f in schema.fields)


def source_columns(schema: T.StructType) -> list[T.StructField]:
    """The fields that came from the source: everything but the lineage columns."""
    return [f for f in schema.fields if f.name not in LINEAGE_COLUMNS]
