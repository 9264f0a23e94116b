"""Columns added to, cut from or built out of a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.functions.names import column_name_of
from sediment.functions.steps import compile_steps
from sediment.types import LINEAGE_COLUMNS, col, cols, parse_sql_type, source_columns


def with_lineage(
    df: DataFrame, batch_id: str, at: Column, source_file: str | None = None
) -> DataFrame:
    """Add when, from which file and by which load a row came in.

    The file comes from the scan itself; a literal serves sources that do not tell theirs.
    """
    file = F.col("_metadata.file_path") if source_file is None else F.lit(source_file)
    return df.withColumns(
        {
            "_ingested_at": at.cast("timestamp"),
            "_source_file": file,
            "_batch_id": F.lit(batch_id),
        }
    )


def leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.StructField]]:
    """Every non-struct field of a schema with its path."""
    found = []
    for field in schema.fields:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            found += leaves(field.dataType, here)
        else:
            found.append((here, field))
    return found


def _at(path: Iterable[str]) -> Column:
    first, *rest = path
    value = col(first)
    for name in rest:
        value = value.getField(name)
    return value


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """One column per leaf, named by its path; arrays and maps become their JSON text."""
    flat, taken = [], set()
    for path, field in leaves(df.schema):
        name = column_name_of(sep.join(path)).replace("-", "_")
        if name.lower() in taken:
            raise ValueError(f"two fields flatten to the name {name!r}")
        taken.add(name.lower())
        value = _at(path)
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            value = F.to_json(value)
        flat.append(value.alias(name, metadata={"path": list(path)}))
    return df.select(*flat)


def record_json(df: DataFrame) -> Column:
    """The source columns of a row as JSON text."""
    names = [f.name for f in source_columns(df.schema) if f.name != "_record_hash"]
    return F.to_json(F.struct(*cols(names)))


def stamp(df: DataFrame, system: str, at: Column) -> DataFrame:
    """Add the source system and the time of the update."""
    return df.withColumns({"_source_system": F.lit(system), "_updated_at": at.cast("timestamp")})


# Why a record is turned away, after the attribute's name.
NOT_CONVERTED = "value could not be converted"
EMPTY = "required value is empty"


def required_reason(name: str) -> Column:
    return F.when(col(name).isNull(), F.lit(f"{name}: {EMPTY}"))


def project_attributes(df: DataFrame, attributes, keep: Iterable[str] = ()) -> DataFrame:
    """Typed, cleaned attributes and `_reasons`: why the record would be turned away (empty if valid).

    `attributes` have a name, a source column, a type, steps and a required flag.  Columns in `keep`
    are passed through.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    values, flags, reasons = [], [], []
    for a in attributes:
        done = compile_steps(col(a.source), types[a.source], a.steps)
        values.append(done.value.try_cast(parse_sql_type(a.type)).alias(a.name))
        if done.failed is not None:
            flag = f"_failed_{a.name}"
            flags.append(done.failed.alias(flag))
            reasons.append(F.when(col(flag), F.lit(f"{a.name}: {NOT_CONVERTED}")))
        if a.required:
            reasons.append(required_reason(a.name))
    listed = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    passed = cols(keep)
    return df.select(*values, *flags, *passed).select(
        *cols(a.name for a in attributes), *passed, listed.alias("_reasons")
    )


def column_diff(have: Iterable[str], required: Iterable[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) names, in their order."""
    have, required = list(have), list(required)
    return [c for c in required if c not in have], [c for c in have if c not in required]


def guard_schema(df: DataFrame, required: Iterable[str], what: str = "the table") -> list[str]:
    """Raise if a compared column is gone; return the columns nobody compares."""
    missing, extra = column_diff(df.columns, [*required, *LINEAGE_COLUMNS])
    if missing:
        raise ValueError(f"{what} no longer has the columns {missing}")
    return extra
