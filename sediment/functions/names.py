"""Names derived from file names, headers and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def table_name(text: Column) -> Column:
    """'Order Item' -> 'order_item'; a leading digit gets the prefix `t_`, nothing left gives `table`."""
    name = F.btrim(
        F.regexp_replace(F.lower(F.trim(text)), "[^0-9a-zA-Z_]", "_"), F.lit("_")
    )
    return (
        F.when(name == "", "table")
        .when(name.rlike("^[0-9]"), F.concat(F.lit("t_"), name))
        .otherwise(name)
    )


def table_name_of(file_name: str) -> str:
    """`table_name` for a single file on the driver; the extension does not count."""
    stem = file_name.rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem.lstrip(".") else stem
    kept = "".join(c if c == "_" or (c.isascii() and c.isalnum()) else "_" for c in stem.strip().lower())
    kept = kept.strip("_")
    if not kept:
        return "table"
    return "t_" + kept if kept[0].isdigit() else kept


def column_name(text: Column) -> Column:
    """Header text or dotted path -> column name."""
    return F.regexp_replace(F.trim(text), "[. ]", "_")


def column_name_of(text: str) -> str:
    return text.strip().replace(".", "_").replace(" ", "_")


def slug(text: Column) -> Column:
    """A job's title as a path segment; nothing left gives `pipeline`."""
    kept = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_"), F.lit("._-"))
    return F.when(kept == "", "pipeline").otherwise(kept)
