"""Columns of documents, whatever else a table holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.types import col, cols

#: Stands for a missing id: such documents count as one that comes before all others.
NO_ID = -(2**63)

#: What separates words: the space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def id_of(key: str) -> Column:
    """A document's id, never null."""
    return F.coalesce(col(key).cast("long"), F.lit(NO_ID))


def id_back(column) -> Column:
    """The id as it was given."""
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID))


def bytes_of(text: str) -> Column:
    """A text as UTF-8, empty if it is null."""
    return F.coalesce(col(text).cast("binary"), F.lit(b""))


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`doc` (never null) and `body` (bytes, never null); all other columns are left out."""
    return docs.select(id_of(key).alias("doc"), bytes_of(text).alias("body"))


def row_of(docs: DataFrame, *without: str) -> Column:
    """A row as one struct, so that no column can clash with an operator's own; never without a field."""
    filling = "_"
    while filling.lower() in map(str.lower, docs.columns):
        filling += "_"
    return F.struct(*cols(c for c in docs.columns if c not in without), F.lit(True).alias(filling))
