"""Identity of a record: an unambiguous text per value, hashed over the record."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.types import col


def canonical_text(value: Column, data_type: T.DataType, *, merge_zeros: bool = False) -> Column:
    """A value as text that no other value of its column shares: `N` for null, else `V<length>:<text>`.

    Instants are written as epoch microseconds, so the session time zone has no part in the identity;
    bytes as hex.  The length keeps neighbours apart once texts are joined.  With `merge_zeros`, -0.0
    counts as 0.0 (they differ by default, as their texts do).
    """
    if isinstance(data_type, T.BinaryType):
        text = F.hex(value)
    elif isinstance(data_type, T.TimestampType):
        text = F.unix_micros(value).cast("string")
    elif merge_zeros and isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = F.when(value == 0, F.lit(0).cast(data_type)).otherwise(value).cast("string")
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit("V"), F.length(text), F.lit(":"), text), F.lit("N"))


def record_hash(fields: Iterable[T.StructField], *, merge_zeros: bool = False) -> Column:
    """SHA-256 over the canonical texts of the given fields, in their order.

    The hash is never null.  Saying so keeps joins on it from adding a null filter that hashes every
    row once more.
    """
    texts = [canonical_text(col(f.name), f.dataType, merge_zeros=merge_zeros) for f in fields]
    return F.coalesce(F.sha2(F.concat_ws("|", *texts), 256), F.lit(""))


def value_hash(fields: Iterable[T.StructField]) -> Column:
    """Identity of the typed attributes of an entity; free of number and date formatting in JSON."""
    return record_hash(fields)


def packed(hash_text: Column) -> Column:
    """A record hash in 32 bytes instead of 64 characters, for rows that are shuffled; `hash_text` turns it back.

    Never null, as the hash is not."""
    return F.coalesce(F.unhex(hash_text), F.lit(b""))


def hash_text(packed_hash: Column) -> Column:
    return F.lower(F.hex(packed_hash))


def reversed_hex(text: Column) -> Column:
    """Hex text whose order is the reverse of the original's: its maximum is the original's minimum."""
    return F.translate(text, "0123456789abcdef", "fedcba9876543210")
