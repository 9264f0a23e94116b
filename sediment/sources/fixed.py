"""Fixed-width mainframe files, laid out by a copybook."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import ebcdic
from sediment.sources.copybook import Field, layout_schema, named, read_copybook, record_length
from sediment.types import col

__all__ = ["Field", "decode_lines", "decode_records", "layout_schema", "named", "read_copybook", "record_length", "scan_fixed"]

MAX_CALL_BYTES = 64 << 20


def _decoded(raw: Column, f: Field) -> Column:
    match f.kind:
        case "text":
            return ebcdic.decode_text(raw)
        case "comp":
            return ebcdic.decode_comp(raw, f.length, f.digits, f.scale, f.signed)
        case "comp3":
            return ebcdic.decode_comp3(raw, f.digits, f.scale)
        case "float":
            return ebcdic.decode_float(raw, f.length)
    return ebcdic.decode_zoned(raw, f.digits, f.scale, f.signed, f.sign)


def _entries(record: Column, f: Field, decode) -> Column:
    """How many entries a table of variable length has in a record; null if its counter says what can't be."""
    n = decode(_bytes(record, f.counter, decode), f.counter)
    return F.when(n.between(f.least, f.occurs), n.cast("int"))


def _begin(record: Column, f: Field, decode, start: int = 0) -> Column:
    """Where a field begins, from 1 on, `start` bytes later than its offset says."""
    at = F.lit(start + f.offset + 1)
    for table in f.after:
        at = at - (F.lit(table.occurs) - _entries(record, table, decode)) * F.lit(table.length)
    return at


def _bytes(record: Column, f: Field, decode, start: int = 0, entry: int = 0) -> Column:
    return F.substring(record, _begin(record, f, decode, start + entry * f.length), F.lit(f.length))


def _items(record: Column, f: Field, decode, start: int = 0) -> Column:
    """The value of a field that begins `start` bytes later than its offset says."""
    def one(entry: int) -> Column:
        if f.kind != "group":
            return decode(_bytes(record, f, decode, start, entry), f)
        at = start + f.offset + entry * f.length
        if f.after:  # the items of a table count from where the entry begins
            moved = F.substring(record, _begin(record, f, decode, start + entry * f.length), F.lit(f.length))
            return F.struct(*[_items(moved, i, decode).alias(i.name) for i in named(f.items)])
        return F.struct(*[_items(record, i, decode, at).alias(i.name) for i in named(f.items)])

    if not f.repeated:
        return one(0)
    values = F.array(*[one(i) for i in range(f.occurs)])
    return F.to_json(F.slice(values, F.lit(1), _entries(record, f, decode)) if f.counter else values)


def decode_records(df: DataFrame, layout: Iterable[Field], record: str = "value") -> DataFrame:
    """The fields of binary records in code page 037, as columns."""
    return df.select(*[_items(col(record), f, _decoded).alias(f.name) for f in named(layout)])


def decode_lines(df: DataFrame, layout: Iterable[Field], line: str = "value") -> DataFrame:
    """The fields of plain-text records, as columns."""

    def decode(text, f):
        if f.kind == "text":
            return F.rtrim(text)
        if f.kind == "zoned":
            return ebcdic.decode_display_text(text, f.digits, f.scale, f.sign)
        raise ValueError(f"{f.name}: {f.kind} has no meaning in a text file")

    return df.select(*[_items(col(line), f, decode).alias(f.name) for f in named(layout)])


def _fixed_records(spark: SparkSession, path: str, length: int) -> DataFrame:
    """Records of a file without delimiters; the file is split at record boundaries.

    Spark has the splitting reader only as an RDD of byte arrays.  It is turned into a DataFrame on the
    JVM side, so no record passes through a Python worker.
    """
    sc = spark.sparkContext
    records = sc._jsc.sc().binaryRecords(path, length, sc._jsc.hadoopConfiguration())
    dataset = spark._jsparkSession.createDataset(records, sc._jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(dataset.toDF(), spark)


def _cut_sequence(content: bytes, length: int, big_endian: bool) -> Iterator[bytes]:
    """The records behind their four-byte length headers; a short one is filled up with blanks.

    A record that is longer than the layout, or that the file's end cuts off, is an error.
    """
    at = 0
    while at < len(content):
        header = content[at : at + 4]
        if len(header) < 4:
            raise ValueError(f"the file ends inside a record header at byte {at}")
        size = int.from_bytes(header[:2], "big") if big_endian else int.from_bytes(header[2:], "little")
        if size == 0:
            raise ValueError(f"empty record header at byte {at}")
        if size > length:
            raise ValueError(f"the record at byte {at} has {size} bytes, the layout {length}")
        at += 4
        if at + size > len(content):
            raise ValueError(f"the file ends inside the record at byte {at - 4}")
        yield content[at : at + size].ljust(length, b"\x40")
        at += size


def _sequence_records(spark: SparkSession, path: str, length: int, big_endian: bool) -> DataFrame:
    """Records that carry their length; such a file can only be read from its start, so one task a file.

    A file beyond 2 GB, Spark's limit for whole files, is refused by Spark; it has to be cut where it is made.
    """

    def cut(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for record in _cut_sequence(content, length, big_endian):
                    rows.append(record)
                    held += length
                    if held >= MAX_CALL_BYTES:
                        yield pd.DataFrame({"value": rows})
                        rows, held = [], 0
                yield pd.DataFrame({"value": rows})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(cut, "value binary")


def scan_fixed(
    spark: SparkSession,
    path: str,
    layout: Iterable[Field],
    *,
    is_record_sequence: bool = False,
    is_text: bool = False,
    big_endian: bool = False,
) -> DataFrame:
    """Rows of a fixed-width file: plain records, records with length headers, or lines of text."""
    layout = tuple(layout)
    length = record_length(layout)
    if is_text:
        return decode_lines(spark.read.text(path), layout)
    if is_record_sequence:
        return decode_records(_sequence_records(spark, path, length, big_endian), layout)
    return decode_records(_fixed_records(spark, path, length), layout)
