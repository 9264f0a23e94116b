"""Distinct records and the loads they were seen in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.functions.identity import hash_text, packed, record_hash
from sediment.operators.gather import gathered, whole_pieces
from sediment.types import LINEAGE_COLUMNS, col, cols, quoted


#: A task counts the rows of so many bytes of input files: a few million, as a Raw row takes some ten bytes there.
PIECE_BYTES = 8 << 20


def nulls_last(*names: str) -> list[Column]:
    """Sort keys that put nulls behind every value, also inside a struct comparison."""
    keys = []
    for name in names:
        keys += [col(name).isNull().alias(f"no_{name}"), col(name)]
    return keys


def hashed(raw: DataFrame, columns: list[str], *, merge_zeros: bool = False) -> DataFrame:
    """The compared columns, the lineage and the record's identity."""
    fields = [raw.schema[c] for c in columns]
    return raw.select(
        *cols(columns),
        *cols(LINEAGE_COLUMNS),
        record_hash(fields, merge_zeros=merge_zeros).alias("_record_hash"),
    )


def first_seen(df: DataFrame) -> DataFrame:
    """One row per record: its earliest copy, and `_copies`, the number of copies.

    Earliest is by load time, batch and file, nulls last.  An aggregate, as it counts: copies collapse before
    the shuffle, so a record that fills a third of the input costs one row per task.
    """
    payload = [c for c in df.columns if c != "_record_hash"]
    earliest = F.struct(*nulls_last("_ingested_at", "_batch_id", "_source_file"))
    picked = df.groupBy("_record_hash").agg(
        F.min_by(F.struct(*cols(payload)), earliest).alias("_first"),
        F.count(F.lit(1)).alias("_copies"),
    )
    return picked.select(
        *[F.col("_first").getField(c).alias(c) for c in payload], "_record_hash", "_copies"
    )


def earliest_copies(df: DataFrame) -> DataFrame:
    """One row per record, as `first_seen` picks it, without the number of copies.

    A window that is limited to its first row: each task keeps one row per record before the shuffle, so
    here, too, a record that fills a third of the input costs one row per task.  Without a count this is faster
    than the aggregate, which sorts whole rows twice.
    """
    order = nulls_last("_ingested_at", "_batch_id", "_source_file")
    place = F.row_number().over(Window.partitionBy("_record_hash").orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def distinct_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """One copy of each distinct record of a Raw table, with its identity."""
    return earliest_copies(hashed(df, columns))


def sightings(df: DataFrame) -> DataFrame:
    """One row per record and load: when the load first saw it."""
    return counted_sightings(df).drop("_copies")


def dealt_by_hash(df: DataFrame, n: int) -> DataFrame:
    """The rows in `n` partitions by their record hash, as its text deals them to the buckets of a table; in the shuffle it is 32 bytes and no text."""
    key = F.col("_record_hash")
    return df.withColumn("_record_hash", packed(key)).repartition(n, hash_text(key)).withColumn("_record_hash", hash_text(key))


def counted_sightings(df: DataFrame, buckets: int = 1, *, pack: bool = False) -> DataFrame:
    """The sightings, each with `_copies`, the number of rows behind it.

    Rows are brought together by the hash alone: all sightings of a record stay side by side, in the shuffle, in what is written and for what
    is asked of a record next.  They are counted behind the shuffle only: few rows of a load are alike, and a task that reads a large piece
    of Raw could not hold a row for each.  Copies of a hot record meet in one task, which streams them into one row per load;
    they are alike, so they take next to nothing in the shuffle.  With `pack` a hash that is text is shuffled in 32 bytes.
    """
    rows = df.select("_record_hash", "_batch_id", "_ingested_at")
    if pack:
        rows = dealt_by_hash(rows, whole_pieces(rows, PIECE_BYTES, buckets))
    else:
        rows = gathered(rows, ["_record_hash"], PIECE_BYTES, buckets)
    return rows.groupBy("_record_hash", "_batch_id").agg(F.min("_ingested_at").alias("_ingested_at"), F.count(F.lit(1)).alias("_copies"))


def with_record_copies(seen: DataFrame) -> DataFrame:
    """Counted sightings with `_record_copies`: at one sighting of each record the rows behind all of them, null at the others.

    Of what is staged so, records are found without grouping them again."""
    record = Window.partitionBy("_record_hash")
    place = F.row_number().over(record.orderBy("_batch_id"))
    return seen.withColumn("_record_copies", F.when(place == 1, F.sum("_copies").over(record)))


def distinct_stats(df: DataFrame, key: str = "_record_hash") -> DataFrame:
    """Rows and exact distinct keys in one pass: copies are counted per key, then summed."""
    per_key = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(col(key)).alias("distinct_records"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent row."""
    return child.join(parent.select(col(key)), key, "left_anti")


def last_seen(seen: DataFrame) -> DataFrame:
    """The latest time and load of each record."""
    latest = F.max(F.struct(F.col("_ingested_at").alias("at"), F.col("_batch_id").alias("batch")))
    return (
        seen.groupBy("_record_hash")
        .agg(latest.alias("_latest"))
        .select(
            "_record_hash",
            F.col("_latest.at").alias("_seen_at"),
            F.col("_latest.batch").alias("_seen_batch"),
        )
    )


def with_last_seen(bronze: DataFrame, seen: DataFrame) -> DataFrame:
    """Each record with `_seen_at` and `_seen_batch`; its own lineage where nothing was recorded."""
    return bronze.join(last_seen(seen), "_record_hash", "left").withColumns(
        {
            "_seen_at": F.coalesce("_seen_at", "_ingested_at"),
            "_seen_batch": F.coalesce("_seen_batch", "_batch_id"),
        }
    )


def latest_version_of(bronze: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the record seen most recently (by time, then load)."""
    records = with_last_seen(bronze, seen)
    rest = [c for c in records.columns if c not in keys]
    order = F.struct("_seen_at", "_seen_batch", "_record_hash")
    return (
        records.groupBy(*cols(keys))
        .agg(F.max_by(F.struct(*cols(rest)), order).alias("_row"))
        .select(*cols(keys), *[F.col(f"_row.{quoted(c)}") for c in rest])
    )
