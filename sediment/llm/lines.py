"""Line dedup: lines that many documents share stay in one of them.

Method: explode normalised lines, hash them, count the distinct documents of each hash, drop the lines of
hashes over the threshold, and put each document's other lines together again by position.

* A null or empty text is one empty line.  A missing id counts as one document, before all others.
* Rows with one id are one document: a line counts once for them, and the same positions go from each.
* A line that several documents hold stays in the one with the largest id, with all its copies there.
* No row: no row.  Other columns are carried in `row`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.columns import BLANKS, id_of, row_of
from sediment.staging import stage
from sediment.types import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def repeated_lines(places: DataFrame, min_docs: int) -> DataFrame:
    """`line` (hash) and `keeper` of lines that at least `min_docs` documents hold, of rows (doc, position, line)."""
    return (
        places.select("line", "doc").distinct()
        .groupBy("line").agg(F.count(F.lit(1)).alias("documents"), F.max("doc").alias("keeper"))
        .where(F.col("documents") >= min_docs)
        .select("line", "keeper")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` (the given row but its text), `doc`, `text` (what is left), `n_lines` before and `n_dropped`, for each row.

    The only text that is shuffled is that of each document, once, to its list of dropped positions.  A line
    is a 16-byte hash elsewhere; a hot line is counted per task before it is shuffled, and in the join with
    its one row of `repeated_lines` it is on the side that adaptive execution splits.
    """
    lines = F.split(F.coalesce(col(text), F.lit("")), "\n", -1)
    exploded = docs.select(id_of(key).alias("doc"), F.posexplode(lines).alias("position", "raw"))
    keyed = exploded.select("doc", "position", line_key(F.col("raw")).alias("clean"))
    places = stage(
        keyed.where(F.char_length("clean") >= min_chars)
        .select("doc", "position", F.unhex(F.md5(F.col("clean").cast("binary"))).alias("line"))
    )
    dropped = (
        places.join(stage(repeated_lines(places, min_docs)), "line")  # staged, so that a hot line's side can be split
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("doc").agg(F.collect_set("position").alias("gone"))
    )
    split = docs.select(id_of(key).alias("doc"), row_of(docs, text).alias("row"), lines.alias("lines"))
    joined = split.join(dropped.hint("shuffle_hash"), "doc", "left")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i)
    )
    return joined.select(
        "row",
        "doc",
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
