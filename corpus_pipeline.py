"""A training corpus from documents: rules, lines, near copies, benchmark passages, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what one returns and gives it to the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sediment.llm import lines, near, packing, postings, quality
from sediment.llm.columns import id_of, row_of
from sediment.staging import stage
from sediment.types import col

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: The words of a benchmark item below which it removes no document: a word or a name is found in clean texts, too.
LEAST_HIT = 5

#: Tokens, copies and components can't be said in SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return quality.judge(docs, carry=True).where("kept").select("given.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more of them share, but in the last one."""
    found = lines.dedup_lines(docs)
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*[changed.get(c, col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the smallest id; documents without words stay.

    A document is an id with the words of a text: rows with one id are chosen each by its own words.  Of rows with one id and
    equal words the one with the least text stays, and of equal texts the least of the other columns' hashes.
    """
    classes = stage(near.near_classes(docs, copies=True).select(id_of("doc_id").alias("doc"), "copy", "root"))
    wordless = classes.where(F.col("copy").isNull()).select("doc", F.lit(b"").alias("copy")).distinct()
    first = classes.where(F.col("copy").isNotNull()).groupBy("root").agg(F.min(F.struct("doc", "copy")).alias("first"))
    chosen = stage(first.select("first.doc", "first.copy").unionByName(wordless))
    rows = docs.select(row_of(docs).alias("row"), id_of("doc_id").alias("doc"), F.coalesce(near.copy_key("text"), F.lit(b"")).alias("copy"))
    order = Window.partitionBy("doc", "copy").orderBy("row.text", F.xxhash64("row"))
    kept = rows.join(chosen, ["doc", "copy"], "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return kept.select(*[col("row")[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark, of LEAST_HIT words or more; rows with one id are judged each by its own text."""
    rows = docs.select(row_of(docs).alias("row"), F.xxhash64(col("doc_id"), col("text")).alias("own"), col("text").alias("text"))
    found = postings.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="own", least=LEAST_HIT)
    gone = stage(found.where(F.col("contaminated")).select(F.col("doc_id").alias("own")).distinct())
    return rows.join(gone, "own", "left_anti").select(*[col("row")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
