"""Quality rules: a document is measured, and compared with what is usual for its language and source.

Method: every measure of every (language, source) is summed up in a mergeable quantile sketch; the sketches
give a threshold each, and a join with them filters.  The sketch is a histogram whose buckets keep the first
seven binary digits of a value, so a quantile is off by less than 1 part in 64, whatever the scale.  It has
at most 64 buckets for each binary order of magnitude, and two sketches merge by adding their counts: a hot source is one
row per bucket and task in the shuffle.

Only documents that pass the base rules are in the sketches.  A (language, source) has the limit high + SPREADS * (high - middle) for a measure, where
`high` is an upper quantile, `middle` the median and their distance at least the width of the bucket of `high`; so the room beyond
the usual, too, comes from the sketch.  All sources of a language then
give their limits one vote each, however large they are: the (lower) median is the language's limit.  A source is judged by its own
limit as far as that lies between the language's limit and TRUST times it.  So a small source can't reject what is usual in its
language, and a source full of junk, be it a third of all rows, can't let its junk through.

* A null text has no words; so has an empty one: base_failed, not kept, and in no sketch.  A group without any document in its sketch has none to judge.
* A null language or source is a group of its own.  Rows with one id are judged each by itself, for its own row.
* No row: no row.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.arrays import BLANK, PIECE, Sums, U64, Words, column_bytes, mix, per_document, runs, slices
from sediment.llm.columns import bytes_of
from sediment.staging import stage
from sediment.types import col, cols

#: The words a document needs, and the share of repeated words (in percent) that it may have.
MIN_WORDS, MAX_REPEATED = 10, 20
WINDOW = 5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

#: What is judged, a value per thousand words; the upper quantile in percent; and how many spreads a value may lie beyond it.  Junk
#: of up to a tenth of a source's rows shall not move the limits of symbols and of the length of words.  Repeated words and lines are 0 in most texts
#: and have a long tail in good ones, too, which the base rules have cut already.
RATIOS = {"symbols": ("n_symbols", 90, 16), "chars": ("word_chars", 90, 4), "repeats": ("n_repeat_words", 98, 1), "lines": ("n_dup_lines", 98, 2)}

#: How many times the limit of its language the limit of a source can be.
TRUST = 2

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Of each document, the words in windows that it holds twice or more."""
    n = np.diff(words.offsets)
    out = np.zeros(len(n), np.int64)
    hashes = words.hashes()
    for a, b in runs(n, PIECE):
        at = words.offsets[a : b + 1] - words.offsets[a]
        units = hashes[words.offsets[a] : words.offsets[b]]
        owner = np.repeat(np.arange(b - a), n[a:b])
        grams = Sums(units).hash_all(window)
        if not len(grams):
            continue
        own = mix(grams ^ mix(owner[: len(grams)].astype(U64) + U64(1)))
        places = np.flatnonzero(owner[: len(grams)] == owner[window - 1 :])
        order = np.argsort(own[places], kind="stable")
        value = own[places][order]
        same = np.zeros(len(value) + 1, bool)
        same[1:-1] = value[1:] == value[:-1]
        found = places[order][same[1:] | same[:-1]]
        step = np.zeros(len(units) + 1, np.int64)
        np.add.at(step, found, 1)
        np.add.at(step, found + window, -1)
        out[a:b] = per_document(np.cumsum(step[:-1]) > 0, at)
    return out


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices((pa.RecordBatch.from_arrays([t], names=["body"]) for t in texts), "body"):
        body, offsets = column_bytes(batch.column("body"))
        words = Words(body, offsets, BLANK)
        yield pa.StructArray.from_arrays(
            [
                pa.array(np.diff(words.offsets)),
                pa.array(per_document(words.inside & ((body & 0xC0) != 0x80), offsets)),
                pa.array(per_document(SYMBOLS[body], offsets)),
                pa.array([duplicate_lines(body[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64()),
                pa.array(repeated_words(words)),
            ],
            names=_MEASURES,
        )


def measure(docs: DataFrame, *carried: Column, text: str = "text") -> DataFrame:
    """`row` (a struct of the carried columns) and the measures of each text.

    Python gets the texts alone and gives the measures back: what is carried stays in Spark, however large its rows are.
    """
    measured = F.arrow_udf(_measured, ", ".join(f"{m} long" for m in _MEASURES))
    rows = docs.select(F.struct(*carried).alias("row"), measured(bytes_of(text)).alias("measures"))
    return rows.select("row", "measures.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def _spare(value: Column) -> Column:
    """The binary digits of a value behind its first seven."""
    return F.greatest(F.length(F.bin(value)) - 7, F.lit(0))


def bucket(value: Column) -> Column:
    """A value with all but its first seven binary digits cleared."""
    spare = _spare(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def per_thousand(measure_name: str) -> Column:
    return F.expr(f"({measure_name} * 1000) div n_words")


def sketches(measured: DataFrame) -> DataFrame:
    """`name`, `lang`, `source`, `bucket`, `n`: the histogram of each measure of each group."""
    values = F.array(*[
        F.struct(F.lit(name).alias("name"), bucket(per_thousand(m)).alias("bucket")) for name, (m, *_) in RATIOS.items()
    ])
    return (
        measured.where((F.col("n_words") > 0) & ~base_failed())
        .select("lang", "source", F.explode(values).alias("v"))
        .groupBy("v.name", "lang", "source", "v.bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def _of_measure(place: int) -> Column:
    """What RATIOS says of the measure of a row."""
    return F.element_at(F.create_map(*[F.lit(x) for name, of in RATIOS.items() for x in (name, of[place])]), F.col("name"))


def quantiles(histogram: DataFrame) -> DataFrame:
    """`middle` and `high` of each measure and group of a histogram, whose rows are buckets, not documents."""
    whole = Window.partitionBy("name", "lang", "source")
    rising = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.withColumn("upto", F.sum("n").over(rising)).withColumn("all", F.sum("n").over(whole))

    def at(percent: Column) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("all") * percent, F.col("bucket")))

    return summed.groupBy("name", "lang", "source").agg(at(F.lit(50)).alias("middle"), at(_of_measure(1)).alias("high"))


def thresholds(histogram: DataFrame) -> DataFrame:
    """One row per (lang, source): the limit of each measure."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), _spare(F.col("high")))
    own = quantiles(histogram).withColumn("own", F.col("high") + _of_measure(2) * F.greatest(F.col("high") - F.col("middle"), width))
    votes = own.groupBy("name", "lang").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY own)").cast("long").alias("usual")).alias("l")
    joined = own.alias("o").join(votes, (F.col("o.name") == F.col("l.name")) & F.col("o.lang").eqNullSafe(F.col("l.lang")))
    limit = F.least(F.greatest("own", "usual"), F.col("usual") * TRUST)
    return joined.groupBy(F.col("o.lang").alias("t_lang"), F.col("source").alias("t_source")).agg(
        *[F.max(F.when(F.col("o.name") == n, limit)).alias(f"{n}_limit") for n in RATIOS]
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
          carry: bool = False) -> DataFrame:
    """`doc_id`, the measures, `base_failed` and `kept` for each row; with `carry` also `given`, the whole row.

    The texts are read once; their measures, some bytes each, are staged, summed up and joined with the thresholds, of which
    there is one row per (language, source), staged too, so that Spark knows its size.
    """
    given = [F.struct(*cols(docs.columns)).alias("given")] if carry else []
    measured = stage(
        measure(docs, col(key).alias("doc_id"), col(lang).alias("lang"), col(source).alias("source"), *given, text=text)
        .select("row.*", *_MEASURES),
        small_batches=True,
    )
    limits = stage(thresholds(sketches(measured)))
    joined = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left"
    )
    within = F.lit(True)
    for name, (m, *_) in RATIOS.items():
        within = within & (bucket(per_thousand(m)) <= F.col(f"{name}_limit"))
    return joined.select(
        "doc_id", *_MEASURES, base_failed().alias("base_failed"),
        F.when(base_failed(), False).otherwise(within).alias("kept"), *(["given"] if carry else []),
    )
