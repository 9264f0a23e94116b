"""Phrase collocation mining: the words that stand together more often than their parts do, per language.

Text: A-Z in lower case, cut into pieces at BREAKS and pieces into words at blanks and tabs.  A phrase is two to LONGEST words in a row of one piece
that occur SUPPORT times or more in their language, overlaps included.

Method: SON partitioning.  Documents are dealt to SHARDS shards by a hash of their ids.  A phrase with support in its language has, in one shard at
least, its share of it: as much of SUPPORT as the shard has of the language's words, rounded up.
1. Words are counted exactly, as all of them are needed.  Each shard is then mined completely at that lowered support, by the number of words: a phrase
   can only be frequent in a shard if both its parts, all words but the last and all but the first, are.  A shard is counted by all tasks: they count the hashes of phrases piece by piece of text and
   send them, sorted and cut to KEY bits, to the bucket of the hash, where counts of a shard add up.
2. The union of what is frequent in some shard is kept as a filter of FILTER bits by hash, the same size for any input.  Equal hashes and equal places in
   the filter let through more, never less.
3. All phrases that pass the filter are counted globally by their words, so counts are exact; those without support go.

A phrase cut after its first k words has l occurrences of the first part, r of the rest and the score floor(SCALE * a / (l + r)); the cut with the lowest
score counts, of ties the first.  A phrase that lies in a longer one with at least ABSORBED percent of its occurrences is dropped.

* A null or empty text has no words.  A null language is `und`.  A null id is dealt like any other value.
* Equal rows count each, as do rows with one id.  Ties are settled by score, occurrences, then the phrase's UTF-8 bytes.
* A long text is counted in pieces that share LONGEST - 1 words, each phrase where it starts.
* No row, or no word: no row.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.llm.arrays import U64, Words, column_bytes, mix, pack, unpack
from sediment.llm.columns import bytes_of
from sediment.staging import stage
from sediment.types import col

SUPPORT, LONGEST, TOP = 30, 4, 2000
SCALE, ABSORBED = 2_000_000, 80
SHARDS = 8
#: The filter's size as a power of two in bits, for each number of words (16 MB).
FILTER = 27
#: The first bits of a hash by which a shard tells its phrases apart.  More than FILTER, as counts of phrases with equal ones add up.
KEY = 40
#: Bytes of text that a task counts at a time, words of the input for each bucket, and entries of a bucket that are held before equal ones are added up.
HELD, WORDS, ENTRIES = 4_000_000, 1 << 21, 1 << 22

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK = np.isin(np.arange(256), list(BREAKS))
_APART = _BREAK | np.isin(np.arange(256), list(BLANKS))
_NEXT = re.compile(rb"[ \t.,;:!?\x0A-\x0D]")
_OVER = re.compile(rb"(?:[ \t.,;:!?\x0A-\x0D]+[^ \t.,;:!?\x0A-\x0D]+){0,%d}" % (LONGEST - 1))


def pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in pieces, each with the words after it that its last phrases need, and where its own words end."""
    at = 0
    while at < len(text):
        end = _NEXT.search(text, at + HELD)
        end = end.start() if end else len(text)
        yield text[at : _OVER.match(text, end).end()], end - at
        at = end


class Piece:
    """The words of some texts that are worked on at a time.

    codes     each word's place in `words`, the different ones (also as an Arrow array, `column`)
    group     the number of each word's group
    own       whether a phrase that starts here is counted here
    """

    def __init__(self, texts: list[tuple[int, bytes, int]]):
        sizes = np.array([len(t[1]) for t in texts])
        offsets = np.append(0, np.cumsum(sizes))
        body = np.frombuffer(b"".join(t[1] for t in texts).lower(), np.uint8)  # bytes: A-Z alone
        found = Words(body, offsets, _APART)
        owner = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
        self.group = np.array([t[0] for t in texts], np.int32)[owner]
        self.own = found.starts < (offsets[:-1] + np.array([t[2] for t in texts]))[owner]
        breaks = np.cumsum(_BREAK[body], dtype=np.int32)
        apart = np.ones(len(owner), bool)
        if len(owner):
            starts = breaks[found.starts]
            apart[1:] = (starts[1:] != starts[:-1]) | (owner[1:] != owner[:-1])
        self.segment = np.cumsum(apart)
        ends = np.append(0, np.cumsum(found.ends - found.starts))
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body[found.inside]))])
        coded = every.dictionary_encode()
        self.codes, self.column = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.words = self.column.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each

    def starts(self, k: int) -> np.ndarray:
        """Where phrases of k words start that are counted here."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.own[:n] & (self.segment[:n] == self.segment[k - 1 :]))

    def hashes(self, seeds: np.ndarray, longest: int) -> list[np.ndarray]:
        """For one word, two words and so on, the hash of the phrase at every place; `seeds` tells languages apart."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], U64)[self.codes] if self.words else np.zeros(0, U64)
        out = [mix(own ^ seeds[self.group])]
        for k in range(2, longest + 1):
            out.append(mix(out[-1][:-1] * U64(0x9E3779B97F4A7C15) + own[k - 1 :]) if len(out[-1]) else out[-1])
        return out


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode(), 1)


def _passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> U64(64 - FILTER)
    return (filter_[place >> U64(3)] >> (place & U64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _read(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[list[tuple], Piece]]:
    """Texts in amounts of HELD bytes: the different keys, whose places are the groups, and the words."""
    groups: dict[tuple, int] = {}
    texts, size = [], 0
    for batch in batches:
        for *key, body in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("body")):
            for text, own in pieces(body.as_py()):
                texts.append((groups.setdefault(tuple(key), len(groups)), text, own))
                size += len(text)
                if size >= HELD:
                    yield list(groups), Piece(texts)
                    groups, texts, size = {}, [], 0
    if texts:
        yield list(groups), Piece(texts)


def _distinct(piece: Piece, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each different phrase of each group starts first, and its number; by words, not by hashes."""
    ids, different = piece.group[places].astype(np.int64), int(piece.group.max(initial=0)) + 1
    for i in range(k):
        if different * len(piece.words) >= 1 << 63:  # number what is there so far, so that a word more fits
            _, ids = np.unique(ids, return_inverse=True)
            different = len(places)
        ids = ids * len(piece.words) + piece.codes[places + i]
        different *= len(piece.words)
    _, first, n = np.unique(ids, return_index=True, return_counts=True)
    return places[first], n


def _joined(piece: Piece, places: np.ndarray, k: int) -> pa.Array:
    """The phrases of k words that start at some places, as text."""
    words = [piece.column.take(pa.array(piece.codes[places + i])) for i in range(k)]
    return pc.binary_join_element_wise(*words, pa.scalar(b" ", piece.column.type)).cast(pa.string())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word of a language is in a piece (shard -1), and how many words a shard has of a language (no phrase)."""
    for groups, piece in _read(batches, "shard", "lang"):
        langs = sorted({g[1] for g in groups})
        number = np.array([langs.index(g[1]) for g in groups], np.int32)
        at = piece.starts(1)
        sizes = np.bincount(piece.group[at], minlength=len(groups))
        piece.group = number[piece.group]
        at, n = _distinct(piece, at, 1)
        shard = [*(g[0] for g in groups), *[-1] * len(at)]
        lang = pa.concat_arrays([pa.array([g[1] for g in groups], pa.string()), pa.array(langs, pa.string()).take(pa.array(piece.group[at]))])
        phrase = pa.concat_arrays([pa.nulls(len(groups), pa.string()), _joined(piece, at, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), lang, phrase, pa.array(np.append(sizes, n))], names=["shard", "lang", "phrase", "a"])


_BLOCK = "bucket int, data binary"
_ENTRY = [np.uint32, U64, np.uint32]  # group, what the hash's first bits are more than those of the entry before, count
_FIRST_BITS = U64((1 << KEY) - 1)


def _blocks(groups: np.ndarray, hashes: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries as one row for each bucket."""
    bits = buckets.bit_length() - 1
    bucket = (hashes >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    there = np.flatnonzero(np.diff(bounds)).tolist()
    firsts = hashes[order] >> U64(64 - KEY)
    more = np.diff(firsts, prepend=U64(0)) & _FIRST_BITS
    more[bounds[there]] = firsts[bounds[there]]
    entries = [c.astype(kind) for c, kind in zip((groups[order], more, n[order]), _ENTRY)]
    data = [pack(*(c[bounds[i] : bounds[i + 1]] for c in entries)) for i in there]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _entries(block) -> list[np.ndarray]:
    """Groups, the first KEY bits of hashes, and counts of a row of `_blocks`."""
    groups, more, n = unpack([block], _ENTRY)
    return [groups, np.cumsum(more, dtype=U64) & _FIRST_BITS, n]


def _word_blocks(buckets: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds: dict[str, int] = {}
            keys = [xxhash.xxh3_64_intdigest(w.encode()) ^ seeds.setdefault(g, _seed(g)) for g, w in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
            hashes = np.unique(mix(np.array(keys, U64)))
            yield _blocks(np.zeros(len(hashes)), hashes, np.ones(len(hashes)), buckets)

    return blocks


def _mined(k: int, below, buckets: int, numbers: dict[tuple[int, str], int]):
    """Of phrases of k words whose two parts pass the filter of one word less: hashes and counts by shard and language, which have numbers."""
    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, piece in _read(batches, "shard", "lang"):
            hashes = piece.hashes(np.array([_seed(g[1]) for g in groups], U64), k)
            at = piece.starts(k)
            at = at[_passes(below.value, hashes[k - 2][at])]
            # The part without the first word has the hash of a phrase that starts there.
            at = at[_passes(below.value, hashes[k - 2][at + 1])]
            order = np.argsort(piece.group[at], kind="stable")
            found, bounds = hashes[k - 1][at[order]], np.searchsorted(piece.group[at[order]], np.arange(len(groups) + 1))
            parts = []
            for g, a, b in zip(groups, bounds[:-1], bounds[1:]):
                if a < b:
                    different, n = np.unique(found[a:b], return_counts=True)
                    parts.append((np.full(len(different), numbers[g]), different, n))
            if parts:
                yield _blocks(*(np.concatenate(c) for c in zip(*parts)), buckets)

    return mined


def _added(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Counts of equal hashes of a group added up."""
    groups, hashes, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((hashes, groups))
    groups, hashes, n = groups[order], hashes[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (groups[1:] != groups[:-1])))
    return [groups[starts], hashes[starts], np.add.reduceat(n, starts)]


def _frequent(least: np.ndarray, buckets: int):
    """Each bucket's part of the filter: what is frequent in some shard."""
    width = (1 << FILTER) // buckets

    def part(bucket: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        groups, hashes, n = _added(parts)
        bits = np.zeros(width, bool)
        bits[(hashes[n >= least[groups]] >> U64(KEY - FILTER)) - U64(bucket * width)] = True
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["bucket", "bits"])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, size = None, [], 0
        for batch in batches:
            for own, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                if own != bucket:
                    if parts:
                        yield part(bucket, parts)
                    bucket, parts, size = own, [], 0
                parts.append(_entries(data.as_buffer()))
                size += len(parts[-1][0])
                if size > ENTRIES:  # equal hashes of many pieces become one entry
                    parts = [_added(parts)]
                    size = 0
        if parts:
            yield part(bucket, parts)

    return frequent


def _filter(blocks: DataFrame, least: np.ndarray, buckets: int):
    """The filter of phrases that are frequent in some shard, as a broadcast value of a fixed size."""
    ordered = blocks.repartition("bucket").sortWithinPartitions("bucket")
    width = (1 << FILTER) // buckets // 8
    bits = np.zeros((1 << FILTER) // 8, np.uint8)
    for row in ordered.mapInArrow(_frequent(least, buckets), "bucket int, bits binary").collect():
        bits[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(bits)


def _exact(filters: list):
    """Phrases of two words and more that pass the filter of their number of words, with their counts in a piece."""
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, piece in _read(batches, "lang"):
            hashes = piece.hashes(np.array([_seed(g[0]) for g in groups], U64), len(filters) + 1)
            for k, filter_ in enumerate(filters, 2):
                at = piece.starts(k)
                at, n = _distinct(piece, at[_passes(filter_.value, hashes[k - 1][at])], k)
                lang = pa.array([g[0] for g in groups], pa.string()).take(pa.array(piece.group[at]))
                yield pa.RecordBatch.from_arrays([lang, _joined(piece, at, k), pa.array(n, pa.int64())], names=["lang", "phrase", "a"])

    return exact


def phrase_counts(docs: DataFrame, key: str, text: str, lang: str, support: int, longest: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Staged: `lang`, `phrase`, `words` and `a` of all phrases and words with support; `lang` and `n`, all words of each language."""
    texts = docs.select(
        F.pmod(F.xxhash64(col(key)), shards).cast("int").alias("shard"), F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"),
        bytes_of(text).alias("body"),
    )
    counts = texts.mapInArrow(_words, "shard int, lang string, phrase string, a long").groupBy("shard", "lang", "phrase").agg(F.sum("a").alias("a"))
    counts = stage(counts.where((F.col("shard") >= 0) | (F.col("a") >= support)))
    words = counts.where("shard = -1").select("lang", "phrase", "a")
    sizes = counts.where("shard >= 0").select("shard", "lang", F.col("a").alias("n"))
    totals = stage(sizes.groupBy("lang").agg(F.sum("n").alias("n")))
    # One number for each shard and language, for all texts.
    shares = sizes.join(totals.withColumnRenamed("n", "all"), "lang").where("n > 0").collect()
    numbers = {(r["shard"], r["lang"]): i for i, r in enumerate(shares)}
    lowered = np.array([-(-support * r["n"] // r["all"]) for r in shares])
    buckets = min(1 << max(3, sum(r["n"] for r in shares) // WORDS).bit_length(), 1 << (FILTER - 3))
    filters = [_filter(words.mapInArrow(_word_blocks(buckets), _BLOCK), np.ones(1), buckets)]
    for k in range(2, longest + 1):
        filters.append(_filter(texts.mapInArrow(_mined(k, filters[-1], buckets, numbers), _BLOCK), lowered, buckets))

    found = texts.mapInArrow(_exact(filters[1:]), "lang string, phrase string, a long")
    found = found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= support).unionByName(words)
    return stage(found.withColumn("words", F.size(F.split("phrase", " ")))), totals


def _exactly(column: str):
    return F.col(column).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST,
    top: int = TOP, shards: int = SHARDS,
) -> DataFrame:
    """`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score` and `cut` of the first `top` phrases of each language."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have two to {LONGEST} words")
    counted, totals = phrase_counts(docs, key, text, lang, support, longest, shards)
    phrases = counted.where("words > 1")

    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cut = cut.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - words)")})
    left = counted.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counted.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    parted = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    parts = {"scaled": F.lit(SCALE).cast("decimal(7,0)") * _exactly("a"), "both": _exactly("l") + _exactly("r")}
    lowest = parted.withColumns(parts).withColumn("score", F.expr("scaled div both")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("at")
    )

    inside = phrases.where("words > 2").select("lang", "a", "words", F.split("phrase", " ").alias("w"))
    inside = inside.select("lang", "a", "words", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from"))
    longer = inside.select("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = _exactly("longer") * F.lit(100) >= _exactly("a") * F.lit(ABSORBED)

    order = Window.partitionBy("lang").orderBy(F.desc("at.score"), F.desc("a"), "phrase")
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "at.l", "at.r", "n", F.col("at.score").cast("long").alias("score"),
        F.col("at.cut").cast("long").alias("cut"),
    )
