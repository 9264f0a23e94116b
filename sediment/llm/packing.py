"""Packing: documents as token sequences of one length, with little padding.

Method: shortest-pack-first over the length histogram.  The histogram has one row per length, at most `size`, whatever
the number of documents; on it, lengths are placed longest first, each into the packs that hold least, and
what is counted are packing patterns.  Every piece then finds its place by the rank it has among pieces of its length.

The rank is the piece's number in its staged file plus the pieces of that length in the files before: only
counts per file are summed up over files, so a length that a third of all pieces have is no large group.

* A null or empty text has the end token alone.  A missing id is one document.
* Rows with one id are packed each by itself.  A document over `size` is cut into whole sequences and a rest.
* No row: no row.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sediment.llm.arrays import Words, column_bytes, slices
from sediment.llm.columns import id_back, keyed_texts
from sediment.llm.postings import LOWER
from sediment.staging import stage

#: Runs of letters, or of other characters, whose ids a process remembers, some 40 bytes each.
REMEMBERED = 1_500_000
PIECES = "doc long, start long, length long, ids_crc32 long, doc_tokens long"

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
for _low, _high in ((0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
    _MARK[_low:_high] = True


class Tokens:
    """Ids of texts, by a tokenizer that makes small letters, drops white space and never joins a letter with a mark
    that follows it.  So texts are cut there, and the ids of each different run are made once and remembered.

    A special token may be written in a text with letters and marks; texts of a batch with "<|" are cut at white space alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of runs, sorted
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where a run's ids are
        self.ids_of_runs = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        """Make the ids of runs, which come in the order of their hashes."""
        found = [e.ids for e in self.tokenizer.encode_batch(runs, add_special_tokens=False)]
        count = np.array([len(f) for f in found], np.int64)
        first = len(self.ids_of_runs) + np.cumsum(count) - count
        self.ids_of_runs = np.concatenate([self.ids_of_runs, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(count.sum()))])
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.first, self.count = np.insert(self.first, place, first), np.insert(self.count, place, count)

    def ids(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a batch, and where each text's begin."""
        if b"<|" not in body.tobytes():
            body = LOWER[body]
            cuts = np.flatnonzero(_LETTER[body[:-1]] & _MARK[body[1:]]) + 1
            body, offsets = np.insert(body, cuts, 0x20), offsets + np.searchsorted(cuts, offsets)
        words = Words(body, offsets)
        different, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) + len(different) > REMEMBERED:
            self._forget()
        new = np.flatnonzero(~np.isin(different, self.known, assume_unique=True))
        if len(new):
            spans = zip(words.starts[at[new]].tolist(), words.ends[at[new]].tolist())
            data = body.tobytes()
            self._learn(different[new], [data[a:b].decode("utf-8", "replace") for a, b in spans])
        slot = np.searchsorted(self.known, different)[which]
        count = self.count[slot]
        upto = np.append(0, np.cumsum(count))
        inner = np.arange(upto[-1]) - np.repeat(upto[:-1], count)
        return self.ids_of_runs[np.repeat(self.first[slot], count) + inner], upto[words.offsets]


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One for each process, as its tasks have most words in common."""
    if path not in _tokens:
        _tokens.clear()
        _tokens[path] = Tokens(path)
    return _tokens[path]


def cut(docs: DataFrame, path: str, size: int, end: int, with_ids: bool, key: str, text: str) -> DataFrame:
    """The pieces of all documents: `doc`, `start`, `length`, `ids_crc32`, `doc_tokens` and, if asked for, `ids`."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for batch in slices(batches, "body"):
            every, bounds = tokens.ids(*column_bytes(batch.column("body")))
            rows, parts = [], []
            for doc, a, b in zip(batch.column("doc").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = np.append(every[a:b], np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    if with_ids:
                        parts.append(part.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = ["doc", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed_texts(docs, key, text).mapInArrow(pieces, PIECES + (", ids array<int>" if with_ids else ""))


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns and how many packs have each, for a histogram of lengths.

    A pattern is a tuple of (length, how many).  Packs with one pattern are handled together: a step places a length
    into all packs of the pattern that has most room, as often as they stay those with most room.
    """
    packs: list[tuple[int, int, tuple, int]] = []  # -room, a number to break ties, pattern, packs
    number = 0

    def put(room, pattern, n):
        nonlocal number
        number += 1
        heapq.heappush(packs, (-room, number, pattern, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not packs or -packs[0][0] < length:
                each = size // length
                for n, times in ((left // each, each), (1, left % each)):
                    if n and times:
                        put(size - times * length, ((length, times),), n)
                break
            room, _, pattern, n = heapq.heappop(packs)
            room, used = -room, min(n, left)
            next_room = -packs[0][0] if packs else 0
            times = max(1, min((room - next_room) // length, room // length, left // used))
            if used < n:
                put(room, pattern, n - used)
            if pattern[-1][0] == length:
                pattern, times_before = pattern[:-1], pattern[-1][1]
            else:
                times_before = 0
            put(room - times * length, (*pattern, (length, times_before + times)), used)
            left -= used * times
    return [(pattern, n) for _, _, pattern, n in sorted(packs)]


def slots(found: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """The patterns by length and rank: pieces of `length` with a rank from `first` on go to sequences from
    `sequence` on, `times` to each, from `offset` on."""
    rows, ranks, sequence = [], {}, 0
    for pattern, n in found:
        offset = 0
        for length, times in pattern:
            first = ranks.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            ranks[length] = first + n * times
            offset += length * times
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "times", "sequence", "offset"), table.T))


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end: int = 2, with_ids: bool = False,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset` (and `ids`) of each piece.

    `path` is the file of a tokenizer that drops white space; `end` is the id after each document.
    """
    staged = stage(cut(docs, path, size, end, with_ids, key, text), small_batches=True)
    pieces = staged.select("*", F.col("_metadata.file_name").alias("file"))
    counted = pieces.groupBy("length", "file").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(patterns(histogram, size))

    files_before = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "file", F.coalesce(F.sum("n").over(files_before), F.lit(0)).alias("before"))
    in_file = Window.partitionBy("length", "file").orderBy("doc", "start", "ids_crc32", "doc_tokens")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(in_file) - 1)
        .join(before, ["length", "file"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .select(*[c for c in staged.columns], "rank")
    )
    spread = np.append(0, np.cumsum(np.diff(table["length"]) != 0)) if len(table["length"]) else np.zeros(0, np.int64)
    lengths = np.unique(table["length"])
    bounds = (spread << 44) + table["first"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = np.searchsorted(bounds, (np.searchsorted(lengths, length) << 44) + rank, "right") - 1
            inner = rank - table["first"][slot]
            sequence = table["sequence"][slot] + inner // table["times"][slot]
            offset = table["offset"][slot] + inner % table["times"][slot] * length
            kept = batch.select([n for n in batch.schema.names if n != "rank"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"]
            )

    out = PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    found = ranked.mapInArrow(placed, out)
    return found.select(id_back("doc").alias("doc_id"), *[c for c in found.columns if c != "doc"])


def sequences(placed: DataFrame, size: int = 4096, pad: int = 0) -> DataFrame:
    """`sequence_id` and its `ids`, of pieces placed with their ids; padded to `size` unless the length is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    padding = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(size) - n)
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), padding)).alias("ids"))
