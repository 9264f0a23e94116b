"""Windows of a fixed number of units (words or bytes) that occur in more than one place.

To compare all windows with all would shuffle one row per unit of text.  Here each window is represented by an
anchor: the least, by hash, of the grams inside it (winnowing).  Neighbouring windows mostly share theirs, so a
text falls into *stretches*, each with the consecutive windows of one anchor, about 2 / (window - gram + 2) of them
per unit.  Equal windows have equal anchors wherever they are, so two steps find every window that occurs again:

1. Stretches are compared as wholes, by anchor and by a hash of all they hold.  Every stretch but the first of
   its kind is gone, with all its windows.  Each task settles this for its own stretches before anything is
   shuffled, so a passage in a third of all documents is one entry per task.
2. Where several kinds of stretches have one anchor, they have been cut at different places or differ at an end.
   Only the first stretch of each such kind is extended, window by window, and its windows are compared by hash.

An anchor that many kinds of stretches share is no hot group: a task hands on two of the kinds, which is enough to
tell all tasks that there are several, and its others go to the second step at once.  There, too, a task hands on a window once.

Entries travel as packed arrays, one row per task and bucket; documents are shuffled by id once.
Two stretches are equal if their 64-bit hashes, 32 more bits of their anchors' hashes and the anchors' buckets are; two windows if their 64-bit
hashes and 32 bits of a second hash of other numbers are.  With 10^13 windows two unlike ones agree in these 96 bits once in a thousand runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.arrays import PIECE, U64, Sums, Words, byte_units, column_bytes, mix, pack, runs, slices, unpack

#: Kinds of rows.  ENTRY: key is a bucket, data has packed entries.  GONE: key is a document, data has (start, length) of
#: what occurs before.  ASKED: key is a document, data has (start, windows) to be extended.
#: KEPT: as ENTRY, for entries that are the first of their kind so far.  OLD: as ENTRY, from an index.
ENTRY, GONE, ASKED, KEPT, OLD = range(5)
SCHEMA = "kind int, key long, data binary"
ENTRY_TYPES = [np.uint32, np.uint64, np.int64, np.uint32, np.uint16]  # anchor, hash, document, start, windows
GONE_TYPES = [np.uint32, np.uint32]
ASKED_TYPES = [np.uint32, np.uint16]  # start, windows
WINDOW_TYPES = [np.uint32, np.uint64, np.int64, np.uint32]  # second hash, hash, document, start

#: So many entries are held by a task before it settles and hands them on.
HELD = 400_000
_PLACE = U64((1 << 21) - 1)


@dataclass(frozen=True)
class Shape:
    """What a window is.

    window, gram       units in a window and in an anchor
    words              whether units are words (else bytes)
    inside_documents   whether an earlier place of the same document counts (else only documents with smaller ids)
    """

    window: int
    gram: int
    words: bool
    inside_documents: bool


def buckets_of(spark: SparkSession) -> int:
    """Some buckets for each partition of a shuffle, so that partitions get equal shares."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _units(body: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    if shape.words:
        words = Words(body, offsets)
        return words.hashes(), words.offsets
    return body, offsets


def _numbers(units: np.ndarray, shape: Shape) -> np.ndarray:
    return units if shape.words else byte_units(units)


def pieces(offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Groups of documents, or parts of a long one, that hold each window once.

    Which documents, where each begins in its document, where the group begins, and the bounds inside it.
    """
    sizes = np.diff(offsets)
    for a, b in runs(sizes, PIECE):
        if sizes[a] > PIECE:
            for low in range(0, int(sizes[a]) - window + 1, PIECE):
                high = min(int(sizes[a]), low + PIECE + window - 1)
                yield np.array([a]), np.array([low]), int(offsets[a]) + low, np.array([0, high - low])
        else:
            yield np.arange(a, b), np.zeros(b - a, np.int64), int(offsets[a]), offsets[a : b + 1] - offsets[a]


def stretches(units: np.ndarray, bounds: np.ndarray, shape: Shape):
    """Of each stretch: its document, start, number of windows, anchor and hash."""
    size = len(units) - shape.window + 1
    if size <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    sums = Sums(units)
    grams = sums.hash_all(shape.gram)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
    seen, wanted = 1, shape.window - shape.gram + 1
    while seen < wanted:
        step = min(seen, wanted - seen)
        least = np.minimum(least[:-step], least[step:])
        seen += step
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    windows = np.flatnonzero(owner[:size] == owner[shape.window - 1 :])
    anchor = (least[windows] & _PLACE).astype(np.int64)
    opens = np.ones(len(windows), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(opens)
    n = np.diff(np.append(at, len(windows)))
    start = windows[at]
    document = owner[start]
    return document, start - bounds[document], n, grams[anchor[at]], sums.hash(start, start + n + shape.window - 1)


def first_of_kind(entries: list[np.ndarray], shape: Shape) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The entries that no earlier one equals, and the others."""
    anchor, value, document, start = entries[:4]
    if not (document[1:] >= document[:-1]).all() or ((document[1:] == document[:-1]) & (start[1:] < start[:-1])).any():
        order = np.lexsort((start, document))
        entries = [e[order] for e in entries]
        anchor, value, document, start = entries[:4]
    order = np.argsort(value, kind="stable")
    entries = [e[order] for e in entries]
    anchor, value, document, start = entries[:4]
    opens = np.ones(len(value), bool)
    opens[1:] = (value[1:] != value[:-1]) | (anchor[1:] != anchor[:-1])
    head = np.maximum.accumulate(np.where(opens, np.arange(len(value)), 0))
    first = document == document[head]
    if shape.inside_documents:
        first &= start == start[head]
    return [e[first] for e in entries], [e[~first] for e in entries]


def united(document: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching intervals of a document as one."""
    order = np.lexsort((start, document))
    document, start, end = document[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(document):
        return document, start, end
    change = np.zeros(len(document), np.int64)
    change[1:] = document[1:] != document[:-1]
    rank = np.cumsum(change) << 33
    reach = np.maximum.accumulate(rank + end)
    opens = np.ones(len(document), bool)
    opens[1:] = rank[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(opens)
    return document[at], start[at], reach[np.append(at[1:], len(document)) - 1] - rank[at]


def _rows(kind: int, keys: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch | None:
    """One row per key with all that belongs to it."""
    if not len(keys):
        return None
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = [c[order] for c in columns]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(at[1:], len(keys))
    data = [pack(*(c[a:b] for c in columns)) for a, b in zip(at.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), kind, np.int32)), pa.array(keys[at].astype(np.int64)), pa.array(data, pa.binary())],
        names=["kind", "key", "data"],
    )


def _gone(entries: list[np.ndarray], shape: Shape) -> pa.RecordBatch | None:
    _, _, document, start, n = entries
    document, low, high = united(document, start, start.astype(np.int64) + n + shape.window - 1)
    return _rows(GONE, document, [low.astype(np.uint32), (high - low).astype(np.uint32)])


def _kinds_of_anchor(bucket: np.ndarray, anchor: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which kind of its anchor each entry is, from 0.  Anchors of two buckets may agree in the bits that are kept."""
    order = np.lexsort((value, anchor, bucket))
    opens = np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (bucket[order][1:] != bucket[order][:-1]))
    differs = opens | np.append(True, value[order][1:] != value[order][:-1])
    number = np.cumsum(differs)
    out = np.empty(len(anchor), np.int64)
    out[order] = number - np.maximum.accumulate(np.where(opens, number, 0))
    return out


def _stretches_handed_on(held: list[list[np.ndarray]], shape: Shape) -> Iterator[pa.RecordBatch]:
    """Of the stretches (bucket, then an entry) of a task, what others have to know."""
    bucket, *entries = (np.concatenate(c) for c in zip(*held))
    first, rest = first_of_kind([*(e.astype(t) for e, t in zip(entries, ENTRY_TYPES)), bucket], shape)
    few = _kinds_of_anchor(first[5], *first[:2]) < 2
    yield _rows(ENTRY, first[5][few], [c[few] for c in first[:5]])
    yield _rows(ASKED, first[2][~few], [c[~few] for c in first[3:5]])
    yield _gone(rest[:5], shape)


def _windows_handed_on(held: list[list[np.ndarray]], shape: Shape, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the windows (second hash, hash, document, start) of a task, the first of each kind."""
    first, rest = first_of_kind(_as_entries(*(np.concatenate(c) for c in zip(*held))), shape)
    yield _rows(ENTRY, first[1] % U64(buckets), first[:4])
    yield _gone(rest, shape)


def _as_entries(second: np.ndarray, value: np.ndarray, document: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Single windows as entries, whose second hash stands in the place of an anchor."""
    return [second.astype(np.uint32), value, document, start.astype(np.uint32), np.ones(len(value), np.uint16)]


def _collected(parts: Iterator[list[np.ndarray]], settle) -> Iterator[pa.RecordBatch]:
    """Rows of parts of entries; equal ones of a task meet here."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield from filter(None, settle(held))
            held, n = [], 0
    if n:
        yield from filter(None, settle(held))


def entries_of(texts: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """ENTRY, ASKED and GONE rows of the stretches of `doc`, `body`."""

    def scanned(batches):
        for batch in slices(batches, "body"):
            ids = batch.column("doc").to_numpy()
            units, offsets = _units(*column_bytes(batch.column("body")), shape)
            for docs, base, low, bounds in pieces(offsets, shape.window):
                part = _numbers(units[low : low + bounds[-1]], shape)
                document, start, n, anchor, value = stretches(part, bounds, shape)
                yield [anchor % U64(buckets), anchor >> U64(32), value, ids[docs[document]], base[document] + start, n]

    return texts.mapInArrow(lambda batches: _collected(scanned(batches), lambda held: _stretches_handed_on(held, shape)), SCHEMA)


def extended(asked: DataFrame, shape: Shape, buckets: int) -> DataFrame:
    """ENTRY and GONE rows of the single windows asked for, of `doc`, `body`, `data` (a list of ASKED data)."""

    def scanned(batches):
        for batch in slices(batches, "body"):
            ids = batch.column("doc").to_numpy()
            units, offsets = _units(*column_bytes(batch.column("body")), shape)
            for i, blobs in enumerate(batch.column("data").to_pylist()):
                start, n = unpack(blobs, ASKED_TYPES)
                start, at = np.unique(start, return_index=True)
                n = n[at].astype(np.int64)
                every = np.repeat(start.astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                every = every[every + shape.window <= offsets[i + 1] - offsets[i]]
                for a in range(0, len(every), PIECE):
                    places = every[a : a + PIECE]
                    low = int(places[0])
                    part = _numbers(units[offsets[i] + low : offsets[i] + int(places[-1]) + shape.window], shape)
                    ends = places - low + shape.window
                    second = Sums(mix(part)).hash(places - low, ends) >> U64(32)
                    yield [second, Sums(part).hash(places - low, ends), np.full(len(places), ids[i]), places]

    return asked.mapInArrow(lambda batches: _collected(scanned(batches), lambda held: _windows_handed_on(held, shape, buckets)), SCHEMA)


def _asked(first: list[np.ndarray], fresh: np.ndarray) -> pa.RecordBatch | None:
    """The firsts of their kind that have an anchor in common with another kind, one of them new."""
    order = np.lexsort((first[1], first[0]))
    anchor, value, document, start, n = (c[order] for c in first)
    fresh = fresh[order]
    if not len(anchor):
        return None
    at = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(anchor))))
    differs = np.zeros(len(anchor), np.int64)
    differs[1:] = (value[1:] != value[:-1]) & (anchor[1:] == anchor[:-1])
    wanted = (np.add.reduceat(differs, at) > 0) & (np.add.reduceat(fresh.astype(np.int64), at) > 0)
    pick = wanted[group]
    return _rows(ASKED, document[pick], [start[pick], n[pick]])


def met(rows: DataFrame, shape: Shape, partitions: int, ask: bool, keep: bool = False, single: bool = False) -> DataFrame:
    """Bring the entries of each bucket together: GONE rows, ASKED rows if `ask`, KEPT rows of new entries if `keep`.

    A bucket has at most one entry of each kind and task, whatever the number of its copies.  `single`: of windows.
    """

    def settle(key: int, blobs: list, old: list) -> Iterator[pa.RecordBatch]:
        new = _as_entries(*unpack(blobs, WINDOW_TYPES)) if single else unpack(blobs, ENTRY_TYPES)
        known = unpack(old, ENTRY_TYPES)
        mark = np.append(np.ones(len(new[0]), np.uint16), np.zeros(len(known[0]), np.uint16))
        both = [np.append(a, b) for a, b in zip(new, known)]
        both[4] = both[4] | (mark << np.uint16(15))  # whether it is new travels in the topmost bit of `windows`
        first, rest = first_of_kind(both, shape)
        fresh = first[4] >> np.uint16(15) == 1
        for part in (first, rest):
            part[4] = part[4] & np.uint16(0x7FFF)
        out = [_gone(rest, shape)]
        if ask:
            out.append(_asked(first, fresh))
        if keep:
            out.append(_rows(KEPT, np.full(int(fresh.sum()), key), [c[fresh] for c in first]))
        yield from (rows for rows in out if rows is not None)

    def merged(batches):
        key, new, old = None, [], []
        for batch in batches:
            passed = batch.filter(pa.compute.is_in(batch.column("kind"), pa.array([GONE, ASKED], pa.int32())))
            if passed.num_rows:
                yield passed
            for kind, k, cell in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), batch.column("data")):
                if kind in (GONE, ASKED):
                    continue
                data = cell.as_buffer()  # not a copy
                if k != key:
                    if new or old:
                        yield from settle(key, new, old)
                    key, new, old = k, [], []
                (old if kind == OLD else new).append(data)
        if new or old:
            yield from settle(key, new, old)

    return rows.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(merged, SCHEMA)


def by_document(rows: DataFrame, kind: int) -> DataFrame:
    """`doc` and `data`, all that was found for a document; no more than the document's own size."""
    return rows.where(F.col("kind") == kind).groupBy(F.col("key").alias("doc")).agg(F.collect_list("data").alias("data"))


def all_gone(texts: DataFrame, found: DataFrame, shape: Shape, buckets: int, partitions: int) -> DataFrame:
    """`doc` and `data` (lists of GONE data) of all that occurs before, from what the first step found.

    Whoever joins the same `texts` with this again by `doc` gets their shuffle for nothing, as Spark uses it twice.
    """
    asked = texts.join(by_document(found, ASKED).hint("shuffle_hash"), "doc")
    more = met(extended(asked, shape, buckets), shape, partitions, ask=False, single=True)
    return by_document(found.where(F.col("kind") == GONE).unionByName(more), GONE)


def without_repeats(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """`texts` with `data` from `gone`, null where nothing is gone."""
    return texts.join(gone.hint("shuffle_hash"), "doc", "left")


def gone_in(blobs: list[bytes] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of units that are gone from a text of that size."""
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, length = (c.astype(np.int64) for c in unpack(blobs, GONE_TYPES))
    end = np.minimum(start + length, size)
    inside = start < end
    _, start, end = united(np.zeros(int(inside.sum()), np.int64), start[inside], end[inside])
    return start, end
