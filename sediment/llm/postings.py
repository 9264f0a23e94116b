"""Benchmark decontamination: which documents hold phrases of a benchmark.

Method: a distributed positional inverted index.  Each block of documents stores its terms in order and, for each,
the places where it occurs.  A phrase starts from the postings of its rarest term in the block, moved
by the term's offset, and intersects them with those of its other terms from rare to common; what is left are
exact matches.  A phrase one of whose terms a block lacks is dropped there at once.  `near` finds places that hold all
terms of a phrase, in any order, within a stretch of words.

The index is partitioned by document, so no posting is shuffled, a common term is spread over all blocks and a
hot document list can't exist.  The query set is cut into blocks of BLOCK phrases, and each block of the
index meets each block of the query set; neither has to fit into one task as a whole.

* A null or empty text has no words and no hit; so has a null or empty item.  An item of fewer words than
  `window` is one phrase.  Items with one id count as one; a missing item id is the item named ''.
* A missing document id is one document; rows with one id get the hits of all of them.
* A document is in one block whatever its length; a block of several has BLOCK_BYTES at most.
* No row: no row.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.arrays import PIECE, U64, Words, column_bytes, pack, slices, unpack
from sediment.llm.columns import bytes_of, id_back, keyed_texts
from sediment.llm.windows import GONE_TYPES, united
from sediment.staging import stage
from sediment.types import col

#: Bytes of the documents of a block of the index, and phrases in a block of the query set.
BLOCK_BYTES, BLOCK = 1 << 22, 50_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: What is not in a word, after A-Z have become a-z: all of ASCII but digits and letters.
SEPARATORS = np.zeros(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    SEPARATORS[_low : _high + 1] = True

INDEX = "docs binary, terms binary, places binary"
HITS = "doc long, hits binary, items array<string>"


def _terms(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(LOWER[body], offsets, SEPARATORS)
    return words.hashes(), words.offsets


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "body", BLOCK_BYTES):
        terms, bounds = _terms(*column_bytes(batch.column("body")))
        places = np.argsort(terms, kind="stable").astype(np.uint32)
        at = np.flatnonzero(np.append(True, np.diff(terms[places]) != 0)) if len(terms) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(terms)))
        docs = pack(batch.column("doc").to_numpy(), np.diff(bounds).astype(np.uint32))
        gaps = places.copy()
        gaps[1:] -= places[:-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.binary()) for x in (docs, pack(terms[places][at], count.astype(np.uint32)), pack(gaps))],
            names=["docs", "terms", "places"],
        )


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block: its documents with their numbers of words, its terms with their counts, and the places
    of each term, in the block's order of words."""
    return stage(keyed_texts(docs, key, text).mapInArrow(_indexed, INDEX))


class Block:
    """A block of the index, opened."""

    def __init__(self, docs: bytes, terms: bytes, places: bytes):
        self.docs, words = unpack([docs], [np.int64, np.uint32])
        self.bounds = np.append(0, np.cumsum(words.astype(np.int64)))
        self.terms, count = unpack([terms], [np.uint64, np.uint32])
        self.count = count.astype(np.int64)
        (gaps,) = unpack([places], [np.uint32])
        self.places = np.cumsum(gaps, dtype=np.uint32).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.term_at = np.zeros(len(self.places), U64)  # the postings the other way round: which term is at a place
        self.term_at[self.places] = np.repeat(self.terms, self.count)

    def looked_up(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that have all terms here; for them the terms' numbers, and their offsets from rare to common."""
        if not len(self.terms):
            return np.zeros(0, np.int64), phrases[:0].astype(np.int64), phrases[:0].astype(np.int64)
        number = np.minimum(np.searchsorted(self.terms, phrases), len(self.terms) - 1)
        used = np.arange(phrases.shape[1]) < size[:, None]
        alive = np.flatnonzero(((self.terms[number] == phrases) | ~used).all(axis=1))
        often = np.where(used[alive], self.count[number[alive]], np.iinfo(np.int64).max)
        return alive, number[alive], np.argsort(often, axis=1, kind="stable")

    def starts(self, number: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places of each phrase's rarest term: the phrases' numbers, and where it is, PIECE or so at a time."""
        rarest = number[np.arange(len(number)), offset[:, 0]]
        n = self.count[rarest]
        upto = np.cumsum(n)
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PIECE, "right")))
            which = np.repeat(np.arange(a, b), n[a:b])
            inner = np.arange(len(which)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            yield which, self.places[self.first[rarest[which]] + inner]
            a = b

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, place, "right") - 1

    def exact(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and place of each occurrence of each phrase."""
        alive, number, offset = self.looked_up(phrases, size)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for which, place in self.starts(number, offset):
            start = place - offset[which, 0]
            n = size[alive[which]]
            fits = (start >= 0) & (start + n <= len(self.term_at))
            which, start, n = which[fits], start[fits], n[fits]
            inside = self.document(start) == self.document(start + n - 1)
            which, start, n = which[inside], start[inside], n[inside]
            for k in range(1, phrases.shape[1]):
                o = offset[which, k]
                fine = (k >= n) | (self.term_at[np.minimum(start + o, len(self.term_at) - 1)] == phrases[alive[which], o])
                which, start, n = which[fine], start[fine], n[fine]
            out.append((alive[which], start))
        return np.concatenate([w for w, _ in out]), np.concatenate([s for _, s in out])

    def near(self, phrases: np.ndarray, size: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of each phrase, and each place of its rarest term that lies in a stretch of at most `slop` words
        more than the phrase that holds all its terms."""
        alive, number, offset = self.looked_up(phrases, size)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for some, places in self.starts(number, offset):
            for a in range(0, len(some), PIECE // 64):
                which, place = some[a : a + PIECE // 64], places[a : a + PIECE // 64]
                reach = int((size[alive[which]] + slop).max()) - 1
                around = place[:, None] + np.arange(-reach, reach + 1)
                document = self.document(place)
                outside = (around < self.bounds[document, None]) | (around >= self.bounds[document + 1, None])
                terms = self.term_at[np.clip(around, 0, len(self.term_at) - 1)]
                span = size[alive[which]] + slop
                low = np.arange(reach + 1)
                within = (low[None, :] + span[:, None] > reach) & (low[None, :] >= reach + 1 - span[:, None])
                last = np.minimum(low[None, :] + span[:, None], 2 * reach + 1)
                for k in range(phrases.shape[1]):
                    here = np.zeros((len(which), 2 * reach + 2), np.int64)
                    np.cumsum((terms == phrases[alive[which], k][:, None]) & ~outside, axis=1, out=here[:, 1:])
                    has = np.take_along_axis(here, last, 1) > here[:, : reach + 1]
                    within &= has | (k >= size[alive[which]])[:, None]
                found = within.any(axis=1)
                out.append((alive[which[found]], place[found]))
        return np.concatenate([w for w, _ in out]), np.concatenate([s for _, s in out])


def phrases_of(items: DataFrame, window: int, key: str = "item_id", text: str = "text", least: int = 1) -> DataFrame:
    """Blocks of the query set: `item` (text), `size` and `phrases`, packed; of items of at least `least` words."""

    def cut(batches):
        for batch in slices(batches, "body"):
            terms, bounds = _terms(*column_bytes(batch.column("body")))
            names = batch.column("item").to_pylist()
            rows = []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                size = min(window, b - a)
                if size and b - a >= least:
                    n = b - a - size + 1
                    found = np.zeros((n, window), U64)
                    found[:, :size] = np.lib.stride_tricks.sliding_window_view(terms[a:b], size)
                    found = np.unique(found, axis=0)
                    rows += [(names[i], size, found[k : k + BLOCK]) for k in range(0, len(found), BLOCK)]
            held, n = [], 0
            for row in rows:
                if n and n + len(row[2]) > BLOCK:
                    yield block(held)
                    held, n = [], 0
                held.append(row)
                n += len(row[2])
            if held:
                yield block(held)

    def block(rows):
        matrix = np.concatenate([r[2] for r in rows])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([[r[0] for r in rows]], pa.list_(pa.string())),
                pa.array([[len(r[2]) for r in rows]], pa.list_(pa.int64())),
                pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
                pa.array([matrix.tobytes()], pa.binary()),
            ],
            names=["names", "numbers", "sizes", "matrix"],
        )

    named = items.select(F.coalesce(col(key).cast("string"), F.lit("")).alias("item"), bytes_of(text).alias("body"))
    return named.mapInArrow(cut, "names array<string>, numbers array<long>, sizes array<long>, matrix binary")


def search(index: DataFrame, phrases: DataFrame, window: int, slop: int | None = None) -> DataFrame:
    """`doc`, `hits` (packed start and length, in words) and `items` of each block of the query set and document with hits.

    With `slop`, proximity instead of exact matches; a hit is then the place of the phrase's rarest term.
    """

    def matched(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["docs"], row["terms"], row["places"])
                matrix = np.frombuffer(row["matrix"], U64).reshape(-1, window)
                size = np.repeat(np.array(row["sizes"]), row["numbers"])
                item = np.repeat(np.arange(len(row["names"])), row["numbers"])
                which, start = block.exact(matrix, size) if slop is None else block.near(matrix, size, slop)
                length = size[which] if slop is None else np.ones(len(which), np.int64)
                document = block.document(start)
                order = np.argsort(document, kind="stable")
                document, start, length, which = document[order], start[order], length[order], which[order]
                at = np.flatnonzero(np.append(True, np.diff(document) != 0)) if len(document) else np.zeros(0, np.int64)
                hits, items = [], []
                for a, b in zip(at.tolist(), np.append(at[1:], len(document)).tolist()):
                    begin = start[a:b] - block.bounds[document[a]]
                    _, low, high = united(document[a:b], begin, begin + length[a:b])
                    hits.append(pack(low.astype(np.uint32), (high - low).astype(np.uint32)))
                    items.append([row["names"][i] for i in np.unique(item[which[a:b]])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.docs[document[at]]), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                    names=["doc", "hits", "items"],
                )

    return index.crossJoin(phrases).mapInArrow(matched, HITS)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs in batch.column("docs").to_pylist():
            ids, words = unpack([docs], [np.int64, np.uint32])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(words.astype(np.int64))], names=["doc", "n_words"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = []
        for blobs in batch.column("hits").to_pylist():
            start, length = (c.astype(np.int64) for c in unpack(blobs or [], GONE_TYPES))
            _, low, high = united(np.zeros(len(start), np.int64), start, start + length)
            n.append(int((high - low).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(n, pa.int64()), batch.column("items")], names=["doc", "n_hit", "items"]
        )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", least: int = 1) -> DataFrame:
    """`doc_id`, `n_words`, `n_hit`, `items` (sorted as text) and `contaminated` of each row of `docs`.

    Items of fewer than `least` words are no hit.
    """
    index = build_index(docs, key, text)
    # Staged, so that Spark knows how large the query set is and sends it to all tasks only if it is small.
    hits = search(index, stage(phrases_of(items, window, item_key, item_text, least)), window)
    found = (
        hits.groupBy("doc").agg(F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .mapInArrow(_covered, "doc long, n_hit long, items array<string>")
    )
    lengths = index.select("docs").mapInArrow(_lengths, "doc long, n_words long")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return lengths.join(found, "doc", "left").select(
        id_back("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"),
    )
