"""SimHash near-dedup: 64-bit fingerprints of texts, linked where few bits differ.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's shingles: three words,
joined by one space, A-Z in lower case, repeats counted; all words of a text that has fewer.  A text without words has fingerprint 0.

Links by pigeonhole.  A fingerprint is cut into BLOCKS blocks.  If DISTANCE bits differ, at least BLOCKS - DISTANCE blocks are
equal, so that each pair that is close enough meets for one of the choices of that many blocks.  Fingerprints, each once however
many texts have it, are joined on the bits of every choice and compared bit by bit.

A choice fixes about 32 bits, which can still be those of very many fingerprints.  Where more than HELD meet, the other bits are
cut again into FINER blocks, all but DISTANCE of which must be equal: then at most some thousand values are left for the bits that may differ,
and no group is larger than that, whatever the data.  A group is compared in one task, from which a forest of its links comes out, not its pairs.

* Null text: no words.  A null id counts as smaller than all others; its component has a null id.
* Each row has a row in the result, rows with one id or the same row again as well.
* No row: no row.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.columns import id_back, keyed_texts
from sediment.llm.components import components
from sediment.staging import stage

SHINGLE, SEED, DISTANCE = 3, 42, 3
BLOCKS, FINER, HELD = 6, 8, 4096
#: Bytes of a text that are made words at a time.
PIECE = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, so many at a time."""
    at = 0
    while at < len(text):
        end = _BLANK.search(text, at + PIECE)
        end = end.start() if end else len(text)
        yield text[at:end].translate(_LOWER).split()
        at = end


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """Of all shingles of some words."""
    text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    found = [xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]
    return np.array(found, np.uint64)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text, as a signed number."""
    set_bits, n, before = np.zeros(64, np.int64), 0, []
    for words in _words(text):
        words = before + words
        if len(words) >= SHINGLE:
            hashes = _hashes(words, SHINGLE)
            set_bits += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(hashes)
        before = words[-(SHINGLE - 1) :]
    if not n and before:
        hashes = _hashes(before, len(before))
        set_bits, n = np.unpackbits(hashes.astype(">u8").view(np.uint8)), 1
    return int(np.packbits(2 * set_bits > n).view(">i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(body.as_py()) for body in batch.column("body")]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(prints, pa.int64())], names=["doc", "print"])


def _cut(bits: list[int], blocks: int) -> list[int]:
    """Some of 64 bits in blocks of nearly one size, each as a mask."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), blocks)]


def choices(bits: list[int], blocks: int, distance: int) -> list[int]:
    """Masks one of which two fingerprints have in common, if at most `distance` of these bits differ."""
    return [sum(chosen) for chosen in combinations(_cut(bits, blocks), blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among some fingerprints, each once: one for each but the first of a component."""
    links, rest = [], prints
    while len(rest):
        root, open_, rest = rest[0], [rest[0]], rest[1:]
        while open_ and len(rest):
            near = np.bitwise_count(rest ^ open_.pop()) <= distance
            found, rest = rest[near], rest[~near]
            open_ += list(found)
            links += [(x, root) for x in found]
    return links


def _linked(distance: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts: list[np.ndarray]) -> list[tuple[int, int]]:
            return forest(np.concatenate(parts), distance) if parts else []

        key, parts = None, []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "finer", "bits")]
            prints = batch.column("print").to_numpy().view(np.uint64)
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            bounds, out = [0, *new.tolist(), len(prints)], []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = tuple(c[a] for c in columns)
                if own != key:
                    out += links(parts)
                    key, parts = own, []
                parts.append(prints[a:b])
            yield _batch(out)
        yield _batch(links(parts))

    def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
        ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 1]), pa.array(ends[:, 0])], names=["pivot", "node"])

    return linked


def links_within(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, held: int = HELD) -> DataFrame:
    """Links (`pivot`, `node`) that connect what is connected among staged fingerprints (`print`, each once)."""
    first = choices(list(range(64)), blocks, distance)
    keyed = prints.select("print", F.posexplode(_masks(first)).alias("choice", "mask")).select(
        F.col("choice").cast("byte").alias("choice"), F.col("print").bitwiseAND(F.col("mask")).alias("bits"), "print"
    )
    met = stage(keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    together = keyed.join(met, ["choice", "bits"])
    groups = together.where(F.col("n") <= held).select("choice", F.lit(-1).alias("finer"), "bits", "print")

    finer = [choices([b for b in range(64) if not mask >> b & 1], FINER, distance) for mask in first]
    more = F.element_at(F.array(*[_masks(m) for m in finer]), F.col("choice") + 1)
    split = together.where(F.col("n") > held).select("choice", "bits", "print", F.posexplode(more).alias("finer", "mask")).select(
        "choice", "finer", F.col("bits").bitwiseOR(F.col("print").bitwiseAND(F.col("mask"))).alias("bits"), "print"
    )
    key = ["choice", "finer", "bits"]
    return groups.unionByName(split).repartition(*key).sortWithinPartitions(*key).mapInArrow(_linked(distance), "pivot long, node long")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """`doc_id`, `fingerprint` (16 lowercase hex digits) and `component_id` (the smallest id of its component) of each row."""
    signed = stage(keyed_texts(docs, key, text).mapInArrow(_fingerprints, "doc long, print long"))
    prints = stage(signed.groupBy("print").agg(F.min("doc").alias("doc")))
    roots = components(stage(links_within(prints, distance)))
    rooted = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    first = rooted.groupBy("root").agg(F.min("doc").alias("component"))
    of_print = stage(rooted.join(first, "root").select("print", "component"))
    return signed.join(of_print, "print").select(
        id_back("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), id_back("component").alias("component_id")
    )
