"""MinHash near-dedup: classes of texts that are equal or nearly equal.

Method: ProbMinHash.  A text is the set of its shingles of five words, each with a weight that is its own in all texts:
1, or with WEIGHTS "length" the bytes of its words.  Every shingle sends arrivals of a Poisson process with
its weight as rate to random registers; a register keeps the shingle that arrives first, and a shingle stops as
soon as its next arrival is later than the latest register.  Two texts agree in a register with the probability
of their probability Jaccard similarity, which for such weights is the weight they have in common as a share of all they have.
BANDS bands of ROWS registers give candidates (a pair at 0.8 is missed once in 300,000); links are verified exactly on the texts.

Classes are the connected components of the links of 0.8 or more.  Texts with equal words are one node, so copies
cost no pair.  Each text of a bucket is first compared with the bucket's earliest text, which mostly puts them into one class.
Only where texts of a bucket are then in different classes, those outside its largest class are compared with
all others of it: in tiles of some hundred texts by some hundred, each one product of matrices of which links
alone come out.  No pair is a row, and no text is sent more than once per tile.

* A null or empty text, or one without words, is in a class of its own.  A text of fewer than five words is one shingle.
* Rows with one id are one document if their words are equal; else each row has its own class, under that id.
* A missing id counts as smaller than all others; its class has a null id.
* No row: no row.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.arrays import PIECE, U64, Sums, Words, column_bytes, mix, runs, slices
from sediment.llm.columns import id_back, keyed_texts
from sediment.llm.components import components
from sediment.staging import stage
from sediment.types import col

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Texts on a side of a tile, and shingles that are multiplied at a time.
TILE, COLUMNS = 256, 4096


def shingles(words: Words, hashes: np.ndarray, a: int, b: int, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents a to b: document, shingle and weight, each shingle once, sorted."""
    low, high = words.offsets[a], words.offsets[b]
    bounds = words.offsets[a : b + 1] - low
    units, n = hashes[low:high], np.diff(bounds)
    owner = np.repeat(np.arange(b - a), n)
    sums = Sums(units)
    grams = sums.hash_all(SHINGLE)
    places = np.flatnonzero(owner[: len(grams)] == owner[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    document = np.concatenate([owner[places], short])
    value = np.concatenate([grams[places], sums.hash(bounds[short], bounds[short + 1])])
    if weights == "length":
        size = np.append(0, np.cumsum(words.ends[low:high] - words.starts[low:high]))
        weight = np.concatenate([size[places + SHINGLE] - size[places], size[bounds[short + 1]] - size[bounds[short]]])
    else:
        weight = np.ones(len(value), np.int64)
    order = np.lexsort((value, document))
    document, value, weight = document[order], value[order], weight[order]
    once = np.ones(len(value), bool)
    once[1:] = (document[1:] != document[:-1]) | (value[1:] != value[:-1])
    return document[once], value[once], weight[once]


def signatures(document: np.ndarray, value: np.ndarray, weight: np.ndarray, documents: int, registers: int) -> np.ndarray:
    """The shingle in each register of each document."""
    first = np.full(documents * registers, np.inf)
    kept = np.zeros(documents * registers, U64)
    latest = np.full(documents, np.inf)
    time = np.zeros(len(value))
    active, step = np.arange(len(value)), 0
    while len(active):
        step += 1
        seed = mix(value[active] + U64(step * 0x9E3779B97F4A7C15 % 2**64))
        time[active] -= np.log(((seed >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[active]
        active, seed = (x[time[active] < latest[document[active]]] for x in (active, seed))
        register = document[active] * registers + (mix(seed) % U64(registers)).astype(np.int64)
        better = time[active] < first[register]
        who, register = active[better], register[better]
        order = np.argsort(-time[who], kind="stable")  # of several arrivals at a register, the earliest is written last
        first[register[order]] = time[who[order]]
        kept[register[order]] = value[who[order]]
        touched = np.unique(document[who])
        latest[touched] = first.reshape(documents, registers)[touched].max(axis=1)
    return kept.reshape(documents, registers)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each document."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), parts.shape[:2])
    for i in range(rows):
        keys = mix(keys ^ parts[:, :, i]) + U64(0x9E3779B97F4A7C15)
    return keys


def _copy_key(text: bytes) -> bytes:
    """What texts with equal words have in common."""
    return hashlib.md5(b" ".join(text.split())).digest()


def copy_key(text: str) -> Column:
    """`_copy_key` as an expression; null for a text without words."""
    words = F.trim(F.regexp_replace(col(text), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(words != "", F.unhex(F.md5(words.cast("binary"))))


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [_copy_key(body.as_py()) == node.as_py() for body, node in zip(batch.column("body"), batch.column("node"))]
        yield batch.select(["doc", "node", "body"]).filter(pa.array(own, pa.bool_()))


def _signed(weights: str):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            body, offsets = column_bytes(batch.column("body"))
            words = Words(body, offsets)
            hashes, n = words.hashes(), np.diff(words.offsets)
            keys = [
                bands_of(signatures(*shingles(words, hashes, a, b, weights), b - a, BANDS * ROWS), BANDS, ROWS)
                for a, b in runs(n, PIECE)
            ]
            copies = [_copy_key(body[x:y].tobytes()) if m else None for x, y, m in zip(offsets[:-1], offsets[1:], n)]
            flat = np.concatenate(keys).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    pa.array(copies, pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, flat.size + 1, BANDS, dtype=np.int32), flat),
                ],
                names=["doc", "copy", "bands"],
            )

    return signed


def weighted(text: bytes, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of one text, sorted, and their weights."""
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    _, value, weight = shingles(words, words.hashes(), 0, 1, weights)
    return value, weight


def _in(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of some sorted numbers are among others."""
    return others[np.minimum(np.searchsorted(others, some), len(others) - 1)] == some


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two sets whose shingles have one weight in both."""
    common = y[1][_in(y[0], x[0])].sum()
    return common / (x[1].sum() + y[1].sum() - common)


def _compared(weights: str):
    """Links over the rows of each tile, the earliest text (`node` is null) before the others."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            out = []
            for i, (node, body) in enumerate(zip(batch.column("node"), batch.column("body"))):
                text = weighted(body.as_py(), weights)
                if not node.is_valid:
                    left = text
                elif similarity(left, text) >= SIMILARITY:
                    out.append(i)
            yield batch.select(["pivot", "node"]).take(pa.array(out, pa.int64()))

    return compared


def links_with_earliest(pairs: DataFrame, texts: DataFrame, weights: str) -> DataFrame:
    """Of staged pairs (`pivot`, `node`), those whose texts (`node`, `body`) are similar enough.

    A pivot with very many nodes is cut into tiles, each with the pivot's text once; in the join with the texts
    its pairs are on the side that adaptive execution splits.
    """
    sizes = stage(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("n")))
    cut = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("node"), "n").alias("tile"), "node")
    own = sizes.select(F.col("pivot").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("tile"))
    firsts = own.join(texts, "node").select(F.col("node").alias("pivot"), "tile", F.lit(None).cast("binary").alias("node"), "body")
    rows = cut.join(texts, "node").select("pivot", "tile", "node", "body").unionByName(firsts)
    ordered = rows.repartition("pivot", "tile").sortWithinPartitions("pivot", "tile", F.asc_nulls_first("node"))
    return ordered.mapInArrow(_compared(weights), "pivot binary, node binary")


def common_weight(some: list, others: list) -> np.ndarray:
    """The weight that each of some sorted weighted sets has in common with each of others."""
    out = np.zeros((len(some), len(others)))
    values = [np.concatenate([t[0] for t in side]) for side in (some, others)]
    shared = np.intersect1d(*values)
    weight = np.zeros(len(shared))
    sides = []
    for texts, value in zip((some, others), values):
        row = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
        column = np.searchsorted(shared, value)
        kept = column < len(shared)
        kept[kept] = shared[column[kept]] == value[kept]
        weight[column[kept]] = np.concatenate([t[1] for t in texts])[kept]
        order = np.argsort(column[kept], kind="stable")
        sides.append((row[kept][order], column[kept][order]))
    for low in range(0, len(shared), COLUMNS):
        n = min(COLUMNS, len(shared) - low)
        parts = []
        for texts, (row, column) in zip((some, others), sides):
            a, b = np.searchsorted(column, [low, low + n])
            dense = np.zeros((len(texts), n), np.float32)
            dense[row[a:b], column[a:b] - low] = 1
            parts.append(dense)
        out += (parts[0] * weight[low : low + n].astype(np.float32)) @ parts[1].T
    return out


def _tile_links(weights: str):
    """Links over the rows of each tile, between its `open` texts and the others."""
    def links(tile) -> pa.RecordBatch:
        sides = [[t for t in tile if t[0] == side] for side in (True, False)]
        pivots, nodes = [], []
        if sides[0] and sides[1]:
            texts = [[weighted(t[3], weights) for t in side] for side in sides]
            size = [np.array([t[1].sum() for t in side]) for side in texts]
            common = common_weight(*texts)
            similar = common >= SIMILARITY * (1 - 1e-12) * (size[0][:, None] + size[1][None, :] - common)
            for i, j in zip(*np.nonzero(similar)):
                if sides[0][i][2] != sides[1][j][2]:
                    pivots.append(sides[0][i][1])
                    nodes.append(sides[1][j][1])
        return pa.RecordBatch.from_arrays([pa.array(pivots, pa.binary()), pa.array(nodes, pa.binary())], names=["pivot", "node"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, []
        for batch in batches:
            for *own, side, node, root, body in zip(*(batch.column(c) for c in ("pivot", "i", "j", "open", "node", "root", "body"))):
                own = tuple(c.as_py() for c in own)
                if own != key:
                    if tile:
                        yield links(tile)
                    key, tile = own, []
                tile.append((side.as_py(), node.as_py(), root.as_py(), body.as_py()))
        if tile:
            yield links(tile)

    return tiled


def links_apart(opened: DataFrame, texts: DataFrame, weights: str) -> DataFrame:
    """Links between texts of one bucket (`pivot`, `node`, `root`) that are in different classes.

    Of two classes, one is not the bucket's largest; so the texts outside that one are compared with all.
    """
    sizes = (
        opened.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("pivot").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"))
        .select(
            "pivot", F.col("top.root").alias("largest"),
            F.ceil(F.col("all") / TILE).alias("n"), F.ceil((F.col("all") - F.col("top.n")) / TILE).alias("m"),
        )
    )
    cut = opened.join(stage(sizes), "pivot")

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def place(n):
        return F.pmod(F.xxhash64("node"), n)

    sides = cut.select("pivot", every("m").alias("i"), place("n").alias("j"), F.lit(False).alias("open"), "node", "root").unionByName(
        cut.where("root <> largest").select("pivot", place("m").alias("i"), every("n").alias("j"), F.lit(True).alias("open"), "node", "root")
    )
    tile = ["pivot", "i", "j"]
    ordered = sides.join(texts, "node").repartition(*tile).sortWithinPartitions(*tile)
    return ordered.mapInArrow(_tile_links(weights), "pivot binary, node binary")


def _with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def linked(buckets: DataFrame, texts: DataFrame, weights: str = "one") -> DataFrame:
    """`node` and `root` of all nodes with a link, of candidates: staged pairs of a bucket's earliest text (`pivot`) with
    each other one (`node`).  Buckets with one earliest text count as one."""
    links = stage(links_with_earliest(buckets, texts, weights), small_batches=True)
    roots = components(links)
    rooted = _with_roots(buckets, roots)
    split = rooted.groupBy("pivot").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("pivot")
    opened = stage(rooted.join(stage(split), "pivot").select("pivot", "node", "root"))
    more = stage(links_apart(opened, texts, weights))
    return components(roots.select(F.col("root").alias("pivot"), "node").unionByName(more))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: str = "one", copies: bool = False) -> DataFrame:
    """`doc_id` and `class_id`, the smallest id of the row's class, of each row.

    With `copies` also `copy`, the `copy_key` of the row's words, and `root`, which tells classes with one smallest id apart.
    """
    texts = keyed_texts(docs, key, text)
    signed = stage(texts.mapInArrow(_signed(weights), "doc long, copy binary, bands array<long>"), small_batches=True)
    nodes = signed.where(F.col("copy").isNotNull()).groupBy("copy").agg(F.min("doc").alias("doc"), F.min_by("bands", "doc").alias("bands"))
    nodes = stage(nodes.select(F.col("copy").alias("node"), "doc", "bands"))

    keyed = nodes.select(F.explode("bands").alias("bucket"), "node", F.col("doc").alias("place"))
    ends = keyed.groupBy("bucket").agg(F.min(F.struct("place", "node")).alias("low"), F.max(F.struct("place", "node")).alias("high"))
    earliest = stage(ends.where("low <> high").select("bucket", F.col("low.node").alias("pivot")))
    buckets = stage(keyed.join(earliest, "bucket").where("node <> pivot").select("pivot", "node").distinct())
    both = buckets.select("node").unionByName(buckets.select(F.col("pivot").alias("node"))).distinct()
    candidates = stage(both.join(nodes.select("node", "doc"), "node"))
    # Rows with one id and other words, or the same row again, must not stand for the node once more.
    # What is held of a partition is 24 bytes a candidate; sorting instead would sort all texts.
    found = texts.join(candidates.hint("shuffle_hash"), "doc").mapInArrow(_own_texts, "doc long, node binary, body binary")
    bodies = stage(found.groupBy("node").agg(F.any_value("body").alias("body")), small_batches=True)
    roots = linked(buckets, bodies, weights)

    named = _with_roots(nodes.select("node", "doc"), roots)
    classes = named.groupBy("root").agg(F.min("doc").alias("class"))
    of_node = stage(named.join(classes, "root").select(F.col("node").alias("copy"), "class", "root"))
    return signed.select("doc", "copy").join(of_node, "copy", "left").select(
        id_back("doc").alias("doc_id"), id_back(F.coalesce("class", "doc")).alias("class_id"), *(["copy", "root"] if copies else [])
    )
