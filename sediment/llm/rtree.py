"""Hard-negative mining: for an anchor and each of its positives, the rows of other labels that score in a window below.

A score is the integer inner product of two vectors whose components x were made floor(SCALE * x).  An anchor's positives are its
first rows of the same label; a negative scores from LOW to HIGH percent of a positive.  Higher scores come first, ties by smaller id.

Index: R-trees packed by Sort-Tile-Recursive.  All rows are dealt by ranges of (label, first component, id) to parts of about TREE rows; in
each part rows are sorted and cut into slabs by label, slabs by the first component, and so on, until LEAF rows are left.  A node has the least and the greatest
value of each component, label and id below it.  For an anchor a box gives an interval of inner products, from the lesser and the greater product in each
component.  A queue takes the box with the highest possible score first; boxes outside all windows, of no fitting label, or strictly
below the k-th result found are pruned, as are boxes that can only tie with it and have larger ids.

Anchors are searched against all trees, in blocks of BLOCK: the blocks go to LANES of trees, and a block keeps its best results through all trees of a lane.
Every row is indexed and results are exact.

* A row with a null id, label or vector, or a null or non-finite component, takes no part.  Missing components of a shorter vector are 0.
* Rows with one id are a row each, but no row is another's positive or negative if they share an id.  Anchors that are equal in all are one.
* Sums that pass 53 bits are made with whole numbers of any size; a score that passes 64 bits is an error.
* No anchor, no positive or nothing in its window: no row.  Other columns are not looked at.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.staging import stage
from sediment.types import col

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
TREE, LEAF, FANOUT = 4096, 128, 8
#: Anchors of a block, and trees of a lane at most.
BLOCK, LANE = 512, 16

_TREE = "tree int, ids binary, labels binary, vectors binary, dim int"
_BLOCK = "block long, ids binary, labels binary, vectors binary, dim int"


def vectors_of(table: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """`id`, `label` and `vector` of the rows that take part."""
    rows = table.select(col(key).cast("long").alias("id"), label.cast("long").alias("label"), col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(~odd)


def _matrix(column: pa.ListArray, scale: int) -> np.ndarray:
    """Vectors as rows of whole numbers, the shorter ones filled up with 0."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), max(n, default=0)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = np.floor(scale * flat)
    return out


def tiled(keys: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The order of Sort-Tile-Recursive: `leaf` neighbours are a page, cut by one column of the keys after the other."""
    def tile(rows: np.ndarray, dim: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1 or dim == keys.shape[1]:
            return [rows]
        slabs = int(np.ceil(pages ** (1 / (keys.shape[1] - dim))))
        size = leaf * -(-pages // slabs)
        rows = rows[np.argsort(keys[rows, dim], kind="stable")]
        return [part for at in range(0, len(rows), size) for part in tile(rows[at : at + size], dim + 1)]

    return np.concatenate(tile(np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)


class Tree:
    """The levels of boxes over rows in tiled order: level 0 has the leaves, the last level one root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.ids, self.labels, self.vectors, self.leaf, self.fanout = ids, labels, vectors, leaf, fanout
        self.levels, self.spans, self.firsts = [], [], []
        low, high, least, most, first, step = vectors, vectors, labels, labels, ids, leaf
        while not self.levels or len(low) > 1:
            at = np.arange(0, len(low), step)
            low, least, first = (np.minimum.reduceat(x, at) for x in (low, least, first))
            high, most = (np.maximum.reduceat(x, at) for x in (high, most))
            self.levels.append((low, high))
            self.spans.append(list(zip(least.tolist(), most.tolist())))
            self.firsts.append(first.tolist())
            step = fanout


def fits_floats(some: np.ndarray, others: np.ndarray) -> bool:
    """Whether all inner products and their parts are whole numbers below 2^53."""
    return np.abs(some).max(initial=0) * np.abs(others).max(initial=0) * max(1, some.shape[1]) < 2**53


def _any_size(numbers: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(numbers).astype(object)


class Best:
    """The first k rows of a window of scores, ties by smaller id, as (-score, id)."""

    def __init__(self, k: int, low: float = float("-inf"), high: float = float("inf")):
        self.k, self.low, self.high, self.rows = k, low, high, []

    def end(self) -> tuple:
        """What a further row has to come before: the least score, and the id that settles a tie."""
        return (-self.rows[-1][0], self.rows[-1][1]) if len(self.rows) == self.k else (self.low, float("inf"))

    def add(self, score, id_: int) -> None:
        if self.low <= score <= self.high:
            if len(self.rows) < self.k or (-score, id_) < self.rows[-1]:
                insort(self.rows, (-score, id_))
                del self.rows[self.k :]


class Asked:
    """All windows of one anchor."""

    def __init__(self, windows: list[Best]):
        self.windows, self.most = windows, max(w.high for w in windows)
        self._narrow()

    def _narrow(self) -> None:
        ends = [w.end() for w in self.windows]
        self.least = min(e[0] for e in ends)
        self.last = max(e[1] for e in ends if e[0] == self.least)

    def may_hold(self, low, high, first: int) -> bool:
        """Whether rows with scores from low to high and ids from first on can be among the results."""
        return low <= self.most and (high > self.least or (high == self.least and first < self.last))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero((scores >= self.least) & (scores <= self.most))
        if len(near):
            for score, id_ in zip(scores[near].tolist(), ids[near].tolist()):
                for window in self.windows:
                    window.add(score, id_)
            self._narrow()


def search(tree: Tree, lows: list[list], highs: list[list], anchor: np.ndarray, id_: int, label: int, same: bool, asked: Asked) -> None:
    """Add a tree's rows of the anchor's label, or those of other labels; `lows` and `highs` have the interval of each level's boxes."""
    top = len(tree.levels) - 1
    queue = [(-highs[top][0], top, 0)]
    while queue:
        high, level, i = heappop(queue)
        if not asked.may_hold(lows[level][i], -high, tree.firsts[level][i]):
            continue
        if not level:
            rows = slice(i * tree.leaf, (i + 1) * tree.leaf)
            fits = ((tree.labels[rows] == label) == same) & (tree.ids[rows] != id_)
            asked.add((tree.vectors[rows] @ anchor)[fits], tree.ids[rows][fits])
            continue
        level -= 1
        for j in range(i * tree.fanout, min((i + 1) * tree.fanout, len(highs[level]))):
            least, most = tree.spans[level][j]
            fits = least <= label <= most if same else not least == label == most
            if fits and asked.may_hold(lows[level][j], highs[level][j], tree.firsts[level][j]):
                heappush(queue, (-highs[level][j], level, j))


def _wide(vectors: np.ndarray, dim: int) -> np.ndarray:
    return vectors if vectors.shape[1] == dim else np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), row["dim"])


def _packed(number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, name: str, kind: pa.DataType) -> pa.RecordBatch:
    binary = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (ids, labels, vectors)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], kind), *binary, pa.array([vectors.shape[1]], pa.int32())], names=[name, "ids", "labels", "vectors", "dim"]
    )


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task, so many at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + len(batch) >= size:
            held.append(batch.slice(0, size - n))
            yield pa.Table.from_batches(held)
            batch, held, n = batch.slice(size - n), [], 0
        if len(batch):
            held.append(batch)
            n += len(batch)
    if held:
        yield pa.Table.from_batches(held)


def _arrays(table: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = _matrix(table.column("vector").combine_chunks(), scale)
    return table.column("id").to_numpy(), table.column("label").to_numpy(), vectors


def _trees(scale: int, size: int):
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, table in enumerate(_portions(batches, size)):
            ids, labels, vectors = _arrays(table, scale)
            order = tiled(np.column_stack([labels, vectors]))
            yield _packed(TaskContext.get().partitionId() + 100_003 * i, ids[order], labels[order], vectors[order], "tree", pa.int32())

    return trees


def _blocks(scale: int, size: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, table in enumerate(_portions(batches, size)):
            yield _packed((TaskContext.get().partitionId() << 32) + i, *_arrays(table, scale), "block", pa.int64())

    return blocks


def _searched(same: bool, k: int, low: int, high: int):
    """For each block and lane: the best rows of each anchor, or of each anchor and positive."""
    def opened(row: dict, anchors: int) -> list[list[tuple]]:
        """For each anchor: the positives, their scores, and the best rows found for them."""
        if same:
            return [[(None, None, None, Best(k))] for _ in range(anchors)]
        out: list[list[tuple]] = [[] for _ in range(anchors)]
        for p in row["positives"]:
            s = p["score"]
            out[p["slot"]].append((p["place"], p["id"], s, Best(k, -(-low * s // 100), high * s // 100)))
        return out

    def added(tree: dict, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, best: list[list[tuple]]) -> None:
        tree_ids, tree_labels, tree_vectors = _unpacked(tree)
        dim = max(vectors.shape[1], tree_vectors.shape[1])
        tree_vectors, anchors = _wide(tree_vectors, dim), _wide(vectors, dim)
        if not fits_floats(anchors, tree_vectors):
            tree_vectors, anchors = _any_size(tree_vectors), _any_size(anchors)
        packed = Tree(tree_ids, tree_labels, tree_vectors)
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        lows = [up @ a.T + down @ b.T for a, b in packed.levels]
        highs = [up @ b.T + down @ a.T for a, b in packed.levels]
        for slot, own in enumerate(best):
            if own:
                asked = Asked([best for *_, best in own])
                search(packed, [x[slot].tolist() for x in lows], [x[slot].tolist() for x in highs], anchors[slot], ids[slot], labels[slot], same, asked)

    def found(block: int, ids: np.ndarray, best: list[list[tuple]]) -> pa.RecordBatch:
        rows = [
            (block, slot, place, int(ids[slot]), positive, score, i, -int(s))
            for slot, own in enumerate(best) for place, positive, score, b in own for s, i in b.rows
        ]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        names = ["block", "slot", "place", "anchor", "positive", "positive_score", "id", "score"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, best = None, (), []
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                if (row["block"], row["lane"]) != key:
                    if best:
                        yield found(key[0], own[0], best)
                    key, own = (row["block"], row["lane"]), _unpacked(row)
                    best = opened(row, len(own[0]))
                added(row["tree"], *own, best)
        if best:
            yield found(key[0], own[0], best)

    return searched


_FOUND = "block long, slot int, place int, anchor long, positive long, positive_score long, id long, score long"


def _against_all(blocks: DataFrame, trees: DataFrame, lanes: int, searched) -> DataFrame:
    every = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    dealt = trees.select(F.pmod("tree", F.lit(lanes)).alias("lane"), F.struct("ids", "labels", "vectors", "dim").alias("tree"))
    # Blocks stream past the trees of their lane.
    return every.join(dealt.hint("merge"), "lane").mapInArrow(searched, _FOUND)


def hard_negatives(
    table: DataFrame, anchors: Column, label: Column, key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, tree: int = TREE,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score` and `negative_score`.

    `label` is a row's label; `anchors`, on `id` and `label`, tells which rows are anchors.
    """
    rows = vectors_of(table, key, vector, label)
    count = rows.count()
    parts = max(1, -(-count // tree))
    ranged = rows.repartitionByRange(parts, "label", F.get("vector", F.lit(0)), "id").sortWithinPartitions("label", F.get("vector", F.lit(0)), "id")
    trees = stage(ranged.mapInArrow(_trees(scale, tree), _TREE))

    asked = rows.where(anchors).dropDuplicates(["id", "label", "vector"])
    blocks = stage(asked.repartition(max(1, -(-count // (100 * BLOCK)))).mapInArrow(_blocks(scale, BLOCK), _BLOCK))
    lanes = max(-(-parts // LANE), min(parts, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    order = [F.desc("score"), "id"]
    found = _against_all(blocks, trees, lanes, _searched(True, positives, low, high))
    place = F.row_number().over(Window.partitionBy("block", "slot").orderBy(*order))
    first = stage(found.withColumn("place", place).where(F.col("place") <= positives).select("block", "slot", "place", "id", "score"))
    windows = first.groupBy("block").agg(F.collect_list(F.struct("slot", "place", "id", "score")).alias("positives"))

    found = _against_all(stage(blocks.join(windows, "block")), trees, lanes, _searched(False, negatives, low, high))
    place = F.row_number().over(Window.partitionBy("block", "slot", "place").orderBy(*order))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= negatives)
    return ranked.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
