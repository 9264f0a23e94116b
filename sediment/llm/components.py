"""Connected components of links between nodes of any one type.

Each task first makes stars of its own links.  Then large-star and small-star steps by turns (the least neighbour
becomes the neighbour of all) until nothing changes: a number of rounds that grows as the logarithm of a component's size.

A node with very many links is a hub.  The links of all nodes add up to their number, so fewer than HUBS nodes have more
than one in HUBS of them: a list of bounded size.  With it the links of a hub are dealt to several tasks, each with its own copy of
the hub's least neighbour, and no task holds a hub.  Where there are no more than FEW links in all, no node can be one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.staging import stage

#: Hubs at most, the links that make none in any case (some MB), and the links that a task makes stars of at a time.
HUBS, FEW, HELD = 512, 100_000, 1 << 18


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars: each node with the least it is connected with here."""
    root: dict = {}
    schema = None

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars():
        ends = [(n, find(n)) for n in root]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends if e[0] != e[1]], schema.field(i).type) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
        if len(root) > HELD:
            yield stars()
    if root:
        yield stars()


def _with_least(pairs: DataFrame, count: int) -> DataFrame:
    """Pairs (u, v) with `m`, the least v of each u, for a number of links."""
    if count <= FEW:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")
    most = max(FEW, count // HUBS)
    ends = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    # The condition on m keeps both uses of `ends` alike, so that Spark makes it once.
    hubs = ends.where((F.col("n") > most) & F.col("m").isNotNull()).select("u", F.ceil(F.col("n") / most).alias("parts"))
    dealt = pairs.join(F.broadcast(hubs), "u", "left").select(
        "u", "v", F.coalesce(F.pmod(F.xxhash64("v"), "parts"), F.lit(0)).alias("part")
    )
    copies = ends.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / most) - 1)).alias("part"))
    return dealt.join(copies, ["u", "part"]).select("u", "v", "m")


def components(links: DataFrame, left: str = "pivot", right: str = "node") -> DataFrame:
    """`node` and `root`, the least node that it is connected with, of all nodes of the links but the roots themselves."""
    kind = links.schema[left].dataType.simpleString()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())

    stars = f"u {kind}, v {kind}"
    edges = stage(links.select(F.col(left).alias("u"), F.col(right).alias("v")).mapInArrow(_stars, stars).distinct())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _with_least(both, 2 * before[0]).where("v > u")
        large = near.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        smaller = _with_least(large, 2 * before[0])
        small = smaller.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.distinct())
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
