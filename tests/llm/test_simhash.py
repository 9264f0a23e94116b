"""Fingerprints and components against plain Python, groups that are split, hubs."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sediment.llm import components, simhash
from sediment.staging import stage

from llm import plain


def fingerprint(text):
    w = (text or "").translate(plain.LOWER).encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)] * bool(w)
    counts = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in counts.items() if 2 * n > len(grams))


def joined(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def close(prints, distance=3):
    return [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= distance]


def test_components_of_texts(spark):
    rows = plain.collection(long_words=30_000)
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 100_000)
    rows += [(900, long + " end", None, None, None), (901, "ab", "", "", 0), (902, "AB", "", "", 0), (903, "a b", "", "", 0), (904, "A\x0bB", "", "", 0)]
    found = simhash.near_components(plain.frame(spark, rows)).collect()
    assert len(found) == len(rows)
    prints = {t: fingerprint(t) for t in {r[1] for r in rows}}
    root = joined(set(prints.values()), close(set(prints.values())))
    least = {}
    for i, t, *_ in rows:
        least[root[prints[t]]] = min(least.get(root[prints[t]], 2**63), plain.ident(i))
    expected = sorted((plain.ident(r[0]), f"{prints[r[1]]:016x}", least[root[prints[r[1]]]]) for r in rows)
    assert sorted((plain.ident(r["doc_id"]), r["fingerprint"], plain.ident(r["component_id"])) for r in found) == expected
    assert sum(r[0] != r[2] for r in expected) >= 8


def test_pieces_of_a_long_text(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice(["One", "two", "Three", "x" * 40]) + r.choice(["", "\t", "\n "]) for _ in range(r.randint(0, 60))) for _ in range(30)]
    monkeypatch.setattr(simhash, "PIECE", 17)
    for t in texts:
        assert simhash.fingerprint(t.encode()) % 2**64 == fingerprint(t)


def test_half_of_the_shingles_is_not_over_half():
    pairs = [f"{a} {b} {c} {d}" for a, b, c, d in combinations("abcdefg", 4)]
    for t in pairs:  # two shingles: a bit that one of them has is 0
        a, b = (xxhash.xxh64_intdigest(g.encode(), 42) for g in (t[:5], t[2:]))
        assert simhash.fingerprint(t.encode()) % 2**64 == a & b


def test_every_close_pair_meets():
    r = random.Random(1)
    masks = simhash.choices(list(range(64)), simhash.BLOCKS, simhash.DISTANCE)
    assert len(masks) == 20 and all(30 <= m.bit_count() <= 34 for m in masks)
    for mask in masks:
        free = [b for b in range(64) if not mask >> b & 1]
        assert all((mask | m).bit_count() >= 64 - 13 for m in simhash.choices(free, simhash.FINER, 3))
    for _ in range(500):
        x = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not x & m for m in masks)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("held", [4096, 40, 1])
def test_large_groups(spark, held):
    """Thousands of fingerprints with most bits in common: whole groups and split ones give the same components."""
    r = random.Random(2)
    bases, prints = [r.getrandbits(64) for _ in range(3)], set()
    while len(prints) < 1500:
        x = r.choice(bases)
        for b in r.sample(range(48, 64) if r.random() < 0.7 else range(64), r.randint(1, 9)):
            x ^= 1 << b
        prints.add(x)
    given = stage(spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(3))
    links = stage(simhash.links_within(given, held=held))
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    mine = {p: roots.get(signed(p), signed(p)) for p in prints}
    plainly = joined(prints, close(prints))
    assert len(set(mine.values())) == len(set(plainly.values()))
    assert len(set(zip(mine.values(), plainly.values()))) == len(set(mine.values()))


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW", 50)
    r = random.Random(4)
    links = [(0, i) for i in range(1, 2000)] + [(5000 + i, 1999) for i in range(2000)] + [(i, i + 1) for i in range(9000, 9050)]
    links += [(r.randrange(10_000, 10_400), r.randrange(10_000, 10_400)) for _ in range(300)]
    found = components.components(spark.createDataFrame(links, "pivot long, node long").repartition(7)).collect()
    expected = joined({x for link in links for x in link}, links)
    assert {r["node"]: r["root"] for r in found} == {k: v for k, v in expected.items() if k != v}


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_components(none).collect() == []
    assert np.array_equal(simhash.forest(np.zeros(0, np.uint64), 3), [])
    assert [tuple(r) for r in simhash.near_components(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, "0" * 16, None)]
