"""Collocations against plain Python, and that shards, pieces and a crowded filter lose no phrase."""

import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sediment.llm import phrases

from llm import plain


def plainly(rows, support, longest=4, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(plain.LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            total["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(plain.grams(w, k))
    out = []
    for lang, c in counts.items():
        good = {p: a for p, a in c.items() if a >= support}
        scored = []
        for p, a in good.items():
            if len(p) == 1:
                continue
            longer = max((b for q, b in good.items() if len(q) > len(p) and p in plain.grams(q, len(p))), default=0)
            if 100 * longer >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def found(spark, rows, **how):
    result = phrases.collocations(plain.frame(spark, rows), **how).drop("cut")
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in result.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    common = ["New York City", "in the end", "the end of", "naïve Été", "a a a a"]
    out = plain.collection(long_words=3000)
    for i in range(60):
        words = [r.choice(common) if r.random() < 0.4 else r.choice("a the end of new city x' (y)".split()) for _ in range(40)]
        out.append((1000 + i, "".join(w + r.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b"]) for w in words), r.choice(["en", "fr", None]), None, 0))
    return out


@pytest.mark.parametrize("support, shards", [(30, 8), (7, 3), (2, 1), (12, 40)])
def test_phrases(spark, rows, support, shards):
    expected = plainly(rows, support)
    assert len(expected) > 10
    assert found(spark, rows, support=support, shards=shards) == expected


def test_first_of_many(spark, rows):
    expected = plainly(rows, 3, top=4)
    assert {r[1] for r in expected} == {1, 2, 3, 4}
    assert found(spark, rows, support=3, top=4) == expected


def test_a_crowded_filter_lets_more_through(spark, rows, monkeypatch):
    """In a filter in which all places are set every phrase is counted, and none is lost."""
    full = phrases._filter

    def crowded(blocks, support, buckets):
        value = full(blocks, support, buckets)
        return blocks.sparkSession.sparkContext.broadcast(np.full_like(value.value, 255))

    monkeypatch.setattr(phrases, "_filter", crowded)
    assert found(spark, rows, support=9) == plainly(rows, 9)


@pytest.mark.parametrize("buckets", [1, 8, 128])
def test_entries_of_blocks_are_small_and_whole(buckets):
    """What is shuffled is at most five bytes an entry, and every bucket gets the entries of its hashes back."""
    r = np.random.default_rng(3)
    hashes = [np.sort(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (20_000, 1, 30_000, 15_000)]
    groups = np.repeat([5, 0, 70_000, 2], [len(h) for h in hashes])
    hashes, n = np.concatenate(hashes), r.choice([1, 1, 1, 70_000], len(groups), p=[0.5, 0.3, 0.19, 0.01])
    rows = phrases._blocks(groups, hashes, n, buckets).to_pylist()
    assert sum(len(pa.Codec("lz4").compress(row["data"])) for row in rows) < 5 * len(groups)
    expected = sorted(zip((hashes >> np.uint64(64 - phrases.KEY)).tolist(), groups.tolist(), n.tolist()))
    found = []
    for row in rows:
        own_groups, firsts, own_n = phrases._entries(row["data"])
        assert (firsts * np.uint64(buckets) >> np.uint64(phrases.KEY) == row["bucket"]).all()
        found += zip(firsts.tolist(), own_groups.tolist(), own_n.tolist())
    assert sorted(found) == expected


def test_pieces_share_words(monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice(["ab", "c", "x" * 30]) + r.choice([" ", ". ", "\t ", ",,"]) for _ in range(r.randint(0, 50))).encode() for _ in range(40)]
    whole = [plain.grams(re.findall(rb"[^ \t.,]+", t), 1) for t in texts]
    monkeypatch.setattr(phrases, "HELD", 13)
    for text, expected in zip(texts, whole):
        parts = list(phrases.pieces(text))
        assert b"".join(p[:own] for p, own in parts) == text
        for k in (1, 2, 3, 4):
            counted = Counter()
            for p in parts:
                piece = phrases.Piece([(0, *p)])
                counted.update(tuple(piece.words[c] for c in piece.codes[i : i + k]) for i in piece.starts(k))
            words = [re.findall(rb"[^ \t]+", x) for x in re.split(rb"[.,]", text)]
            assert counted == Counter(g for w in words for g in plain.grams(w, k))
        assert sum(map(len, expected)) == sum(len(phrases.Piece([(0, *p)]).starts(1)) for p in parts)


def test_phrases_are_joined_without_a_call_for_each():
    """Python is called for the different words of a piece, not for its phrases, and texts come out as they are."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(199)] + ["é’x"]
    text = "  ".join(r.choice(words) for _ in range(20_000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "body": [text.encode()]})

    class Full:
        value = np.full((1 << phrases.FILTER) // 8, 255, np.uint8)

    calls = [0]

    def called(frame, event, argument):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(called)
    try:
        out = list(phrases._exact([Full, Full, Full])(iter([batch])))
    finally:
        sys.setprofile(None)
    expected = Counter(" ".join(g) for k in (2, 3, 4) for g in plain.grams(text.split(), k))
    assert {p: a for b in out for p, a in zip(b.column("phrase").to_pylist(), b.column("a").to_pylist())} == expected
    assert calls[0] < len(expected) // 10


def test_distinct_phrases_of_many_words():
    """Four words of 70,000 and a group do not fit 63 bits at once."""
    r = random.Random(9)
    texts = [[str(i) for i in range(70_000)], [str(r.randint(0, 70_000)) for _ in range(500)] * 3, ["1", "2", "3", "4", "5"] * 2]
    piece = phrases.Piece([(g, " ".join(w).encode(), 1 << 30) for g, w in zip((0, 7, 3), texts)])
    for k in (1, 2, 4):
        at, n = phrases._distinct(piece, piece.starts(k), k)
        found = {(int(piece.group[p]), *(piece.words[c] for c in piece.codes[p : p + k])): a for p, a in zip(at.tolist(), n.tolist())}
        expected = Counter((g, *x) for g, w in zip((0, 7, 3), texts) for x in plain.grams([y.encode() for y in w], k))
        assert len(at) == len(found) and found == expected


def test_no_phrase(spark):
    schema = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (None, "", "en"), (2, " .,\n", "en")], schema)).collect() == []
    with pytest.raises(ValueError):
        phrases.collocations(spark.createDataFrame([], schema), longest=5)
