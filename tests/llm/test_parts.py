"""Parts of the operators on their own."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers

from sediment.llm import licenses, near, packing, postings, windows
from sediment.llm.arrays import Words, column_bytes, pack, unpack
from llm import plain

import pyarrow as pa

TOKENS = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_hold_every_piece_once(histogram):
    found = packing.patterns(histogram, 64)
    counted = {}
    for pattern, n in found:
        assert n > 0 and sum(length * times for length, times in pattern) <= 64
        for length, times in pattern:
            counted[length] = counted.get(length, 0) + n * times
    assert counted == histogram


def test_patterns_of_many_pieces_are_few_steps():
    found = packing.patterns({1: 10**12, 5: 10**9, 4096: 3, 2049: 10**10}, 4096)
    assert len(found) < 50
    tokens = 10**12 + 5 * 10**9 + 3 * 4096 + 2049 * 10**10
    assert tokens / (4096 * sum(n for _, n in found)) <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé日 \t\n\x0b\x1c ́'sl!1<|endoftext|>.,#-"), max_size=40), max_size=5))
def test_ids_of_runs_are_ids_of_the_texts(texts):
    tokens = TOKENS
    ids, at = tokens.ids(*column_bytes(pa.array([t.encode() for t in texts], pa.binary())))
    expected = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == expected


@given(st.lists(st.binary(max_size=30), max_size=8))
def test_words_are_those_of_split(texts):
    words = Words(*column_bytes(pa.array(texts, pa.binary())))
    for i, t in enumerate(texts):
        a, b = words.offsets[i : i + 2]
        assert [words.body[x:y].tobytes() for x, y in zip(words.starts[a:b], words.ends[a:b])] == t.split()


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**16 - 1)), max_size=20))
def test_packed_columns_come_back(rows):
    kinds = [np.uint64, np.int64, np.uint16]
    columns = [np.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [np.zeros(0, k) for k in kinds]
    cut = len(rows) // 2
    back = unpack([pack(*(c[:cut] for c in columns)), pack(*(c[cut:] for c in columns))], kinds)
    assert all((a == b).all() for a, b in zip(back, columns))


@given(st.binary(min_size=0, max_size=400), st.integers(5, 40))
def test_stretches_hold_each_window_once(text, window):
    shape = windows.Shape(window, 4, words=False, inside_documents=True)
    units = windows.byte_units(np.frombuffer(text, np.uint8))
    _, start, n, _, _ = windows.stretches(units, np.array([0, len(text)]), shape)
    held = np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)]) if len(start) else np.zeros(0)
    assert held.tolist() == list(range(max(0, len(text) - window + 1)))


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=30))
def test_every_anchor_with_several_kinds_hands_on_two(places):
    """Few values of the kept bits, so that anchors of several buckets agree in them."""
    shape = windows.Shape(20, 8, words=False, inside_documents=True)
    value = [v + 10 * a + 100 * b for b, a, v in places]  # equal stretches have equal anchors
    columns = [[b for b, _, _ in places], [a for _, a, _ in places], value, range(len(places)), [0] * len(places), [1] * len(places)]
    kinds, handed = {}, {}
    for (b, a, _), v in zip(places, value):
        kinds.setdefault((b, a), set()).add(v)
    for rows in windows._stretches_handed_on([[np.array(c, np.int64) for c in columns]], shape):
        for r in rows.to_pylist() if rows is not None else ():
            if r["kind"] == windows.ENTRY:
                for a, v in zip(*(c.tolist() for c in unpack([r["data"]], windows.ENTRY_TYPES)[:2])):
                    handed.setdefault((r["key"], a), []).append(v)
    assert {k: len(v) for k, v in handed.items()} == {k: min(2, len(v)) for k, v in kinds.items()}


def test_registers_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(5)
    every = np.unique(rng.integers(0, 2**63, 110).astype(np.uint64))
    weight = rng.integers(1, 9, len(every))
    sides = [(every[a:b], weight[a:b]) for a, b in ((0, 85), (25, 110))]
    exact = near.similarity(*sides)
    assert exact == pytest.approx(plain.probability_jaccard(*(plain.Counter(dict(zip(v.tolist(), w.tolist()))) for v, w in sides)))
    n = 6000
    signed = [near.signatures(np.zeros(len(v), int), v, w, 1, n)[0] for v, w in sides]
    assert abs((signed[0] == signed[1]).mean() - exact) < 4 * (exact * (1 - exact) / n) ** 0.5


@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=9), st.integers(1, 8))
def test_common_weights(sets, first):
    weight = np.random.default_rng(4).integers(1, 500, 41)
    texts = [(np.array(sorted(s), np.uint64), weight[sorted(s)]) for s in sets]
    first = min(first, len(sets) - 1)
    expected = [[sum(weight[e] for e in a & b) for b in sets[first:]] for a in sets[:first]]
    assert near.common_weight(texts[:first], texts[first:]).tolist() == expected


def classes_of(spark, texts):
    """The roots of texts that are all in one bucket, and by comparing all with all."""
    rows = [(j.to_bytes(2), t.encode()) for j, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node binary, body binary")
    pairs = spark.createDataFrame([(rows[0][0], n) for n, _ in rows[1:]], "pivot binary, node binary")
    found = {int.from_bytes(r["node"]): int.from_bytes(r["root"]) for r in near.linked(pairs, nodes).collect()}
    expected = plain.near_classes([(j, t) for j, t in enumerate(texts)])
    return {j: found.get(j, j) for j in range(len(texts))}, expected


def test_a_chain_whose_first_text_is_alone(spark):
    """None is like the first, all are linked with a neighbour."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"z{i}" for i in range(400))] + [" ".join([f"v{k}" for k in range(20 * j)] + base[20 * j :]) for j in range(9)]
    found, expected = classes_of(spark, texts)
    assert found == expected and set(found.values()) == {0, 1}


def test_copies_of_copies_in_one_bucket(spark):
    """Texts with more and more words changed, and copies of these with one more change each."""
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(130)]
    texts = [base]
    for j in range(70):
        text = list(r.choice(texts[:1] * 3 + texts))
        for _ in range(r.choice([1, 1, 2, 4])):
            text[r.randrange(len(text))] = f"x{r.random()}"
        texts.append(text)
    found, expected = classes_of(spark, [" ".join(t) for t in texts])
    assert found == expected and 3 < len(set(found.values())) < 70


def test_proximity(spark):
    texts = [(1, "alpha x beta y gamma"), (2, "alpha x x x x x x beta gamma"), (3, "gamma beta alpha"), (4, "alpha beta"), (5, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(9, "Alpha beta gamma")], "item_id long, text string")
    index, phrases = postings.build_index(docs), postings.phrases_of(items, 10)
    near_ones = lambda slop: sorted(r["doc"] for r in postings.search(index, phrases, 10, slop=slop).collect())
    assert near_ones(0) == [3] and near_ones(2) == [1, 3] and near_ones(6) == [1, 2, 3]
    assert postings.search(index, phrases, 10).collect() == []


def scanned(text, templates=licenses.TEMPLATES):
    return licenses.Templates(templates).scan(*column_bytes(pa.array([text.encode()], pa.binary())))[0]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_the_best_of_variants_is_the_text_itself(name):
    found = scanned(f"{'word ' * 77}{licenses.TEMPLATES[name]} and more")
    assert found[name] == (1.0, True) and [k for k, (_, best) in found.items() if best] == [name]


def test_a_preamble_is_no_license():
    found = scanned(licenses.TEMPLATES["MIT-preamble"] + " by paying for it every month, " + "with other terms " * 30)
    assert set(found) == {"MIT-preamble"}


def test_variants_in_two_places_are_both_found():
    found = scanned(licenses.TEMPLATES["BSD-2-Clause"] + " word" * 3000 + " " + licenses.TEMPLATES["BSD-3-Clause"])
    assert {k for k, (_, best) in found.items() if best} == {"BSD-2-Clause", "BSD-3-Clause"}


@pytest.mark.parametrize("before", range(0, 400, 23))
def test_a_template_of_repeated_shingles_fits_into_a_window(before):
    text = " ".join(f"a{i}" for i in range(60)) + " go on and" * 60 + " " + " ".join(f"b{i}" for i in range(60))
    assert scanned("x " * before + text + " y" * 300, {"long": text}) == {"long": (1.0, True)}


def test_a_batch_gives_its_memory_back_before_the_next(monkeypatch):
    import weakref

    from sediment.llm import arrays

    given, freed = [], []
    monkeypatch.setattr(arrays, "give_back", lambda: freed.append(given[-1]() is None))

    def batches():
        for n in (1, 40, 3):
            batch = arrays.pa.RecordBatch.from_arrays([arrays.pa.array([b"x" * 100] * n, arrays.pa.binary())], names=["body"])
            given.append(weakref.ref(batch))
            yield batch
            del batch

    assert sum(len(b) for b in arrays.slices(batches(), "body", 1000)) == 44
    assert len(freed) == 3


def test_free_memory_goes_back_to_the_system():
    import re

    from sediment.llm import arrays

    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nRss:\s+(\d+)", f.read())[1])

    held = [bytes(60_000) for _ in range(2000)]
    last = bytes(60_000)  # above the others, so that they can't go by themselves
    full = resident()
    del held
    arrays.give_back()
    assert last and resident() < full - 80_000
