"""Every operator over the collection with odd cases, over an empty table, and its rows against the plain version."""

import pytest

from sediment.llm import langid, licenses, lines, near, packing, postings, quality, substrings, suffixes

import public_tokenizers
from pyspark.sql.functions import lit as plain_lit

from llm import plain

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return plain.collection()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return plain.frame(spark, rows).cache()


def by_id(found, *columns):
    out = {}
    for r in found.collect():
        value = tuple(r[c] for c in columns)
        assert out.setdefault(r["doc_id"], value) == value, "rows with one id and text have one result"
    return out


def test_substrings(docs, rows):
    found = substrings.remove_repeats(docs)
    assert found.count() == len(rows)
    assert by_id(found, "n_words", "n_removed", "kept") == plain.word_repeats(rows)


def test_spans_are_what_is_removed(docs):
    for r in substrings.remove_repeats(docs, window=8).collect():
        assert sum(s["length"] for s in r["spans"]) == r["n_removed"]
        assert all(s["length"] >= 8 for s in r["spans"])


@pytest.mark.parametrize("seed", range(4))
def test_texts_of_few_words(spark, seed):
    """Very many windows have one anchor, inside one document and in several."""
    import random

    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("ab" if r.random() < 0.7 else "abc") for _ in range(r.randint(0, 60)))) for i in range(25)]
    rows += [(i + 100, r.choice(rows)[1][r.randrange(9):] + " a b " + r.choice(rows)[1]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + seed)
    found = by_id(substrings.remove_repeats(docs, window=6 + seed), "n_words", "n_removed", "kept")
    assert found == plain.word_repeats(rows, 6 + seed)
    found = by_id(suffixes.remove_earlier(docs, window=16 + seed, batches=1 + seed), "n_bytes", "n_removed", "n_spans", "kept")
    assert {k: (*v[:3], bytes(v[3])) for k, v in found.items()} == plain.byte_repeats(rows, 16 + seed)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_suffixes(docs, rows, batches):
    found = suffixes.remove_earlier(docs, batches=batches)
    assert found.count() == len(rows)
    assert {k: (*v[:3], bytes(v[3])) for k, v in by_id(found, "n_bytes", "n_removed", "n_spans", "kept").items()} == plain.byte_repeats(rows)


def test_levels_merge_geometrically(spark, docs):
    index = suffixes.SuffixLevels(spark, 100)
    for k in range(6):
        index.add(suffixes.keyed_texts(docs.where(f"pmod(doc_id, 6) = {k}"), "doc_id", "text"))
    assert [n for n, _ in index.levels] == [4, 1, 1]
    index._merge_equal()
    assert [n for n, _ in index.levels] == [4, 2]


def test_lines(docs, rows):
    found = lines.dedup_lines(docs)
    assert found.count() == len(rows)
    assert found.select("row.*").columns == [c for c in docs.columns if c != "text"] + ["_"]
    assert by_id(found.select("row.doc_id", "n_lines", "n_dropped", "text"), "n_lines", "n_dropped", "text") == plain.line_dedup(rows)


def test_quality(docs, rows):
    found = quality.judge(docs, carry=True)
    expected = sorted(plain.quality(rows, quality.RATIOS, quality.TRUST), key=repr)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=repr) == expected
    assert found.select("given.*").columns == docs.columns


def test_contamination(spark, docs, rows):
    long = plain.terms(next(r[1] for r in rows if r[1] and len(r[1]) > 10_000))
    items = [(1, " ".join(long[100:130])), (20, "A, b; C"), (3, "one"), (None, " ".join(long[50:62])), (5, None), (6, " .,"), (3, "naïve ÉTÉ"), (7, " ".join(long[100:130]))]
    given = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc string")
    found = postings.contamination(docs, given)
    assert found.count() == len(rows)
    assert by_id(found, "n_words", "n_hit", "items") == plain.contamination(rows, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in found.collect())


@pytest.mark.parametrize("weights", ["one", "length"])
def test_near_classes(docs, rows, weights):
    found = near.near_classes(docs, weights=weights)
    assert found.count() == len(rows)
    assert {plain.ident(k): plain.ident(v[0]) for k, v in by_id(found, "class_id").items()} == plain.near_classes(rows, weights=weights)


def test_packing(spark, docs, rows):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    placed = packing.pack_documents(docs, TOKENIZER, size=512, with_ids=True)
    found = placed.collect()
    texts = {r[0]: r[1] for r in rows}
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items()}
    counted = {}
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert list(r["ids"]) == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + r["length"]
    copies = {k: sum(r[0] == k for r in rows) for k in texts}
    assert counted == {k: len(v) * copies[k] for k, v in ids.items()}
    at = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 512 and sorted(at) == list(range(len(at)))
    assert sum(at.values()) > 0.97 * 512 * len(at)
    for r in packing.sequences(placed, 512).collect():
        n = at[r["sequence_id"]]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 512)


def test_languages(docs, rows):
    samples = langid.sample(docs.where((langid.fold_of("doc_id") != 0) & docs.lang.isNotNull()), "doc_id", "text", "lang")
    assert set(samples) == {"en", "de"}
    fold = bytes(langid._FOLDED.tolist())
    models = {k: v.translate(fold) for k, v in samples.items()}

    def phrases(text, model):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in model:
                size += 1
            at, n = at + size, n + 1
        return n

    expected, weight = {}, {k: langid.math.log2(len(v) + 2) for k, v in models.items()}
    for i, t, *_ in rows:
        b = (t or "").encode()
        cost = {k: phrases(b.translate(fold), models[k]) * weight[k] for k in models}
        known = any(c.isalpha() for c in t or "")
        best, second = sorted(cost.values())
        expected[i] = (min(sorted(cost), key=cost.get) if known else "und", pytest.approx((second - best) / second if known else 0.0))
    found = by_id(langid.identify(docs), "lang_pred", "score")
    assert found == expected
    assert set(found) == {r[0] for r in rows}


@pytest.mark.parametrize("span", [1, 2, 7, 64, 10_000])
def test_phrases_of_whole_texts(monkeypatch, span):
    """However texts are cut into stretches, the phrases are those of one reading; also where matches are far longer than a stretch."""
    import random

    import numpy as np

    r = random.Random(span)
    samples = {"x": "".join(r.choice("ab ") for _ in range(400)).encode(), "y": ("abc" * 60 + "".join(r.choice("abcd") for _ in range(100))).encode(), "z": b"q"}
    models = langid.Models(samples)
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(0, 300))) for _ in range(30)] + [samples["x"].decode(), "abc" * 100, "", "z" * 50, samples["x"].decode()[37:300] + "ab" * 40]
    body = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(langid, "SPAN", span)
    found = models.phrases(np.frombuffer(body, np.uint8), offsets)

    def plainly(text, model):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in model:
                size += 1
            at, n = at + size, n + 1
        return n

    assert found.tolist() == [[plainly(t.encode(), samples[k]) for k in models.languages] for t in texts]


def test_models_of_very_many_languages_are_bounded(spark):
    given = spark.createDataFrame([(i * 5 + j, f"wort{i} " * 400, f"l{i:03}") for i in range(60) for j in range(5)], "doc_id long, text string, lang string")
    samples = langid.sample(given, "doc_id", "text", "lang")
    assert len(samples) == 60 and sum(map(len, samples.values())) <= langid.ALL_BYTES


def test_licenses(spark, docs, rows):
    texts = [(i, f"{a} {t} {b}") for i, (t, a, b) in enumerate(
        (t, a, b) for t in licenses.TEMPLATES.values() for a, b in (("", ""), ("Some words before it stand", "and after, too."), (" x" * 300, " y" * 9))
    )] + [(r[0] + 1000 if r[0] is not None else None, r[1]) for r in rows]
    given = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, licenses string")
    known = {k: set(plain.grams(plain.terms(v), 3)) for k, v in licenses.TEMPLATES.items()}

    def plainly(text):
        grams, out = plain.grams(plain.terms(text), 3), {}
        for name, own in known.items():
            size = licenses.size_class(len(own))
            for a in range(0, len(grams), size):
                share = len(own & set(grams[a : a + 2 * size])) / len(own)
                if share >= 0.8:
                    out[name] = max(share, out.get(name, 0))
        return sorted(out.items())

    found = licenses.scan_licenses(given).collect()
    assert len(found) == len(texts)
    expected = {i: plainly(t) for i, t in texts}
    for r in found:
        assert [(x["name"], pytest.approx(x["containment"])) for x in r["licenses"]] == expected[r["doc_id"]]
    assert sum(bool(v) for v in expected.values()) >= 30


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    for found in (
        substrings.remove_repeats(none), suffixes.remove_earlier(none), lines.dedup_lines(none), quality.judge(none), near.near_classes(none),
        postings.contamination(none, items), packing.pack_documents(none, TOKENIZER), langid.identify(none), licenses.scan_licenses(none),
    ):
        assert found.collect() == []
    assert [r["n_hit"] for r in postings.contamination(docs.limit(3), items).collect()] == [0, 0, 0]


def test_any_column_name_may_clash(spark):
    given = spark.createDataFrame([(1, "a line\nof text", "x", "y", "z")], "doc_id long, text string, _ string, __ string, filling string")
    row = lines.dedup_lines(given).first()
    assert row["row"].asDict() == {"doc_id": 1, "_": "x", "__": "y", "filling": "z", "___": True}
    assert quality.judge(given.withColumns({"lang": plain_lit("en"), "source": plain_lit("s")}), carry=True).select("given.*").columns[:5] == given.columns


def test_nothing_is_labelled(spark):
    given = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {tuple(r)[2:] for r in langid.identify(given).collect()} == {("und", 0.0)}
