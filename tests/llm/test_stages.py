"""Every stage of the pipeline with nulls, blanks, long texts, repeated rows and ids, clashing columns, and no rows."""

import pytest

import corpus_pipeline
from sediment.llm import near, quality

from llm import plain

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    return plain.collection(long_words=40_000)


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With the columns `_`, `row`, `doc`, `copy`, `place` ... that the stages use inside."""
    given = plain.frame(spark, rows)
    return given.withColumns({c: given["doc"] for c in ("_", "copy", "place", "own", "gone", "root", "given")}).cache()


def kept(found, docs):
    assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
    out = found.collect()
    assert all(r["_"] == r["copy"] == r["pivot"] == "clash" for r in out)
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in out), key=repr)


def as_given(rows):
    return sorted(((i, t, lang, source) for i, t, lang, source, _ in rows), key=repr)


def test_quality_rules(spark, docs, rows):
    judged = plain.quality(rows, quality.RATIOS, quality.TRUST)
    found = kept(STAGES["quality_rules"](spark, docs, SF), docs)
    assert found == as_given(r for r, j in zip(rows, judged) if j[-1]) and 10 < len(found) < len(rows)


def test_line_dedup(spark, docs, rows):
    left = plain.line_dedup(rows)
    assert kept(STAGES["line_dedup"](spark, docs, SF), docs) == as_given((r[0], left[r[0]][2], *r[2:]) for r in rows)


def test_near_dedup(spark, docs, rows):
    classes, expected = plain.near_classes(rows), {}
    for r in rows:
        if not plain.words(r[1]) or classes[plain.ident(r[0])] == plain.ident(r[0]):
            expected[r[0], tuple(plain.words(r[1]))] = r
    found = kept(STAGES["near_dedup"](spark, docs, SF), docs)
    assert [r[0] for r in found] == [r[0] for r in as_given(expected.values())]
    assert {r[:2] for r in found} <= {r[:2] for r in rows}


def test_near_dedup_chooses_rows_and_not_ids(spark):
    r = plain.random.Random(9)
    t, u = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(2))
    given = [(1, t, "en"), (5, u, "en"), (5, t + " more", "en"), (5, u, "de"), (5, u.replace(" ", "\n"), "en"), (7, u, "fr"), (None, "", "x"), (None, None, "x"), (8, " \t", "x")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    found = STAGES["near_dedup"](spark, docs, SF).collect()
    assert sorted(((x["doc_id"], x["text"]) for x in found), key=repr) == sorted([(1, t), (5, u.replace(" ", "\n")), (8, " \t"), (None, None)], key=repr)
    again = STAGES["near_dedup"](spark, docs.repartition(2), SF).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_the_copy_key_is_one_in_python_and_sql(spark, docs):
    for r in docs.select("text", near.copy_key("text").alias("key")).collect():
        words = plain.words(r["text"])
        assert r["key"] == (near._copy_key(r["text"].encode()) if words else None)


def test_decontamination(spark, docs, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passage = " ".join(items[0][1].split()[:12])
    long = [r[1] for r in rows if r[1] and len(r[1]) > 50_000][0]
    more = [(2000, passage, None, None, 0), (2001, f"before, {passage}. After", "en", "a", 0), (2002, long + " " + passage, None, None, 0), (2000, "a clean text of this id", "en", "a", 0)]
    hit = plain.contamination([(i, *r[1:]) for i, r in enumerate(rows + more)], items)
    expected = as_given(r for i, r in enumerate(rows + more) if not hit[i][1])
    both = docs.unionByName(_like(spark, docs, more))
    assert kept(STAGES["decontamination"](spark, both, SF), docs) == expected
    assert len(expected) == len(rows) + 1


def _like(spark, docs, rows):
    given = plain.frame(spark, rows)
    return given.withColumns({c: given["doc"] for c in docs.columns if c not in given.columns})


def test_packing(spark, docs, rows):
    found = STAGES["packing"](spark, docs, SF).collect()
    assert {r["doc_id"] for r in found} == {r[0] for r in rows}


@pytest.mark.parametrize("name", list(STAGES))
def test_no_rows(spark, docs, name):
    found = STAGES[name](spark, docs.limit(0), SF)
    assert found.collect() == []
    assert name == "packing" or found.columns == docs.columns
