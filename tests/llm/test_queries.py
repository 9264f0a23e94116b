"""The registered queries against SQL, and the stages of the pipeline each against the plain version of its own input."""

import pytest

import corpus_pipeline
from checks.compare import difference, oracle_connection
from sediment.llm import quality, suffixes
from sediment.llm.queries import ORACLES, QUERIES

from llm import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert difference(spark, con, SF, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES))
def test_query_has_all_documents(spark, name):
    ids = {r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_the_suffix_query_merges_levels(spark, monkeypatch):
    sizes, merge = [], suffixes.SuffixLevels._merge_equal

    def counted(index):
        before = [n for n, _ in index.levels]
        merge(index)
        sizes.append((before, [n for n, _ in index.levels]))

    monkeypatch.setattr(suffixes.SuffixLevels, "_merge_equal", counted)
    assert QUERIES["op10_suffix_dedup"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sizes == [([], []), ([1], [1]), ([1, 1], [2]), ([2, 1], [2, 1]), ([2, 1, 1], [4])]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op7_language_id"](spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.95 * len(found) > 0


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark):
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 3"))  # repeated rows
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    given = rows_of(docs)
    docs = functions["quality_rules"](spark, docs, SF).cache()
    judged = plain.quality(given, quality.RATIOS, quality.TRUST)
    assert sorted(rows_of(docs)) == sorted(r for r, j in zip(given, judged) if j[-1])
    assert docs.columns == columns

    given = rows_of(docs)
    docs = functions["line_dedup"](spark, docs, SF).cache()
    left = plain.line_dedup(given)
    assert sorted(rows_of(docs)) == sorted((r[0], left[r[0]][2], r[2], r[3], len(left[r[0]][2])) for r in given)

    given = rows_of(docs)
    docs = functions["near_dedup"](spark, docs, SF).cache()
    classes = plain.near_classes(given)
    assert sorted(rows_of(docs)) == sorted({r for r in given if classes[r[0]] == r[0]})
    assert docs.columns == columns and docs.count() < len(given)

    given = rows_of(docs)
    docs = functions["decontamination"](spark, docs, SF).cache()
    hit = plain.contamination(given, items)
    assert sorted(rows_of(docs)) == sorted(r for r in given if not hit[r[0]][1])
    assert docs.count() < len(given)

    placed = functions["packing"](spark, docs, SF)
    assert {r["doc_id"] for r in placed.select("doc_id").collect()} == {r[0] for r in rows_of(docs)}


def test_run_gives_what_the_stages_give(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 0


def test_a_short_item_removes_no_document(spark, tmp_path):
    items = [(1, "yes"), (2, "one, two three FOUR"), (3, "five words are an item")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, "yes"), (2, "so one two three four, yes"), (3, "that five words are an item"), (4, "nothing")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4]
