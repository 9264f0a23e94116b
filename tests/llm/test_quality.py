"""The thresholds decide: outliers below the base cutoffs go, groups differ, a source of junk does not set its own limits."""

import random
from collections.abc import Iterator

import pyarrow as pa
import pytest

from sediment.llm import quality

from llm import plain

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(r, n=200, length=(3, 7), symbols=0.0, repeats=0, lines=0):
    """Words with symbols behind some, some five-word stretches twice, and some lines twice."""
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(*length))) for _ in range(n)]
    words = [w + "#" if r.random() < symbols else w for w in words]
    for _ in range(repeats):
        words += words[:5]
    text = [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
    for i in range(lines):
        text.append(f"z{i}{r.random()}")
        text.append(text[-1])
    return "\n".join(text)


def judged(spark, rows):
    found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    expected = plain.quality([(*r, None) for r in rows], quality.RATIOS, quality.TRUST)
    assert {k: r["kept"] for k, r in found.items()} == {e[0]: e[-1] for e in expected}
    return found


OUTLIERS = {
    "symbols": {"symbols": 0.2}, "chars": {"length": (12, 20)}, "repeats": {"n": 400, "repeats": 13}, "lines": {"n": 100, "lines": 9},
}


def test_every_measure_rejects_an_outlier_below_the_base_cutoffs(spark):
    r = random.Random(1)
    rows = [(i, prose(r, symbols=0.001, repeats=r.random() < 0.05), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, prose(r, **how), "en", "s1") for i, how in enumerate(OUTLIERS.values())]
    found = judged(spark, rows)
    for i, name in enumerate(OUTLIERS):
        x = found[1000 + i]
        assert not x["base_failed"] and not x["kept"], name
    assert sum(found[i]["kept"] for i in range(300)) >= 290


@pytest.mark.parametrize("measure", ["symbols", "chars", "repeats", "lines"])
def test_thresholds_differ_between_groups(spark, measure):
    """What is an outlier in one language is usual in another; a source of its own kind has a higher limit, up to TRUST times."""
    usual = {"symbols": {"symbols": 0.15}, "chars": {"length": (9, 15)}, "repeats": {"repeats": 2}, "lines": {"lines": 4}}[measure]
    r = random.Random(2)
    rows = [(i, prose(r), "en", f"s{i % 3}") for i in range(150)] + [(500 + i, prose(r, **usual), "de", f"s{i % 3}") for i in range(150)]
    rows += [(1000, prose(r, **usual), "en", "s0"), (1001, prose(r, **usual), "de", "s0")]
    found = judged(spark, rows)
    assert (found[1000]["base_failed"], found[1000]["kept"], found[1001]["kept"]) == (False, False, True)
    measured = quality.measure(spark.createDataFrame(rows, SCHEMA), *[quality.col(c) for c in ("lang", "source")]).select("row.*", *quality._MEASURES)
    limits = {(x["t_lang"], x["t_source"]): x[f"{measure}_limit"] for x in quality.thresholds(quality.sketches(measured)).collect()}
    assert min(v for (lang, _), v in limits.items() if lang == "de") > max(v for (lang, _), v in limits.items() if lang == "en")


def test_a_hot_source_of_junk(spark):
    """A third of all rows, in one source: its junk goes, and so does the same junk in a clean source; clean rows stay."""
    r = random.Random(3)
    rows = [(i, prose(r), "en", "clean") for i in range(400)]
    rows += [(1000 + i, prose(r, symbols=1.0), "en", "junk") for i in range(200)] + [(2000 + i, prose(r, symbols=1.0), "en", "clean") for i in range(5)]
    found = judged(spark, rows)
    assert not any(found[i]["kept"] for i in found if i >= 1000)
    assert sum(found[i]["kept"] for i in range(400)) >= 390


def test_a_small_source_rejects_nothing_usual(spark):
    r = random.Random(4)
    rows = [(i, prose(r, symbols=0.02), "en", f"s{i % 4}") for i in range(200)] + [(900, prose(r), "en", "tiny"), (901, prose(r, symbols=0.02), "en", "tiny")]
    found = judged(spark, rows)
    assert found[900]["kept"] and found[901]["kept"]


def test_what_is_carried_stays_in_spark(spark, capsys):
    """Python gets texts alone, so a text that is carried isn't there twice; measures stay with their rows where a batch is cut."""
    r = random.Random(5)
    rows = [(i, None if i % 7 == 3 else prose(r, n=60_000 if i % 5 == 0 else i), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    found = quality.measure(docs, *[quality.col(c) for c in ("doc_id", "text")])
    assert {(x["row"]["doc_id"], x["row"]["text"]): x["n_words"] for x in found.collect()} == {(i, t): len(plain.words(t)) for i, t, *_ in rows}
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "ArrowEvalPython [_measured(coalesce(cast(text" in plan


def test_python_holds_some_megabytes_of_texts(spark, monkeypatch):
    """A batch was 10,000 texts, whatever their size; the session's setting stays as it was."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)

    def sized(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            n = pa.array([t.nbytes] * len(t))
            yield pa.StructArray.from_arrays([n] * len(quality._MEASURES), names=quality._MEASURES)

    monkeypatch.setattr(quality, "_measured", sized)
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefg ', 500) AS text", "'en' AS lang", "'s' AS source")
    found = [r["n_words"] for r in quality.judge(docs).collect()]
    assert len(found) == 6000 and 4000 < max(found) < 6 << 20
    assert spark.conf.get(setting, None) == before
