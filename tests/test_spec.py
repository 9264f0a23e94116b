"""Text rules, types, cleaning steps and the check of specifications."""

import string
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sediment.functions.names import table_name, table_name_of
from sediment.functions.rules import MAX_FILE_NAME, MAX_PATH, PATH_PREFIXES, allowed, is_allowed
from sediment.functions.steps import (
    DATE_FORMATS, TIMESTAMP_FORMATS, Cast, Default, Lower, NullIf, ParseDate, ParseTimestamp, Trim, Upper, compile_steps,
    readable, step_from_dict, step_problem,
)
from sediment.plans.spec import Attribute, Entity, MasterKey, SilverSpec, SpecError, compile_entity, compile_silver
from sediment.types import ddl, normalize_sql_type, normalized_sql_type, parse_sql_type, schema_of, sql_type_of

WORD = string.ascii_letters + string.digits
ODD = [*map(chr, range(32)), "\x7f", *string.punctuation, " ", "é", "日"]

#: rule -> (a text that is fine, characters that may come first, that may follow, the longest text)
CHARACTERS = {
    "identifier": ("Ab_1", string.ascii_letters + "_", WORD + "_", 128),
    "path_segment": ("9-a", WORD + "_-", WORD + "_-", 128),
    "row_tag": ("a:b.c-d", string.ascii_letters + "_", WORD + "_.-:", 128),
    "job_name": ("Job 1.a-b_c", WORD, WORD + " _.-", 100),
    "simple_text": ("x/y+z:w@v#u", WORD + " _.-/+:@#", WORD + " _.-/+:@#", 64),
}


def cases_of(rule):
    """Every character at the first and at a later place, and texts just as long as may be and one longer."""
    fine, first, later, longest = CHARACTERS[rule]
    start, rest = first[0], later[0]
    cases = {fine: True, rest * 0: rule == "simple_text", start + rest * (longest - 1): True, start + rest * longest: False}
    for c in [*WORD, *ODD]:
        cases[c + rest] = c in first
        cases[start + c] = c in later
        cases[start + c + rest] = c in later
    return cases


OTHER = {
    "delimiter": {
        **{c: c not in '"\\\r\n\x00{}' for c in [*WORD, *ODD]}, "": False, "~" * 4: True, "~" * 5: False, "~}": False,
    },
    "time_of_day": {
        **{f"{h:02d}:{m:02d}": h < 24 and m < 60 for h in range(26) for m in (0, 9, 30, 59, 60, 99)}, "7:15": False, "07:15:00": False, "": False,
    },
    "path": {
        **{f"{p}folder/x.txt": True for p in PATH_PREFIXES}, **{f"/x{c}y": c not in "\"'`\\${}" and c not in ODD[:33] for c in [*WORD, *ODD]},
        "x/y": False, "ftp://h/x": False, "": False, "/..": False, "/x/../y": False, "/x/..y/z..": True, "/": True,
        "/" + "k" * (MAX_PATH - 1): True, "/" + "k" * MAX_PATH: False,
    },
    "file_name": {
        **{f"x{c}y": c not in "\"'`\\${}/" and c not in ODD[:33] for c in [*WORD, *ODD]},
        ".": False, "..": False, "...": True, "": False, "k" * MAX_FILE_NAME: True, "k" * (MAX_FILE_NAME + 1): False,
    },
}


@pytest.mark.parametrize("rule", [*CHARACTERS, *OTHER])
def test_rules_agree_on_columns_and_values(spark, rule):
    cases = OTHER[rule] if rule in OTHER else cases_of(rule)
    assert {v: is_allowed(rule, v) for v in cases} == cases
    df = spark.createDataFrame([(v,) for v in cases] + [(None,)], "v STRING").select("v", allowed(rule, F.col("v")).alias("ok"))
    assert {r["v"]: r["ok"] for r in df.collect()} == cases | {None: False}


def test_type_names(spark):
    fine = {f"decimal ( {p} , {s} )": f"DECIMAL({p},{s})" for p, s in ((1, 0), (1, 1), (38, 0), (38, 38))}
    fine |= {f" {n.lower()}\t": n for n in ("STRING", "BIGINT", "DOUBLE", "DATE")}
    wrong = {n: None for n in ("DECIMAL(39,1)", "DECIMAL(4,5)", "DECIMAL(0,0)", "DECIMAL", "ARRAY<INT>", "NUMBER", "")}
    cases = fine | wrong
    assert {k: normalize_sql_type(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases], "t STRING").select("t", normalized_sql_type(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == cases
    assert all(sql_type_of(parse_sql_type(n)) == n for n in fine.values())
    with pytest.raises(ValueError):
        parse_sql_type("ARRAY<INT>")


def test_column_list_as_ddl(spark):
    schema = schema_of({"tank level": "decimal(6, 3)", "site": "STRING"})
    assert ddl(schema) == "`tank level` DECIMAL(6,3), `site` STRING"
    assert spark.createDataFrame([], ddl(schema)).schema == schema


def test_table_names_agree(spark):
    files = {"Tank Levels.csv": "tank_levels", "7.csv": "t_7", "++.csv": "table", "x.y.csv": "x_y", "Übung.csv": "_bung"}
    names = {f: table_name_of("/in/" + f) for f in files}
    df = spark.createDataFrame([(f, f.rsplit(".", 1)[0]) for f in files], "f STRING, stem STRING")
    assert {r["f"]: r["n"] for r in df.select("f", table_name(F.col("stem")).alias("n")).collect()} == names
    assert {f: n for f, n in names.items() if f.isascii()} == {f: n for f, n in files.items() if f.isascii()}


def run_steps(spark, values, sql_type, *steps):
    df = spark.createDataFrame([(v,) for v in values], schema_of({"v": sql_type}))
    done = compile_steps(F.col("v"), df.schema["v"].dataType, steps)
    failed = done.failed if done.failed is not None else F.lit(False)
    return [(r["x"], r["f"]) for r in df.select(done.value.alias("x"), failed.alias("f")).collect()]


def test_text_steps(spark):
    assert run_steps(spark, [" Tank 4 ", None], "STRING", Trim(), Upper()) == [("TANK 4", False), (None, False)]
    assert run_steps(spark, ["OPEN"], "STRING", Lower()) == [("open", False)]
    assert run_steps(spark, ["-", " - ", "--", None], "STRING", NullIf(("-", "?"))) == [(None, False), (None, False), ("--", False), (None, False)]
    assert run_steps(spark, [-9, 4], "INT", NullIf(("-9",)), Default("0")) == [(0, False), (4, False)]


def test_conversions_note_what_failed(spark):
    assert run_steps(spark, ["8", "8.5", "eight", None], "STRING", Cast("SMALLINT")) == [(8, False), (None, True), (None, True), (None, False)]
    assert run_steps(spark, ["eight"], "STRING", Cast("INT"), Default("1")) == [(1, True)], "a later step does not hide it"


@pytest.mark.parametrize("layout", DATE_FORMATS + TIMESTAMP_FORMATS)
def test_every_layout_reads_what_it_writes(spark, layout):
    df = spark.sql("SELECT explode(sequence(timestamp'1999-12-30 23:58:57', timestamp'2000-03-02', interval 7 hours)) AS at")
    texts = [(r["t"], r["d"]) for r in df.select(F.date_format("at", layout).alias("t"), F.col("at").alias("d")).collect()]
    parse = ParseDate(layout) if layout in DATE_FORMATS else ParseTimestamp(layout)
    found = run_steps(spark, [t for t, _ in texts] + ["x"], "STRING", parse)
    expected = [(d.date() if layout in DATE_FORMATS else d, False) for _, d in texts]
    assert found == [*expected, (None, True)]


def test_steps_as_plain_data():
    assert step_from_dict({"kind": "null_if", "values": ["?"]}) == NullIf(("?",))
    for bad in ({}, {"kind": "shout"}, {"kind": "lower", "by": 2}, {"kind": "default"}):
        with pytest.raises(ValueError):
            step_from_dict(bad)


def test_defaults_are_read_by_their_type(spark):
    cases = {"BOOLEAN": ("false", "maybe"), "TINYINT": ("-128", "128"), "DATE": ("2031-02-28", "2031-02-29"), "DECIMAL(3,1)": ("99.9", "100"), "STRING": ("x", None)}
    for sql_type, (fine, wrong) in cases.items():
        assert readable(fine, parse_sql_type(sql_type)), sql_type
        assert wrong is None or not readable(wrong, parse_sql_type(sql_type)), sql_type
    assert step_problem(Default("12"), parse_sql_type("INT")) is None


READINGS = schema_of({"Gauge": "BIGINT", "site": "STRING", "level": "DOUBLE", "taken": "STRING"})
ASSETS = schema_of({"Origin": "STRING", "local_no": "STRING", "asset_no": "STRING", "class": "STRING"})
GAUGE = Entity(
    "gauge", "plant.gauge", ("GAUGE_NO",),
    (
        Attribute("gauge_no", "gauge"), Attribute("site", "SITE", (Trim(), Upper())),
        Attribute("level", "level", (Cast("decimal(8, 3)"),)), Attribute("taken", "taken", (ParseDate("dd-MM-yyyy"),), required=True),
    ),
    MasterKey("asset", "plant.assets", "origin", "LOCAL_NO", "asset_no", "class", "gauge"),
)


def problems_of(spark, entity):
    try:
        compile_entity(spark, entity, READINGS, {"plant.assets": ASSETS})
    except SpecError as error:
        return error.problems
    return []


def test_names_and_types_are_resolved(spark):
    done = compile_entity(spark, GAUGE, READINGS, {"plant.assets": ASSETS})
    assert done.business_key == ("gauge_no",) and done.quarantine == "plant.gauge_quarantine"
    assert {a.name: (a.source, a.type, a.required) for a in done.attributes} == {
        "gauge_no": ("Gauge", "BIGINT", True), "site": ("site", "STRING", False),
        "level": ("level", "DECIMAL(8,3)", False), "taken": ("taken", "DATE", True),
    }
    mk = done.master_key
    assert (mk.system_column, mk.key_column, mk.master_column, mk.entity_type_column) == ("Origin", "local_no", "asset_no", "class")


def with_attribute(name="extra", source="site", *steps):
    return replace(GAUGE, attributes=(*GAUGE.attributes, Attribute(name, source, steps)))


def with_master(**changes):
    return replace(GAUGE, master_key=replace(GAUGE.master_key, **changes))


BROKEN = {
    "no table name": replace(GAUGE, name="my gauge"),
    "no column name": with_attribute("ex-tra"),
    "reserved": with_attribute("_extra"),
    "'site' is defined more than once": with_attribute("SITE"),
    "no column 'depth'": with_attribute("extra", "depth"),
    "no attribute$": replace(GAUGE, attributes=(), business_key=("x",)),
    "step 1: cast to unsupported": with_attribute("extra", "site", Cast("ARRAY<INT>")),
    "step 2: .*layout": with_attribute("extra", "site", Trim(), ParseDate("yyyy")),
    "step 1: Spark refuses": with_attribute("extra", "gauge", Cast("DATE")),
    "is no double": with_attribute("extra", "level", Default("deep")),
    "null_if needs": with_attribute("extra", "site", NullIf(())),
    r"values \['\$'\] are not plain": with_attribute("extra", "site", NullIf(("-", "$"))),
    "there is no business key": replace(GAUGE, business_key=()),
    "'depth' is no attribute": replace(GAUGE, business_key=("depth",)),
    "listed more than once": replace(GAUGE, business_key=("site", "Site")),
    "double make no business key": replace(GAUGE, business_key=("depth",), attributes=(Attribute("depth", "level"),)),
    "looked up by one": replace(GAUGE, business_key=("gauge_no", "site")),
    "'level' is defined more than once": with_master(column="Level"),
    "a column and a value": with_master(entity_type_column=None),
    "entity type '' is not plain": with_master(entity_type=""),
    "more than one role": with_master(master_column="Local_No"),
    "no master key column 'golden'": with_master(master_column="golden"),
}


@pytest.mark.parametrize("message", BROKEN)
def test_what_is_wrong_is_said(spark, message):
    import re

    assert any(re.search(message, p) for p in problems_of(spark, BROKEN[message])), problems_of(spark, BROKEN[message])


def test_problems_are_found_together(spark):
    entity = replace(with_attribute("_extra", "depth"), name="my gauge", business_key=("nothing",))
    assert len(problems_of(spark, entity)) == 4
    many = replace(GAUGE, attributes=tuple(Attribute(f"a{i}", "gauge", (Trim(),) * 12) for i in range(300)), business_key=("a0", "a1", "a2", "a3", "a4", "a5"), master_key=None)
    assert problems_of(spark, many) == [], "there is no limit to numbers"


def test_problems_of_a_whole_job(spark, db):
    spark.createDataFrame([], READINGS).write.saveAsTable(f"{db}.readings")
    plain = replace(GAUGE, master_key=None)
    spec = SilverSpec(f"{db}.readings", f"{db}.s", "no name", (plain, replace(plain, name="other"), replace(plain, target=f"{db}.READINGS")), "$")
    with pytest.raises(SpecError) as error:
        compile_silver(spark, spec)
    text = str(error.value)
    for part in ("'no name' is no name", "unknown master key", "more than one table", "is what the job reads"):
        assert part in text
    with pytest.raises(SpecError, match="no entity"):
        compile_silver(spark, replace(spec, entities=()))
