"""Scans, mainframe files, XSD and discovery."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sediment.operators.projections import flatten_struct, with_lineage
from sediment.plans.raw import load_raw
from sediment.sources.files import MALFORMED, LoadSpec, scan_csv, scan_json, scan_xml
from sediment.sources.fixed import decode_records, layout_schema, named, read_copybook, record_length, scan_fixed
from sediment.sources.profile import (
    profile_columns, profile_csv, profile_folder, profile_json, profile_schema, profile_xml,
)
from sediment.sources.xsd import read_xsd
from sediment.types import schema_of


def profiled(df):
    return {r["name"]: (r["sql_type"], r["nullable"]) for r in df.collect()}


# --- CSV -------------------------------------------------------------------------------------------

READINGS = T.StructType(
    [
        T.StructField("gauge_no", T.LongType(), True, {"header": "Gauge No"}),
        T.StructField("state", T.StringType(), True, {"header": "State"}),
    ]
)


def test_csv_titles_are_checked_and_renamed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Gauge No;State\n17;open\nnone;shut\n")
    rows = scan_csv(spark, str(tmp_path / "a.csv"), READINGS, delimiter=";").collect()
    assert [(r["gauge_no"], r["state"], r[MALFORMED]) for r in rows] == [(17, "open", None), (None, "shut", "none;shut")]
    (tmp_path / "b.csv").write_text("State;Gauge No\nopen;17\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan_csv(spark, str(tmp_path / "b.csv"), READINGS, delimiter=";").collect()
    with pytest.raises(ValueError, match="delimiter"):
        scan_csv(spark, str(tmp_path / "a.csv"), READINGS, delimiter="\n")


def test_csv_without_header_binds_by_position(spark, tmp_path):
    (tmp_path / "a.csv").write_text("17~~open\n18~~shut\n")
    rows = scan_csv(spark, str(tmp_path / "a.csv"), schema_of({"col_0": "INT", "col_1": "STRING"}), header=False, delimiter="~~")
    assert [(r["col_0"], r["col_1"]) for r in rows.collect()] == [(17, "open"), (18, "shut")]


def test_raw_load_keeps_malformed_rows(spark, db, tmp_path):
    (tmp_path / "a.csv").write_text("gauge,state\n17,open\nnone,shut\n18,open,again\n")
    spec = LoadSpec(str(tmp_path / "a.csv"), "csv", schema_of({"gauge": "INT", "state": "STRING"}))
    for n in (1, 2):
        report = load_raw(spark, spec, f"{db}.raw", batch_id=f"L{n}")
        assert (report["rows_read"], report["rows_written"], report["rows_malformed"], report["reconciled"]) == (3, 3, 2, True)
    assert {(r["gauge"], r["state"]) for r in spark.table(f"{db}.raw").collect()} == {(17, "open"), (None, "shut"), (18, "open")}
    texts = spark.table(f"{db}.raw_malformed").collect()
    assert sorted((r["_batch_id"], r["_text"]) for r in texts) == [(b, t) for b in ("L1", "L2") for t in ("18,open,again", "none,shut")]
    assert all(r["_source_file"].endswith("/a.csv") for r in texts)


def test_csv_profile(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "gauge no,site,taken,level,alarm,note,code,serial\n"
        "17,north,2031-04-01,3.25,TRUE,,7a,123456789012345678901\n"
        "18,,2031-04-02,2e-3,false,,8,5\n"
    )
    assert profiled(profile_csv(spark, str(tmp_path / "c.csv"))) == {
        "gauge_no": ("BIGINT", False), "site": ("STRING", True), "taken": ("STRING", False), "level": ("DOUBLE", False),
        "alarm": ("BOOLEAN", False), "note": ("DOUBLE", True), "code": ("STRING", False), "serial": ("DOUBLE", False),
    }
    (tmp_path / "h.csv").write_text("17,x\n,y\n")
    assert profiled(profile_csv(spark, str(tmp_path / "h.csv"), header=False)) == {
        "col_0": ("BIGINT", True), "col_1": ("STRING", False),
    }


def test_a_profile_reads_everything_unless_asked_for_a_head(spark, tmp_path):
    (tmp_path / "s.csv").write_text("level\n" + "1\n" * 1500 + "high\n")
    assert profiled(profile_csv(spark, str(tmp_path / "s.csv")))["level"] == ("STRING", False)
    assert profiled(profile_csv(spark, str(tmp_path / "s.csv"), sample_rows=10))["level"] == ("BIGINT", False)
    groups = spark.range(3000).select(F.floor(F.col("id") / 1500).cast("string").alias("file"), F.col("id").cast("string").alias("v"))
    assert {r["file"] for r in profile_columns(groups, by="file").collect()} == {"0", "1"}
    with pytest.raises(ValueError, match="each group"):
        profile_columns(groups, by="file", sample_rows=10)


def test_folder_profile(spark, tmp_path):
    (tmp_path / "North Site.csv").write_text("level\n3\n")
    (tmp_path / "7.csv").write_text("state,note\nopen,\n")
    (tmp_path / "about.txt").write_text("none")
    rows = profile_folder(spark, str(tmp_path)).collect()
    assert {(r["file_name"], r["table_name"], r["name"], r["sql_type"]) for r in rows} == {
        ("North Site.csv", "north_site", "level", "BIGINT"), ("7.csv", "t_7", "state", "STRING"), ("7.csv", "t_7", "note", "DOUBLE"),
    }


def test_a_folder_is_read_once_whatever_its_headers(spark, tmp_path):
    """Files with one header and files with headers of their own, quoted, blank and repeated titles, some files without rows."""
    r = random.Random(1)
    for n in range(60):
        width = r.randint(1, 5)
        titles = [r.choice([f"level {i}", f"x.{n}", '"a, b"', "", "Same", "same"]) for i in range(width)] if n % 3 else ["no", "level"]
        titles = titles if any(titles) else ["level"]
        rows = [",".join(r.choice(["1", "2.5", "true", "x", "", '"q, ""r"""']) for _ in range(len(titles) - r.randint(0, 1) * (len(titles) > 1))) for _ in range(r.randint(0, 4))]
        (tmp_path / f"site {n}+.csv").write_text("\n" * (n % 2) + "\n".join([",".join(titles), *rows]) + "\n")
    (tmp_path / "empty.csv").write_text("")
    spark.sparkContext.setJobGroup("folder", "profile")
    found = profile_folder(spark, str(tmp_path)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("folder"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12, "some for all files together"
    assert {f["file_name"] for f in found} == {f"site {n}+.csv" for n in range(60)}
    for n in range(0, 60, 7):
        one = profile_csv(spark, str(tmp_path / f"site {n}+.csv")).collect()
        assert sorted((f["ordinal"], f["name"], f["sql_type"], f["nullable"]) for f in found if f["file_name"] == f"site {n}+.csv") == sorted(map(tuple, one))
    headless = profile_folder(spark, str(tmp_path), header=False).where("file_name = 'site 3+.csv'").collect()
    assert [(f["ordinal"], f["name"]) for f in sorted(headless, key=lambda f: f["ordinal"])] == [(0, "col_0"), (1, "col_1")]


@pytest.mark.parametrize("line, delimiter, cells", [
    ("a,b", ",", ["a", "b"]), ('"a,b",c', ",", ["a,b", "c"]), ('"say ""x""";y', ";", ['say "x"', "y"]), ("a~~b~~", "~~", ["a", "b", ""]), ("", ",", [""]),
])
def test_cells_of_a_header(line, delimiter, cells):
    from sediment.sources.profile import header_cells

    assert header_cells(line, delimiter) == cells


# --- JSON ------------------------------------------------------------------------------------------

EVENTS = [
    {"no": 1, "what": "open", "by": {"shift": "early", "crew": None}, "seconds": 4.5, "ok": True, "steps": ["a", "b"]},
    {"no": 2, "what": "shut", "by": {"shift": "late", "crew": "blue"}, "seconds": 9, "ok": False, "steps": []},
    {"no": 3, "what": "open", "by": {"shift": "late"}, "seconds": None, "ok": True},
]
EVENT_TYPES = {
    "no": ("BIGINT", False), "what": ("STRING", False), "by_shift": ("STRING", False), "by_crew": ("STRING", True),
    "seconds": ("DOUBLE", True), "ok": ("BOOLEAN", False), "steps": ("STRING", True),
}


@pytest.mark.parametrize("sample_rows", [1000, None])
def test_ndjson_profile_and_scan(spark, tmp_path, sample_rows):
    path = tmp_path / "e.json"
    path.write_text("\n".join(map(json.dumps, EVENTS)) + "\n\n")
    profile = profile_json(spark, str(path), sample_rows=sample_rows)
    assert profiled(profile) == EVENT_TYPES
    rows = scan_json(spark, str(path), profile_schema(profile))
    found = {r["no"]: r for r in rows.collect()}
    assert (found[1]["by_shift"], found[2]["by_crew"], json.loads(found[1]["steps"])) == ("early", "blue", ["a", "b"])
    assert found[3]["seconds"] is None and found[3][MALFORMED] is None
    lineage = with_lineage(rows, "L1", F.current_timestamp()).first()
    assert lineage["_source_file"].endswith("/e.json")


def test_one_json_document(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(EVENTS, indent=1))
    profile = profile_json(spark, str(path), multiline=True)
    assert profiled(profile) == EVENT_TYPES
    assert scan_json(spark, str(path), profile_schema(profile), multiline=True).count() == 3
    (tmp_path / "empty.json").write_text("")
    with pytest.raises(ValueError, match="no records"):
        profile_json(spark, str(tmp_path / "empty.json"))


def test_flatten_refuses_clashing_names(spark):
    df = spark.sql("SELECT 1 AS by_shift, named_struct('shift', 2) AS by")
    with pytest.raises(ValueError, match="by_shift"):
        flatten_struct(df)


# --- XML and XSD -----------------------------------------------------------------------------------

XML = """<?xml version="1.0"?>
<log xmlns="urn:gauges">
  <record><no>17</no><site>north</site><level>3.25</level><alarm>true</alarm></record>
  <record><no>18</no><site>south</site><level>0.50</level><alarm>false</alarm></record>
</log>"""


def xsd(content, more=""):
    return f"""<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">{more}
      <xs:simpleType name="Depth"><xs:restriction base="xs:decimal"/></xs:simpleType>
      <xs:simpleType name="Level"><xs:restriction base="Depth"/></xs:simpleType>
      <xs:element name="log"><xs:complexType><xs:sequence>
        <xs:element name="record" maxOccurs="unbounded"><xs:complexType>{content}</xs:complexType></xs:element>
      </xs:sequence></xs:complexType></xs:element></xs:schema>"""


def element(name, kind="xs:string", **more):
    return f'<xs:element name="{name}" type="{kind}" ' + " ".join(f'{k}="{v}"' for k, v in more.items()) + "/>"


def columns(content, more=""):
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in read_xsd(xsd(content, more)).fields]


def test_xml_profile_scan_and_wrong_tag(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text(XML)
    profile = profile_xml(spark, str(path))
    assert profiled(profile) == {"no": ("BIGINT", False), "site": ("STRING", False), "level": ("DOUBLE", False), "alarm": ("BOOLEAN", False)}
    rows = scan_xml(spark, str(path), profile_schema(profile)).collect()
    assert {(r["no"], r["site"], r["level"], r["alarm"]) for r in rows} == {(17, "north", 3.25, True), (18, "south", 0.5, False)}
    with pytest.raises(ValueError, match="record"):
        profile_xml(spark, str(path), row_tag="row")


def test_xsd_gives_the_row_schema(spark, tmp_path):
    content = "<xs:sequence>" + element("no", "xs:long") + element("site", minOccurs="0") + element("level", "Level", nillable="true") \
        + element("alarm", "xs:boolean") + '<xs:element name="place"><xs:complexType><xs:sequence/></xs:complexType></xs:element></xs:sequence>'
    assert columns(content) == [("no", "bigint", False), ("site", "string", True), ("level", "double", True), ("alarm", "boolean", False), ("place", "string", False)]
    path = tmp_path / "c.xml"
    path.write_text(XML)
    assert scan_xml(spark, str(path), read_xsd(xsd(content))).where("no = 18").first()["level"] == 0.5
    with pytest.raises(ValueError, match="log"):
        read_xsd(xsd(content), "row")
    with pytest.raises(ValueError, match="single value"):
        read_xsd(xsd(content), "no")


def test_xsd_content_models():
    a, b, c = element("a"), element("b", "xs:int"), element("c", "xs:boolean")
    plain = [("a", "string", False), ("b", "int", False)]
    assert columns(f"<xs:all>{a}{b}</xs:all>") == plain
    assert columns(f"<xs:sequence>{a}<xs:choice>{b}{c}</xs:choice></xs:sequence>") == [plain[0], ("b", "int", True), ("c", "boolean", True)]
    assert columns(f'<xs:sequence><xs:sequence minOccurs="0">{a}</xs:sequence><xs:sequence>{b}</xs:sequence></xs:sequence>') == [("a", "string", True), plain[1]]
    group = f'<xs:group name="g"><xs:sequence>{b}</xs:sequence></xs:group>'
    assert columns(f'<xs:sequence>{a}<xs:group ref="g"/></xs:sequence>', group) == plain
    base = f'<xs:complexType name="Base"><xs:sequence>{a}</xs:sequence></xs:complexType>'
    assert columns(f'<xs:complexContent><xs:extension base="Base"><xs:sequence>{b}</xs:sequence></xs:extension></xs:complexContent>', base) == plain
    loop = '<xs:group name="h"><xs:choice><xs:group ref="h"/></xs:choice></xs:group>'
    with pytest.raises(ValueError, match="'h' refers to itself"):
        columns('<xs:group ref="h"/>', loop)
    again = f'<xs:complexType name="Row"><xs:complexContent><xs:extension base="Row"><xs:sequence>{a}</xs:sequence></xs:extension></xs:complexContent></xs:complexType>'
    with pytest.raises(ValueError, match="'Row' refers to itself"):
        columns('<xs:complexContent><xs:extension base="Row"/></xs:complexContent>', again)
    for bad, message in (
        ("<xs:sequence/>", "no child"), ("<xs:sequence><xs:any/></xs:sequence>", "any element"), ('<xs:group ref="h"/>', "not declared"),
        (f"<xs:choice>{a}{element('a', 'xs:int')}</xs:choice>", "two types"),
    ):
        with pytest.raises(ValueError, match=message):
            columns(bad)


@pytest.mark.parametrize("content, least, most", [
    ("<xs:sequence>{a}</xs:sequence>", 1, 1), ("<xs:sequence>{a}{a}</xs:sequence>", 2, 2), ("<xs:choice>{a}{b}</xs:choice>", 0, 1),
    ("<xs:choice>{a}<xs:sequence>{b}{a}</xs:sequence></xs:choice>", 1, 1), ('<xs:sequence maxOccurs="unbounded">{a}</xs:sequence>', 1, 9),
    ('<xs:sequence><xs:choice minOccurs="0" maxOccurs="3">{a}{b}</xs:choice></xs:sequence>', 0, 3), ("<xs:sequence><xs:choice>{a}{b}</xs:choice>{a}</xs:sequence>", 1, 2),
    ('<xs:sequence>{b}<xs:element name="a" minOccurs="0" maxOccurs="0"/></xs:sequence>', 0, 0), ('<xs:group ref="g" maxOccurs="2"/>', 1, 2),
])
def test_how_often_a_child_may_be_there(content, least, most):
    group = f'<xs:group name="g"><xs:sequence>{element("a", "xs:int")}</xs:sequence></xs:group>'
    fields = {f.name: f for f in read_xsd(xsd(content.format(a=element("a", "xs:int"), b=element("b")), group)).fields}
    if not most:
        assert "a" not in fields
        return
    assert fields["a"].nullable == (least == 0)
    assert (fields["a"].dataType.simpleString(), fields["a"].metadata) == (("string", {"items": "INT"}) if most > 1 else ("int", {}))


def test_no_value_of_a_repeated_child_is_lost(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        "<log><record><no>1</no><tag>x</tag><tag>y</tag><level>3</level><note/></record>"
        "<record><no>2</no><tag>z</tag><level>4</level><level>5</level><note>a</note><note>b</note></record><record><no>3</no><level>no</level></record></log>"
    )
    content = "<xs:sequence>" + element("no", "xs:int") + element("tag", minOccurs="0", maxOccurs="unbounded") + element("level", "xs:int", maxOccurs="4") + element("note") + "</xs:sequence>"
    rows = {r["no"]: r for r in scan_xml(spark, str(tmp_path / "r.xml"), read_xsd(xsd(content))).collect()}
    assert [(r["tag"], r["level"], r["note"], r[MALFORMED] is None) for r in (rows[1], rows[2])] == [
        ('["x","y"]', "[3]", "", True), ('["z"]', "[4,5]", '["a","b"]', True)]
    assert rows[3][MALFORMED] is not None
    assert profiled(profile_xml(spark, str(tmp_path / "r.xml"))) == {
        "level": ("STRING", False), "no": ("BIGINT", False), "note": ("STRING", True), "tag": ("STRING", True)}


# --- mainframe files -------------------------------------------------------------------------------

COPYBOOK = """      * What a gauge reports, 64 bytes.
       01  GAUGE-REPORT.
           05  GAUGE-NO              PIC 9(6).
           05  PLACE.
               10  SITE              PIC X(8).
               10  DECK              PIC X.
           05  LEVEL                 PIC S9(5)V9(2) COMP-3.
           05  DRIFT                 PIC SV9(4) USAGE IS COMP.
           05  TREND                 PIC S9(4)V9.
           05  PULSES                PICTURE 9(9) BINARY.
           05  TICKS                 PIC S9(18) COMPUTATIONAL.
           05  STATE                 PIC X VALUE 'O'.
               88  IS-OPEN           VALUE 'O'.
           05  ALARM OCCURS 2 TIMES.
               10  KIND              PIC XX.
               10  SINCE             PIC 9(3) COMP-3.
           05  SPARE                 PIC X OCCURS 3.
           05  FILLER                PIC X(14).
"""


def nibbles(value, size, sign):
    return bytes.fromhex(str(abs(value)).rjust(2 * size - 1, "0") + sign)


def report(no, site, deck, level, drift, trend, pulses, ticks, state, alarms, spare):
    def text(s, n):
        return s.ljust(n).encode("cp037")

    digits = bytearray(0xF0 + int(c) for c in str(abs(trend)).rjust(5, "0"))
    digits[-1] = (0xD0 if trend < 0 else 0xC0) | digits[-1] & 0xF
    return b"".join([
        text(str(no).rjust(6, "0"), 6), text(site, 8), text(deck, 1), nibbles(level, 4, "d" if level < 0 else "c"),
        drift.to_bytes(2, "big", signed=True), bytes(digits), pulses.to_bytes(4, "big"), ticks.to_bytes(8, "big", signed=True),
        text(state, 1), *[text(k, 2) + nibbles(s, 2, "f") for k, s in alarms], *[text(c, 1) for c in spare], text("", 14),
    ])


REPORTS = [
    report(17, "Süd [2]", "A", -12345, -9999, 0, 999999999, -(10**17), "O", [("HI", 30), ("", 0)], "xyz"),
    report(900018, "", "", 9999999, 125, -31, 0, 10**17, "S", [("LO", 999), ("ZZ", 1)], "  !"),
]


def check_reports(rows):
    one, two = (r.asDict() for r in rows.orderBy("GAUGE_NO").collect())
    assert [one[k] for k in ("GAUGE_NO", "PLACE_SITE", "PLACE_DECK", "STATE")] == [17, "Süd [2]", "A", "O"]
    assert [str(one[k]) for k in ("LEVEL", "DRIFT", "TREND")] == ["-123.45", "-0.9999", "0.0"]
    assert (one["PULSES"], one["TICKS"]) == (999999999, -(10**17))
    assert [two[k] for k in ("GAUGE_NO", "PLACE_SITE", "PULSES", "TICKS")] == [900018, "", 0, 10**17]
    assert [str(two[k]) for k in ("LEVEL", "DRIFT", "TREND")] == ["99999.99", "0.0125", "-3.1"]
    assert json.loads(one["ALARM"]) == [{"KIND": "HI", "SINCE": 30}, {"KIND": "", "SINCE": 0}]
    assert json.loads(two["SPARE"]) == ["", "", "!"]


def test_copybook_layout():
    layout = read_copybook(COPYBOOK)
    assert record_length(layout) == len(REPORTS[0]) == 64
    assert [f.name for f in named(layout)] == [
        "GAUGE_NO", "PLACE_SITE", "PLACE_DECK", "LEVEL", "DRIFT", "TREND", "PULSES", "TICKS", "STATE", "ALARM", "SPARE"]
    types = {f.name: f.dataType.simpleString() for f in layout_schema(layout).fields}
    assert (types["LEVEL"], types["DRIFT"], types["TICKS"], types["ALARM"]) == ("decimal(7,2)", "decimal(4,4)", "bigint", "string")


def book(*lines):
    return "       01  R.\n" + "".join(f"       {line}\n" for line in lines)


def laid_out(*lines, **how):
    return {f.name: (f.offset, f.length, f.kind) for f in read_copybook(book(*lines), **how)}


@pytest.mark.parametrize("clause", [
    "PIC X REDEFINES B", "PIC X REDEFINES", "PIC 9(3)P", "PIC Q", "COMP-1 PIC 9", "PIC X OCCURS 1 TO 5 TIMES DEPENDING ON N", "PIC X OCCURS 1 TO 5",
    "PIC X OCCURS N TIMES", "PIC 9(4) COMP-9", "PIC X SYNCHRONIZED", "PIC N(4)", "POINTER", "PIC X(3) COMP-3", "PIC 9(19) COMP", "PIC S9 SIGN IS SEPARATE", "", "PIC X VALUE 'open",
])
def test_clauses_that_are_not_understood_are_refused(clause):
    with pytest.raises(ValueError):
        read_copybook(book(f"05  A  {clause}.", "05  B PIC X."))


FILLING = [
    "VALUE 'a. b'", 'VALUE "it\'s, PIC X"', "VALUE ZERO", "VALUES ARE 1 THRU 5, 7", "VALUE -1.5", "VALUE X'0F'", "JUSTIFIED RIGHT", "BLANK WHEN ZEROES", "GLOBAL",
]


@pytest.mark.parametrize("more", FILLING)
@pytest.mark.parametrize("clauses, expected", [
    (["PIC S9(5)", "COMP-3"], (3, "comp3")), (["PICTURE IS 9(5)", "USAGE IS BINARY"], (4, "comp")), (["OCCURS 2 TIMES", "PIC X(4)"], (4, "text")),
    (["PIC S9(4)", "SIGN IS LEADING SEPARATE CHARACTER"], (5, "zoned")), (["USAGE COMP-2"], (8, "float")), (["PIC -(4)9.99"], (8, "text")),
])
def test_clauses_stand_in_any_order(clauses, expected, more):
    import itertools

    for order in itertools.permutations([*clauses, more]):
        layout = laid_out("05  A", *[f"        {clause}" for clause in order], "    .", "05  B PIC X.")
        assert layout["A"] == (0, *expected)
        assert layout["B"][0] == expected[0] * (2 if "OCCURS 2 TIMES" in clauses else 1)


def test_groups_hand_down_usage_and_sign():
    layout = laid_out(
        "05  G COMP-3 SIGN LEADING SEPARATE.", "    10  A PIC 9(5).", "    10  H.", "        15  B PIC S9(3)V99.",
        "05  S SIGN IS TRAILING SEPARATE.", "    10  C PIC S9(3).", "    10  D PIC 9(3).", "    10  E PIC S9(3) LEADING.",
        "05  T OCCURS 3 ASCENDING KEY IS F INDEXED BY I, J USAGE COMP.", "    10  F PIC 9(5).", "05  Z PIC X.",
    )
    assert layout == {
        "G_A": (0, 3, "comp3"), "G_H_B": (3, 3, "comp3"), "S_C": (6, 4, "zoned"), "S_D": (10, 3, "zoned"), "S_E": (13, 3, "zoned"), "T": (16, 4, "group"), "Z": (28, 1, "text"),
    }
    with pytest.raises(ValueError, match="another usage"):
        read_copybook(book("05  G COMP-3.", "    10  A PIC 9(5) COMP."))


def test_alternatives_share_their_bytes():
    layout = laid_out(
        "05  A PIC X(6).", "05  B REDEFINES A.", "    10  C PIC 9(2).", "    10  FILLER.", "        15  D PIC X(7).", "05  E REDEFINES A PIC 9(3).", "05  F PIC X.",
    )
    assert layout == {"A": (0, 6, "text"), "B_C": (0, 2, "zoned"), "B_D": (2, 7, "text"), "E": (0, 3, "zoned"), "F": (9, 1, "text")}
    for lines in (["05  A PIC X.", "05  B PIC X.", "05  C REDEFINES A PIC X."], ["05  A PIC X.", "05  A PIC X."]):
        with pytest.raises(ValueError):
            read_copybook(book(*lines))


def test_continued_lines_and_literals():
    text = "000100 01  R.\n000200     05  A PIC X(3) VALUE 'one\n000300-        'two. 05 Q PIC X'.\n000400     05  LONG-\n000500-    NAME PIC 9(2)\n000600*  a remark\n000700D    05  NOT-HERE PIC X.\n000800         COMP-3."
    assert [(f.name, f.offset, f.length) for f in read_copybook(text)] == [("A", 0, 3), ("LONG_NAME", 3, 2)]


def test_tables_of_variable_length(spark):
    lines = ["05  N PIC 9.", "05  P OCCURS 1 TO 4 TIMES DEPENDING ON N PIC X(2).", "05  M PIC 9.", "05  Q OCCURS 3 DEPENDING ON M.", "    10  V PIC S9(3) COMP-3.", "05  Z PIC X."]

    def record(n, p, m, q, z, room=None):
        parts = [str(n).encode("cp037"), *[x.encode("cp037") for x in p], b"\x40\x40" * (room[0] - len(p) if room else 0)]
        return b"".join([*parts, str(m).encode("cp037"), *[nibbles(v, 2, "d" if v < 0 else "c") for v in q], b"\0\0" * (room[1] - len(q) if room else 0), z.encode("cp037")])

    cases = [(2, ["ab", "cd"], 0, [], "x"), (4, ["ab", "cd", "ef", "gh"], 3, [1, -2, 3], "y"), (1, ["  "], 1, [999], "z")]
    expected = [(n, [x.rstrip() for x in p], m, [{"V": v} for v in q], z) for n, p, m, q, z in cases]
    for variable in (False, True):
        layout = read_copybook(book(*lines), variable_size_occurs=variable)
        assert record_length(layout) == 1 + 8 + 1 + 6 + 1
        df = spark.createDataFrame([(record(*c, room=None if variable else (4, 3)),) for c in cases], "value binary").coalesce(1)
        rows = [(r["N"], json.loads(r["P"]), r["M"], json.loads(r["Q"]), r["Z"]) for r in decode_records(df, layout).collect()]
        assert rows == expected
    layout = read_copybook(book(*lines), variable_size_occurs=True)
    wrong = spark.createDataFrame([(record(9, ["ab"], 1, [1], "x"),)], "value binary")  # no table has nine entries
    assert list(decode_records(wrong, layout).first()) == [9, None, None, None, None]
    for bad in (["05  T OCCURS 2.", "    10  K PIC 9.", "    10  U PIC X OCCURS 1 TO 2 DEPENDING ON K."], ["05  U PIC X OCCURS 1 TO 2 DEPENDING ON K.", "05  K PIC 9."]):
        with pytest.raises(ValueError):
            read_copybook(book(*bad))
    with pytest.raises(ValueError, match="redefined"):
        read_copybook(book("05  K PIC 9.", "05  A PIC X(4).", "05  U REDEFINES A PIC X OCCURS 1 TO 2 DEPENDING ON K."), variable_size_occurs=True)


def test_separate_and_leading_signs(spark):
    from sediment.functions.ebcdic import decode_display_text, decode_zoned

    cases = {
        "trailing": [("F1F2C3", 123), ("F1F2D3", -123), ("F1F2F3", 123), ("C1F2F3", None), ("4EF1F2", None)],
        "leading": [("C1F2F3", 123), ("D1F2F3", -123), ("F1F2D3", None)],
        "leading separate": [("4EF1F2F3", 123), ("60F1F2F3", -123), ("F0F1F2F3", None)], "trailing separate": [("F1F2F34E", 123), ("F1F2F360", -123), ("60F1F2F3", None)],
    }
    texts = {"trailing": [("12C", 123), ("12L", -123), ("-12", -12), ("12-", -12)], "leading": [("A23", 123), ("J23", -123), ("+12", 12), ("12L", None)]}
    for sign, rows in cases.items():
        df = spark.createDataFrame(rows, "h string, v int")
        assert [r[0] for r in df.select(decode_zoned(F.unhex("h"), 3, 0, True, sign)).collect()] == [v for _, v in rows]
    for sign, rows in texts.items():
        df = spark.createDataFrame(rows, "t string, v int")
        assert [r[0] for r in df.select(decode_display_text(F.col("t"), 3, 0, sign)).collect()] == [v for _, v in rows]


def test_hexadecimal_floats(spark):
    from sediment.functions.ebcdic import decode_float

    # Known bytes: the sign, 16 to the power of 65 - 64, a fraction of 0.0625 is 1.
    known = [("41100000", 1.0), ("C276A000", -118.625), ("00000000", 0.0), ("40800000", 0.5), ("411000", None)]
    df = spark.createDataFrame(known, "h string, v double")
    assert [r[0] for r in df.select(decode_float(F.unhex("h"), 4)).collect()] == [v for _, v in known]
    row = spark.sql("SELECT unhex('C276A00000000000') AS a, unhex('4110000000000001') AS b").select(decode_float(F.col("a"), 8), decode_float(F.col("b"), 8)).first()
    assert (row[0], row[1]) == (-118.625, 1 + 16.0**-13)


def test_fixed_records(spark, db, tmp_path):
    path = tmp_path / "c.dat"
    path.write_bytes(b"".join(REPORTS * 50))
    layout = read_copybook(COPYBOOK)
    rows = scan_fixed(spark, str(path), layout)
    assert rows.count() == 100
    check_reports(rows.distinct())
    found = load_raw(spark, LoadSpec(str(path), "fixed", layout_schema(layout), layout=layout), f"{db}.gauges", batch_id="L1")
    assert found["rows_written"] == 100 and found["reconciled"]
    assert spark.table(f"{db}.gauges").first()["_source_file"] == str(path)


def sequence(*records, big_endian=True):
    heads = [len(r).to_bytes(2, "big") + b"\0\0" if big_endian else b"\0\0" + len(r).to_bytes(2, "little") for r in records]
    return b"".join(h + r for h, r in zip(heads, records))


@pytest.mark.parametrize("big_endian", [False, True])
def test_record_sequence(spark, tmp_path, big_endian):
    (tmp_path / "v.dat").write_bytes(sequence(REPORTS[0], REPORTS[1][:-12], big_endian=big_endian))  # the rest is blank
    check_reports(scan_fixed(spark, str(tmp_path / "v.dat"), read_copybook(COPYBOOK), is_record_sequence=True, big_endian=big_endian))


@pytest.mark.parametrize("content, message", [
    (sequence(REPORTS[0])[:-1], "ends inside the record at byte 0"), (sequence(REPORTS[0]) + b"\0", "ends inside a record header"),
    (sequence(REPORTS[0] + b"@"), "has 65 bytes, the layout 64"), (sequence(REPORTS[0], b""), "empty record header at byte 68"),
])
def test_broken_sequences_are_refused(spark, tmp_path, content, message):
    (tmp_path / "v.dat").write_bytes(content)
    with pytest.raises(Exception, match=message):
        scan_fixed(spark, str(tmp_path / "v.dat"), read_copybook(COPYBOOK), is_record_sequence=True, big_endian=True).collect()


def test_text_records(spark, tmp_path):
    book = "       01  R.\n           05  NO PIC 9(3).\n           05  SITE PIC X(4).\n           05  LEVEL PIC S9(2)V9.\n"
    (tmp_path / "t.txt").write_text("017nord02E\n018  w 41R\n019     -7\n0x0east000\n")
    rows = scan_fixed(spark, str(tmp_path / "t.txt"), read_copybook(book), is_text=True).collect()
    assert [(r["NO"], r["SITE"], r["LEVEL"]) for r in rows] == [
        (17, "nord", Decimal("2.5")), (18, "  w", Decimal("-41.9")), (19, "", Decimal("-0.7")), (None, "east", Decimal("0.0")),
    ]


def test_bad_numbers_are_null(spark):
    from sediment.functions.ebcdic import decode_comp3, decode_zoned

    df = spark.sql("SELECT unhex('12A4') AS p, unhex('F1F24040') AS z")
    row = df.select(decode_comp3(F.col("p"), 3).alias("p"), decode_zoned(F.col("z"), 4).alias("z")).first()
    assert (row["p"], row["z"]) == (None, None)


def test_profile_of_several_groups_in_one_pass(spark):
    df = spark.createDataFrame([("a", "1"), ("a", None), ("b", "x")], "f STRING, v STRING")
    rows = profile_columns(df, by="f").collect()
    assert {(r["f"], r["sql_type"], r["nullable"]) for r in rows} == {("a", "BIGINT", True), ("b", "STRING", False)}
