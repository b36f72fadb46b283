"""Container sources on files made here, and the sinks of reports and models."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>language</t></is></c></row>
<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="s"><v>3</v></c></row>
<row r="3"><c r="A3"><v>2</v></c><c r="C3" t="s"><v>3</v></c></row>
<row r="4"><c r="A4"><v>3</v></c><c r="B4" t="s"><v>2</v></c><c r="C4" t="s"><v>3</v></c></row>
</sheetData></worksheet>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t>characters</t></si><si><r><t>a</t></r><r><t>b</t></r></si><si><t>latin</t></si></sst>"""
PAGE = """<PcGts xmlns="http://example.com/page"><TextLine writerID=" w 1 "><TextEquiv><Unicode>x <expan>d<ex>omin</ex>o</expan> <expan>ab</expan> <expan><ex> </ex></expan></Unicode></TextEquiv></TextLine><TextLine><TextEquiv><Unicode><expan>d<ex>omin</ex>o</expan></Unicode></TextEquiv></TextLine><TextLine/></PcGts>"""


def test_spreadsheet(spark, tmp_path):
    from lexiloom.sources.archives import merged_entries, spreadsheet

    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/sharedStrings.xml", STRINGS)
    rows = spreadsheet(spark, str(tmp_path / "a.xlsx"), ["id", "characters", "language"])
    assert [tuple(r)[1:] for r in rows.orderBy("row").collect()] == [(0, "1", "ab", "latin"), (1, "2", None, "latin"), (2, "3", "ab", "latin")]
    merged = merged_entries(rows, ["characters", "language"], ["id"]).orderBy(F.desc("n")).collect()
    assert [tuple(r) for r in merged] == [("ab", "latin", 2, ["1", "3"]), (None, "latin", 1, ["2"])]
    with pytest.raises(Exception, match="has no columns"):
        spreadsheet(spark, str(tmp_path / "a.xlsx"), ["nothing"]).collect()


def test_page_xml(spark, tmp_path):
    from lexiloom.sources.archives import expansion_pairs, page_xml

    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("pages/0012_x.xml", PAGE)
        z.writestr("readme.txt", "no page")
    marks = page_xml(spark, str(tmp_path / "b.zip"))
    assert sorted((r.book, r.writer, r.visible, r.omitted, r.expanded, r.fault or "") for r in marks.collect()) == [
        (12, "unknown", "do", "omin", "domino", ""), (12, "w 1", "", "", "", "empty"), (12, "w 1", "ab", "", "ab", "unmarked"), (12, "w 1", "do", "omin", "domino", ""),
    ]
    assert expansion_pairs(marks).count() == 2


def test_json_files_and_sinks(spark, tmp_path):
    from lexiloom.sources.archives import Report, json_files, load_model, normalized, save_model

    (tmp_path / "f.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "g1.json").write_text(json.dumps({"a": 3}))
    assert [r.a for r in json_files(spark, str(tmp_path / "g*.json"), "a int", str(tmp_path / "f.json")).collect()] == [3]
    assert sorted(r.a for r in json_files(spark, str(tmp_path / "h*.json"), "a int", str(tmp_path / "f.json")).collect()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        json_files(spark, str(tmp_path / "h*.json"), "a int")
    df = spark.createDataFrame([(1, "é  x\n"), (2, None)], "k int, t string")
    assert [r.t for r in df.select(normalized("t").alias("t")).collect()] == ["é x", ""]
    Report().say("result", 1).table(df.select("k")).write(spark, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["result 1", "k", "1", "2"]
    save_model({"counts": df}, str(tmp_path / "m"))
    assert load_model(spark, str(tmp_path / "m"), ["counts"])["counts"].count() == 2
