"""Uploaded tables: encodings, many files, sheets, and what is wrong with a file."""

import io
import zipfile

import pytest

from quillmark.operators import mutations as M
from quillmark.sources import files, tabular

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def xlsx(rows_xml, shared=None, sheets=("Data", "Other"), target="worksheets/sheet7.xml"):
    """A workbook of the parts that a reader needs."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId2" Target="worksheets/none.xml"/><Relationship Id="rId1" Target="{target}"/></Relationships>')
        z.writestr("xl/worksheets/sheet7.xml", f"<worksheet {NS}><sheetData>{rows_xml}</sheetData></worksheet>")
        if shared is not None:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{shared}</sst>")
    return out.getvalue()


STUDENTS = xlsx(
    '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="E2" t="inlineStr"><is><t>Email</t></is></c></row>'
    '<row r="3"><c r="B3"><v>1001</v></c><c r="C3" t="s"><v>2</v></c></row>'
    '<row r="5"><c r="B5" t="inlineStr"><is><r><t>s</t></r><r><t>2</t></r></is></c><c r="C5" t="str"><f>A1</f><v>Bo &amp; Co</v></c><c r="E5" t="b"><v>1</v></c></row>'
    '<row r="6"><c r="B6"><v>1001</v></c><c r="C6"><v>2.50</v></c><c r="D6"/></row>',
    "<si><t> Student_ID </t></si><si><r><t>Full</t></r><r><t>_Name</t></r><rPh><t>no</t></rPh></si><si><t>Ann</t></si>",
)


def test_sheets_cells():
    assert list(tabular.xlsx_records(STUDENTS)) == [
        [" Student_ID ", "Full_Name", "", "Email"], ["1001", "Ann", "", ""], ["", "", "", ""], ["s2", "Bo & Co", "", "TRUE"], ["1001", "2.5", "", ""]
    ]
    assert list(tabular.xlsx_records(xlsx(""))) == [] and list(tabular.xlsx_records(xlsx('<row><c><v>1</v></c><c t="e"><v>#N/A</v></c></row><row><c><v>0.1</v></c></row>'))) == [["1", "#N/A"], ["0.1", ""]]
    assert list(tabular.xlsx_records(xlsx('<row r="1"><c r="A1"><v>5</v></c></row>', target="/xl/worksheets/sheet7.xml"))) == [["5"]]
    assert [tabular._number(x) for x in ("5.0", "-3", "0.30000000000000004", "1e3")] == ["5", "-3", "0.3", "1000"] and tabular._column("AA") == 26


def test_a_sheet_feeds_the_student_import(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.xlsx").write_bytes(STUDENTS)
    spark.dataSource.register(tabular.SheetSource)
    df = spark.read.format("sheets").option("required", "student_id,full_name").load(str(tmp_path / "up"))
    by_spark = tabular.table_rows(spark, str(tmp_path / "up"), ("student_id", "full_name"))
    key = lambda d: sorted((r.row, sorted(r.cells.items()), r.error) for r in d.collect())
    assert key(df) == key(by_spark) and [r[0] for r in key(df)] == [2, 3, 4, 5]
    rows = df.select("row", df.cells["student_id"].alias("student_id"), df.cells["full_name"].alias("full_name"), df.cells["email"].alias("email"))
    new, outcomes = M.import_students(spark.createDataFrame([], "student_id string, full_name string, email string"), rows)
    assert sorted((r.row, r.outcome) for r in outcomes.collect()) == [(2, "created"), (3, "error"), (4, "created"), (5, "skipped")]
    assert sorted(tuple(r) for r in new.collect()) == [("1001", "Ann", None), ("s2", "Bo & Co", "TRUE")]


def test_a_folder_of_mixed_encodings(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    (d / "utf.csv").write_bytes("﻿Name ,Age\nJosé,1\n\n\nÑa,2\n".encode())
    (d / "latin.csv").write_bytes('age,NAME,age\n3,"Jos\xe9, ""x""",4\n5\n6,"two\r\nlines",7,8\n'.encode("latin-1"))
    (d / "none.csv").write_bytes(b"\n")
    (d / "other.csv").write_bytes(b"id\n1\n")
    (d / "bad.xlsx").write_bytes(b"PK\x03\x04 no zip")
    (d / "sheet.xlsx").write_bytes(xlsx('<row><c t="inlineStr"><is><t>name</t></is></c></row><row><c t="inlineStr"><is><t>Zoë</t></is></c></row>'))
    got = {}
    for r in tabular.table_rows(spark, str(d), ("name",)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row, r.cells, r.error))
    assert sorted(got.pop("utf.csv")) == [(2, {"name": "José", "age": "1"}, None), (3, {"name": "Ña", "age": "2"}, None)]
    assert sorted(got.pop("latin.csv"), key=lambda x: x[0]) == [(2, {"age": "4", "name": 'José, "x"'}, None), (3, {"age": None, "name": None}, None), (4, {"age": "7", "name": "two\r\nlines"}, None)]
    assert got == {"none.csv": [(None, None, "File has no header row.")], "other.csv": [(None, None, "Missing required column(s): name")], "bad.xlsx": [(None, None, "File can't be read: BadZipFile")], "sheet.xlsx": [(2, {"name": "Zoë"}, None)]}
    both = files.read_csv(spark, str(d), ("name",))
    assert both.columns == ["row", "name", "age"] and sorted((r.name or "") for r in both.collect()) == ["", "José", 'José, "x"', "Zoë", "two\r\nlines", "Ña"]
    kept = tabular.table_rows(spark, str(d / "utf.csv"), normalise=False).collect()
    assert set(kept[0].cells) == {"Name ", "Age"}
    with pytest.raises(files.HeaderError, match="Missing"):
        files.read_csv(spark, str(d / "other.csv"), ("name",))


def test_files_are_read_side_by_side(spark, tmp_path):
    d = tmp_path / "wide"
    d.mkdir()
    for i in range(40):
        (d / f"{i}.csv").write_text("a,b\n" + "\n".join(f"{i},{k}" for k in range(50)))
    spark.dataSource.register(tabular.SheetSource)
    df = spark.read.format("sheets").load(str(d))
    assert df.rdd.getNumPartitions() == 40 and df.count() == 2000
    plan = files.read_csv(spark, str(d))._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
