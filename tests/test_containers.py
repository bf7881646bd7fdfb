"""Workbooks, HTML tables and archives."""

import zipfile

from pyspark.sql import functions as F

from ledgerloom.sources import containers, files

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_workbooks(spark, tmp_path):
    folder = tmp_path / "x"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Date</t></si><si><r><t>Amo</t></r><r><t>unt</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd\\-mmm"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}><sheets><sheet name="Rows" r:id="r2"/><sheet name="Other" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {MAIN}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A2" s="1"><v>45000</v></c><c s="2"><v>45000.5</v></c><c s="3"><v>7</v></c><c r="AA2" t="inlineStr"><is><t>12</t></is></c></row></sheetData></worksheet>')
    (folder / "bad.xlsx").write_bytes(b"no archive")
    with zipfile.ZipFile(folder / "empty.xlsx", "w") as z:
        z.writestr("other", "x")
    rows = containers.read_workbooks(spark, str(folder))
    good = rows.filter("error is null").orderBy("row").collect()
    assert [r["row"] for r in good] == [0, 2] and good[0]["cells"] == ["Date", None, "Amount"]
    assert good[1]["cells"][:3] == ["2023-03-15", "2023-03-15 12:00:00", "7"] and good[1]["cells"][26] == "12"
    assert rows.filter("error is not null").count() == 2
    assert [tuple(r)[1:] for r in containers.named(rows.filter("row = 0"), ["d", "x", "a"]).collect()] == [(0, "Date", None, "Amount")]


def test_html_tables(spark, tmp_path):
    (tmp_path / "t.xls").write_text("<table><tr><th>Day</th><th>Sum </th></tr><TR class=x><td>5<br>Mar</td><td> 1,2\n 00 &amp; &#8377;</td></tr></table> tail")
    assert [r["cells"] for r in containers.read_html_tables(spark, str(tmp_path / "t.xls")).orderBy("row").collect()] == [["Day", "Sum"], ["5Mar", "1,2 00 & ₹"]]
    (tmp_path / "u.xls").write_bytes("<tr><td>é".encode("utf-16"))
    (tmp_path / "v.xls").write_bytes("<tr><td>é</td>".encode("latin-1"))
    (tmp_path / "w.xls").write_text("nothing")
    cells = {r["file"][-5]: (r["error"], r["cells"]) for r in containers.read_html_tables(spark, str(tmp_path / "[uvw].xls")).collect()}
    assert cells == {"u": (None, ["é"]), "v": (None, ["é"]), "w": ("no table rows", None)}


def test_archives(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.txt", "hello")
        z.writestr("b.csv", "x,y")
        z.writestr("Takeout/My Activity.html", "h")
    (tmp_path / "cut.zip").write_bytes((tmp_path / "z.zip").read_bytes()[:-8])
    rows = containers.read_archives(spark, str(tmp_path / "*.zip"))
    assert sorted((r["member"], r["text"]) for r in rows.filter("error is null").collect()) == [("Takeout/My Activity.html", "h"), ("b.csv", "x,y"), ("in/a.txt", "hello")]
    assert rows.filter("error is not null").count() == 1
    assert [r[0] for r in rows.filter("text = 'h'").select(containers.folder_of(F.col("member"))).collect()] == ["activity"]
    monkeypatch.setattr(containers, "MOST_BYTES", 3)
    assert {(bool(e), m) for e, m, _ in containers._members((tmp_path / "z.zip").read_bytes())} == {(True, "in/a.txt"), (False, "b.csv"), (False, "Takeout/My Activity.html")}


def test_one_column_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("name\nann\nbob\n")
    assert [r[0] for r in files.read_delimited(spark, str(tmp_path / "one.csv")).collect()] == ["ann", "bob"]
