import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark import sources
from tidemark.sources import workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, strings="", styles="", properties=""):
    """A workbook of other programs' forms, from the XML of its sheets."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}>{properties}<sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="x{k}"/>' for k, n in enumerate(sheets)) + '<sheet name="chart" sheetId="99" r:id="gone"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="x{k}" Type="t" Target="{"/xl/" if k else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData>{xml}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")


def rows_of(df):
    return {(r.sheet, r.row): [(c.column, c.value) for c in r.cells] for r in df.collect()}


def test_forms_of_cells(spark, tmp_path):
    strings = '<si><t>Event</t></si><si><r><t>Ye</t></r><r><t xml:space="preserve">ar </t></r><rPh sb="0" eb="1"><t>no</t></rPh></si><si><t>a_x000B_b</t></si><si/>'
    styles = '<numFmts count="3"><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/><numFmt numFmtId="172" formatCode="[Red]0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="172"/><xf numFmtId="20"/></cellXfs>'
    one = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>Event</t></is></c><c r="E2" t="str"><f>x</f><v>E5</v></c></row>'
        '<row r="3"><c r="A3"><v>2.0000000000000001E-1</v></c><c r="B3"><v>2021</v></c><c r="D3" t="b"><v>1</v></c><c r="E3" t="e"><v>#N/A</v></c></row>'
        '<row r="5"/><row r="6"><c r="A6" t="s"><v>2</v></c><c r="B6" s="1"><v>44197</v></c><c r="C6" s="2"><v>44197.75</v></c><c r="D6" s="3"><v>1.5</v></c><c r="E6" s="4"><v>7</v></c></row>'
        '<row><c s="5"><v>0.5</v></c><c t="d"><v>2021-02-03</v></c><c/><c t="s"><v>3</v></c><c><v>-1E+20</v></c></row>'
    )
    book(tmp_path / "a.xlsx", {"S1": one, "blank": "", "head only": '<row r="1"><c r="A1"><v>1</v></c></row>'}, strings, styles)
    book(tmp_path / "b.XLSX", {"S9": '<row><c t="inlineStr"><is><t>t</t></is></c></row><row><c s="0"><v>1</v></c></row>'}, styles='<cellXfs><xf numFmtId="22"/></cellXfs>', properties='<workbookPr date1904="1"/>')
    (tmp_path / "~$a.xlsx").write_bytes(b"a lock file")
    got = rows_of(workbook.read_workbook(spark, str(tmp_path)))
    assert got == {
        ("S1", 3): [("Event", "0.2"), ("Year ", "2021"), ("Event.1", "true"), ("E5", None)],
        ("S1", 6): [("Event", "a\x0bb"), ("Year ", "2021-01-01 00:00:00"), ("C", "2021-01-01 18:00:00"), ("Event.1", "1.5"), ("E5", "7")],
        ("S1", 7): [("Event", "12:00:00"), ("Year ", "2021-02-03"), ("Event.1", None), ("E5", "-1e+20")],
        ("S9", 2): [("t", "1904-01-02 00:00:00")],
    }
    one_book = workbook.read_workbook(spark, f"file://{tmp_path}/a.xlsx", partitions=1)
    assert one_book.rdd.getNumPartitions() == 1 and len(rows_of(one_book)) == 3
    assert one_book.where("row = 3").select(workbook.cell(" event").alias("e"), workbook.cell("none").alias("n")).head() == ("0.2", None)
    with pytest.raises(Exception, match="FileNotFound"):
        workbook.read_workbook(spark, str(tmp_path / "none")).count()


def test_old_days_and_column_letters():
    assert workbook.date_text(1, False) == "1900-01-01 00:00:00" and workbook.date_text(59, False) == "1900-02-28 00:00:00" and workbook.date_text(61, False) == "1900-03-01 00:00:00"
    assert [workbook.letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(workbook._column(f"{workbook.letters(n)}7") == n for n in range(1500))


def test_what_is_written_is_read(spark, tmp_path):
    odd = ["plain", " blanks ", "<&>\"'", "a\nb\tc", "_x0041_", "\x01", "é😀", "12", "", None]
    data = [(f"b{n % 3}", f"S{n % 5}", n, odd[n % 10], n / 7 if n % 4 else None, n % 2 == 0, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=n)) for n in range(200)]
    df = spark.createDataFrame(data, "book string, sheet string, n long, text string, x double, flag boolean, at timestamp_ntz")
    made = workbook.write_workbooks(df, str(tmp_path / "out"), "book", "sheet", ["n"]).collect()
    assert sorted((r.path.split("/")[-1], r.sheets) for r in made) == [(f"b{n}.xlsx", 5) for n in range(3)]
    got = workbook.read_workbook(spark, str(tmp_path / "out")).select(F.regexp_extract("file", "([^/]+)[.]xlsx", 1), "sheet", *[workbook.cell(c) for c in ("n", "text", "x", "flag", "at")]).collect()
    want = [(b, s, str(n), t or None, None if x is None else workbook.number_text(repr(x)), str(f).lower(), str(at)) for b, s, n, t, x, f, at in data]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    with pytest.raises(Exception, match="has no sheet"):
        workbook.write_workbooks(spark.createDataFrame([("b", None, 1)], "book string, sheet string, n long"), str(tmp_path / "bad"), "book", "sheet", ["n"]).count()


def test_stamps_and_ratings(spark, tmp_path):
    stamps = [("Data Start", 2020, 3, 4, 10, 0, None), ("Video Start", 2020, 3, 4, 10, 1, 5), ("Crash", 2020, 3, 4, 10, 2, None), ("No hour", 2020, 3, 5, None, None, None)]
    df = spark.createDataFrame([("s", "P1", *row) for row in stamps], "book string, sheet string, Event string, Year int, Month int, Day int, Hour int, Minute int, Second int")
    workbook.write_workbooks(df, str(tmp_path / "stamps"), "book", "sheet", ["Day", "Hour", "Minute"]).count()
    got = sources.relative_stamps(sources.read_stamps_workbook(spark, str(tmp_path / "stamps"))).collect()
    assert {(r.subject_id, r.event, r.t) for r in got} == {("P1", "Video Start", 0.0), ("P1", "Crash", 55.0), ("P1", "No hour", 50335.0)}
    ratings = spark.createDataFrame([("r", s, e, b, a, "n") for s in ("P1", "P2") for e, b, a in ((" Bored", "1", "4"), ("tense ", "x", "2"))], "book string, sheet string, what string, `Relaxation IR` string, `Scene IR ` string, note string")
    workbook.write_workbooks(ratings, str(tmp_path / "ratings"), "book", "sheet", ["what"]).count()
    rows = sources.read_ratings_workbook(spark, str(tmp_path / "ratings"))
    assert rows.count() == 12
    from tidemark.operators import joins

    assert {tuple(r) for r in joins.paired_ratings(rows, "relaxation ir", "Scene IR").collect()} == {("P1", "bored", 1.0, 4.0), ("P2", "bored", 1.0, 4.0)}


def test_a_large_sheet_is_streamed():
    """Rows that were read do not stay in memory."""
    import tracemalloc

    rows = "".join(f'<row r="{n}"><c r="A{n}"><v>{n}</v></c><c r="B{n}"><v>1</v></c></row>' for n in range(1, 60_001))
    stream = io.BytesIO(f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>".encode())
    tracemalloc.start()
    assert sum(1 for _ in workbook.named_rows(workbook.sheet_rows(stream, [], [], False))) == 59_999
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
