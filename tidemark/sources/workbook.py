"""Workbooks (.xlsx) as a Spark data source, and a sink that writes them.

``spark.read.format("workbook").load(path)`` reads a workbook, or all workbooks of a
folder, as rows of file, sheet, row (its number in the sheet) and cells: an array of
(column, value) in the order of the sheet's header, which is its first row that is not
blank.  Values are text: numbers in their shortest form, dates and times in ISO form,
booleans true or false; blank cells and error values are NULL.  Columns without a
header have their letter as name, and a name that comes again gets ``.1``, ``.2`` and
so on.  Blank rows are left out.

Sheets are dealt to partitions by size; a partition streams one sheet after the other
and holds only the strings that the workbook shares.
"""

from __future__ import annotations

import datetime as dt
import itertools
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.storage import filesystem, publish

SCHEMA = "file string, sheet string, row long, cells array<struct<column: string, value: string>>"
_CELLS = pa.list_(pa.struct([("column", pa.string()), ("value", pa.string())]))
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", _CELLS)])

# Fixed values of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MAX_ROWS = 1_048_576


# ---- reading


@dataclass
class Sheets(InputPartition):
    """Sheets of workbooks: (file, name, member of the archive)."""

    parts: list[tuple[str, str, str]]

    def __init__(self, parts):
        self.parts = parts


def workbooks(path: str) -> list[str]:
    """The workbooks under ``path``: itself, or those of a folder but for hidden ones."""
    files, name = filesystem(path)
    info = files.get_file_info(name)
    if info.type == FileType.File:
        return [path]
    if info.type != FileType.Directory:
        raise FileNotFoundError(path)
    found = files.get_file_info(FileSelector(name))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == FileType.File and f.base_name.lower().endswith(".xlsx") and not f.base_name.startswith((".", "_", "~"))]


def open_workbook(path: str) -> zipfile.ZipFile:
    files, name = filesystem(path)
    return zipfile.ZipFile(files.open_input_file(name))


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and member of the archive of every worksheet, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    members = set(book.namelist())
    found = [(s.get("name"), posixpath.normpath(posixpath.join("/xl", targets.get(s.get(_REL)) or "")).lstrip("/")) for s in root.iter(f"{_MAIN}sheet")]
    return [(name, member) for name, member in found if member in members]


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, item in ElementTree.iterparse(stream):
            if item.tag == f"{_MAIN}si":
                found.append(_text(item))
                item.clear()
    return found


def _text(item) -> str:
    """The text of a string item: of its runs, but not of its phonetic ones."""
    parts = [t.text or "" for child in item for t in ([child] if child.tag == f"{_MAIN}t" else child.findall(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else [])]
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(parts))


def date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether it shows a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]', "", f.get("formatCode") or "") for f in root.iter(f"{_MAIN}numFmt")}
    dated = _DATE_FORMATS | {n for n, code in own.items() if re.search("[ymdhs]", code.lower()) and "general" not in code.lower()}
    styles = root.find(f"{_MAIN}cellXfs")
    return [int(x.get("numFmtId") or 0) in dated for x in styles] if styles is not None else []


def number_text(text: str) -> str:
    """A number in its shortest form: whole ones without a point."""
    x = float(text)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def date_text(serial: float, from_1904: bool) -> str:
    """A day number as ISO date and time; without a day, the time alone."""
    days = dt.date(1904, 1, 1) if from_1904 else dt.date(1899, 12, 31 if serial < 60 else 30)
    moment = dt.datetime.combine(days, dt.time()) + dt.timedelta(milliseconds=round(serial * 86_400_000))
    return moment.time().isoformat() if 0 <= serial < 1 and not from_1904 else moment.isoformat(" ")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_rows(stream, strings: list[str], dated: list[bool], from_1904: bool) -> Iterator[tuple[int, dict[int, str]]]:
    """Number and cells (by column, without blank ones) of a sheet's rows that are not blank."""
    number, parents = 0, []
    for event, item in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(item)
            continue
        parents.pop()
        if item.tag != f"{_MAIN}row":
            continue
        number = int(item.get("r") or number + 1)
        cells, at = {}, -1
        for cell in item.iter(f"{_MAIN}c"):
            at = _column(cell.get("r")) if cell.get("r") else at + 1
            kind, value = cell.get("t") or "n", cell.findtext(f"{_MAIN}v")
            if kind == "inlineStr":
                inline = cell.find(f"{_MAIN}is")
                value = _text(inline) if inline is not None else None
            elif value is None or kind == "e":
                continue
            elif kind == "s":
                value = strings[int(value)]
            elif kind == "b":
                value = "true" if value.strip() == "1" else "false"
            elif kind == "n":
                style = int(cell.get("s") or 0)
                value = date_text(float(value), from_1904) if style < len(dated) and dated[style] else number_text(value)
            if value:
                cells[at] = value
        item.clear()
        if parents:
            parents[-1].remove(item)  # the rows that were read do not stay with the sheet
        if cells:
            yield number, cells


def named_rows(rows: Iterator[tuple[int, dict[int, str]]]) -> Iterator[tuple[int, list[dict]]]:
    """The rows after the header, each with all columns of the header and of its own."""
    first = next(rows, None)
    if first is None:
        return
    names: dict[int, str] = {}
    used: dict[str, int] = {}
    for column, name in sorted(first[1].items()):
        n = used[name] = used.get(name, -1) + 1
        names[column] = f"{name}.{n}" if n else name
    for number, cells in rows:
        yield number, [{"column": names.get(c, letters(c)), "value": cells.get(c)} for c in sorted(names.keys() | cells.keys())]


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, partitions: int):
        self.path, self.most = path, partitions

    def partitions(self) -> list[Sheets]:
        sized = []
        for path in workbooks(self.path):
            with open_workbook(path) as book:
                sized += [(book.getinfo(member).file_size, (path, name, member)) for name, member in sheets_of(book)]
        # Largest first to the lightest partition; one workbook's sheets then stand in order.
        loads = [[0, []] for _ in range(max(1, min(self.most, len(sized))))]
        for size, part in sorted(sized, key=lambda s: -s[0]):
            lightest = min(loads, key=lambda x: x[0])
            lightest[0] += size
            lightest[1].append(part)
        return [Sheets(sorted(parts)) for _, parts in loads]

    def read(self, partition: Sheets) -> Iterator[pa.RecordBatch]:
        for path, parts in itertools.groupby(partition.parts, key=lambda p: p[0]):
            with open_workbook(path) as book:
                strings, dated = shared_strings(book), date_styles(book)
                properties = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
                from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
                for _, name, member in parts:
                    with book.open(member) as stream:
                        rows = named_rows(sheet_rows(stream, strings, dated, from_1904))
                        while some := list(itertools.islice(rows, 2048)):
                            columns = [[path] * len(some), [name] * len(some), [n for n, _ in some], [c for _, c in some]]
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class WorkbookSource(DataSource):
    """Options: path, and partitions (64 at most, unless it says otherwise)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        if not self.options.get("path"):
            raise ValueError("the workbook source needs a path")
        return WorkbookReader(self.options["path"], int(self.options.get("partitions", 64)))


def read_workbook(spark: SparkSession, path: str, partitions: int = 64) -> DataFrame:
    """file, sheet, row and cells of the workbook, or the folder of workbooks, at ``path``."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("partitions", partitions).load(path)


def cell(name: str, cells: str = "cells"):
    """The value of the column called ``name``, without regard to case and outer blanks; the first of several."""
    hit = F.filter(cells, lambda c: F.lower(F.trim(c["column"])) == name.strip().lower())
    return F.try_element_at(hit, F.lit(1))["value"]


# ---- writing


def _xml_text(text: str) -> str:
    """Text that XML can hold: what it cannot is written by number, as is text that looks like such a number."""
    return escape(re.sub("_x[0-9A-Fa-f]{4}_|[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", lambda m: f"_x{ord(m[0][0]):04X}_" + m[0][1:], text))


class _Strings(dict):
    """Numbers of shared strings, given as they come."""

    def __missing__(self, text: str) -> int:
        self[text] = n = len(self)
        return n


def _cell_xml(value, place: str, strings: _Strings) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{place}"><v>{value!r}</v></c>'
    if isinstance(value, dt.datetime):
        return f'<c r="{place}" s="1"><v>{(value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)!r}</v></c>'
    return f'<c r="{place}" t="s"><v>{strings[str(value)]}</v></c>'


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = f'xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1 : _REL.index("}")]}"'
_TYPES = "http://schemas.openxmlformats.org/package/2006"


def write_book(out, sheets: Iterator[tuple[str, Iterator[tuple]]], header: list[str]) -> int:
    """A workbook of sheets, given as name and rows, onto a stream; the number of its sheets."""
    strings, names = _Strings(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, rows in sheets:
            names.append(name)
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as sheet:
                sheet.write(f"{_HEAD}<worksheet {_NS}><sheetData>".encode())
                for n, row in enumerate(itertools.chain([header], rows), 1):
                    if n > MAX_ROWS:
                        raise ValueError(f"sheet {name} has over {MAX_ROWS} rows")
                    cells = "".join(_cell_xml(v, f"{letters(c)}{n}", strings) for c, v in enumerate(row))
                    sheet.write(f'<row r="{n}">{cells}</row>'.encode())
                sheet.write(b"</sheetData></worksheet>")
        with book.open("xl/sharedStrings.xml", "w") as table:
            table.write(f"{_HEAD}<sst {_NS}>".encode())
            for text in strings:
                table.write(f'<si><t xml:space="preserve">{_xml_text(text)}</t></si>'.encode())
            table.write(b"</sst>")
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        office = _REL[1 : _REL.index("}")]
        links = [("worksheet", f"worksheets/sheet{n}.xml") for n in range(1, len(names) + 1)] + [("sharedStrings", "sharedStrings.xml"), ("styles", "styles.xml")]
        book.writestr("xl/styles.xml", f'{_HEAD}<styleSheet {_NS}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        book.writestr("xl/workbook.xml", f"{_HEAD}<workbook {_NS}><sheets>" + "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_TYPES}/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{office}/{what}" Target="{target}"/>' for n, (what, target) in enumerate(links, 1)) + "</Relationships>")
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_TYPES}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/{target}" ContentType="{kind}.{what}+xml"/>' for what, target in links)
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
    return len(names)


def write_workbooks(df: DataFrame, folder: str, book: str, sheet: str, order: list[str]) -> DataFrame:
    """A workbook per value of ``book``, with a sheet per value of ``sheet`` whose rows stand by ``order``: path and sheets of each.

    The other columns are the sheets' columns.  A workbook is one task's, which streams
    it; its files appear whole under their names.  Rows without a book or sheet are an error.
    """
    columns = [c for c in df.columns if c not in (book, sheet)]
    named = lambda c: F.when(F.col(c).isNotNull(), F.col(c).cast("string")).otherwise(F.raise_error(F.lit(f"a row has no {c}")).cast("string")).alias(c)
    rows = df.select(named(book), named(sheet), *columns).repartition(book).sortWithinPartitions(book, sheet, *order)

    def run(batches):
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for name, of_book in itertools.groupby(flat, key=lambda r: r[0]):
            path = f"{folder}/{name}.xlsx"
            counted = []
            publish(path, lambda out, own=of_book, counted=counted: counted.append(write_book(out, ((s, (r[2:] for r in of_sheet)) for s, of_sheet in itertools.groupby(own, key=lambda r: r[1])), columns)))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array(counted, pa.int32())], names=["path", "sheets"])

    return rows.mapInArrow(run, "path string, sheets int")
