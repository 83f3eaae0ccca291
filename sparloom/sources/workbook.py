"""Workbooks: zipped sheets of XML, read as a stream of rows of text, and written.

Files come as ``binaryFile`` rows, so they may lie in any store that Spark reaches; a task reads one file at a time and
gives its rows on as it meets them.  Only the shared strings of that file are held.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparloom.session import ship

#: The names of a workbook's parts and of what they hold.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TARGETS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="r1"/></sheets></workbook>',
}
ROWS = 1024


def _ends(stream, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a name as they end; what has been read is let go."""
    path: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(element)
            continue
        path.pop()
        if element.tag == _MAIN + name:
            yield element
            element.clear()
            if path:
                path[-1].remove(element)


def _text(element: ElementTree.Element | None) -> str:
    """The runs of a string, without readings beside it."""
    if element is None:
        return ""
    return "".join(t.text or "" for part in ([element] + [r for r in element if r.tag == _MAIN + "r"]) for t in part if t.tag == _MAIN + "t")


def _column(reference: str) -> int:
    number = 0
    for c in re.match("[A-Za-z]+", reference)[0].upper():
        number = 26 * number + ord(c) - 64
    return number - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = cell.get("t", "n"), cell.find(_MAIN + "v")
    if kind == "inlineStr":
        return _text(cell.find(_MAIN + "is")) or None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)] or None
    return {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, cells by column from 0) of a sheet (the first one if none is named), rows and cells without
    a value left out.  A name that isn't there is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheets = [(s.get("name"), s.get(_ID)) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet")]
        found = [i for name, i in sheets if sheet is None or name == sheet]
        if not found:
            raise ValueError(f"no sheet {sheet!r}; there are {[n for n, _ in sheets]}")
        targets = {t.get("Id"): t.get("Target") for t in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(_TARGETS)}
        target = targets[found[0]]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as stream:
                shared = [_text(e) for e in _ends(stream, "si")]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
            number = 0
            for row in _ends(stream, "row"):
                number = int(row.get("r") or number + 1)
                cells, at = {}, -1
                for cell in row:
                    if cell.tag != _MAIN + "c":
                        continue
                    at = _column(cell.get("r")) if cell.get("r") else at + 1
                    if (v := _value(cell, shared)) is not None:
                        cells[at] = v
                if cells:
                    yield number, cells


def _named(cells: dict[int, str]) -> list[str]:
    """Column names of a header row: blank ones by their place, repeated ones by number."""
    names: list[str] = []
    for i in range(max(cells, default=-1) + 1):
        name = (cells.get(i) or "").strip() or f"column {i + 1}"
        again = sum(n == name or n.startswith(f"{name}.") and n[len(name) + 1 :].isdigit() for n in names)
        names.append(f"{name}.{again}" if again else name)
    return names


def parse_workbooks(files: DataFrame, sheet: str | None = None, row_column: str = "source_row", columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of the workbooks in ``files`` (a binary column ``content``): ``row_column``, the row's number in its
    sheet (the header is row 1), then a text column for each name in the header.

    Without ``columns`` the names are those of the smallest header by text; a workbook with a name that isn't among
    them is an error, one that lacks some has nulls there.  Blank cells are null; blank rows between others are rows
    of nulls; a sheet without rows gives none.  Numbers, dates and formulas show as they are stored, truth values as
    TRUE and FALSE.
    """
    ship(files.sparkSession)
    contents = files.select("content")

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                first = next(sheet_rows(content, sheet), (0, {}))
                if first[0] == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([_named(first[1])], pa.list_(pa.string()))], names=["names"])

    if columns is None:
        said = contents.mapInArrow(heads, "names array<string>").agg(F.min("names")).first()[0]
        columns = list(said or [])
    columns = list(columns)
    schema = ", ".join([f"`{row_column}` long", *[f"`{c}` string" for c in columns]])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                kinds = [pa.int64(), *[pa.string()] * len(columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=[row_column, *columns])
            held.clear()

        for batch in batches:
            for content in batch.column(0).to_pylist():
                places: list[int] = []
                last = 1
                for number, cells in sheet_rows(content, sheet):
                    if number == 1:
                        names = _named(cells)
                        if unknown := [n for n in names if n not in columns]:
                            raise ValueError(f"columns that other workbooks lack: {unknown}")
                        places = [names.index(c) if c in names else -1 for c in columns]
                        continue
                    for blank in range(last + 1, number):
                        held.append([blank, *[None] * len(columns)])
                        if len(held) >= ROWS:
                            yield from flush()
                    held.append([number, *[cells.get(p) for p in places or [-1] * len(columns)]])
                    last = number
                    if len(held) >= ROWS:
                        yield from flush()
        yield from flush()

    return contents.mapInArrow(rows, schema)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, row_column: str = "source_row", columns: Sequence[str] | None = None) -> DataFrame:
    """``parse_workbooks`` of the files at a path."""
    return parse_workbooks(spark.read.format("binaryFile").load(path), sheet, row_column, columns)


# ---- writing -------------------------------------------------------------------------------------------

_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ILLEGAL.sub("", str(value)))}</t></is></c>'


def workbook_content(names: Sequence[str], rows: Iterable[Sequence[object]], sheet: str = "Sheet1") -> bytes:
    """A workbook with one sheet: a header and the rows; characters that XML can't hold are left out.

    The archive's comment is a newline, its last byte, so that a text writer's line end can stand for it.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"\n"

        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)  # without a time, so equal rows give equal files

        for name, text in _PARTS.items():
            put(name, text.replace("{sheet}", escape(sheet, {'"': "&quot;"})))
        with z.open(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), "w", force_zip64=True) as part:
            part.write(f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            for row in ([*names], *rows):
                part.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            part.write(b"</sheetData></worksheet>")
    return out.getvalue()


def as_workbooks(df: DataFrame, file: Column, order: Sequence[str], sheet: str = "Sheet1") -> DataFrame:
    """(file, content): a workbook for each value of ``file``, rows in order.  A sheet may have 1,048,575 rows; the key
    must keep its rows below that, more are an error."""
    ship(df.sparkSession)
    names = df.columns

    def make(key: tuple, table: pa.Table) -> pa.Table:
        if table.num_rows >= 1 << 20:
            raise ValueError("more rows than a sheet may have; take a finer file key")
        ordered = table.sort_by([(c, "ascending") for c in order]).select(names)
        rows = (tuple(r.values()) for batch in ordered.to_batches(ROWS) for r in batch.to_pylist())
        return pa.table({"file": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([workbook_content(names, rows, sheet)], pa.binary())})

    keyed = df.withColumn("_file", file.cast("long"))
    return keyed.groupBy("_file").applyInArrow(make, "file long, content binary")


def write_workbooks(df: DataFrame, path: str, file: Column, order: Sequence[str], sheet: str = "Sheet1") -> None:
    """``as_workbooks`` into files of a folder, by Spark's own writer: one workbook a file, whatever its name."""
    # the writer ends each value with a newline, which is the archive's last byte
    lines = as_workbooks(df, file, order, sheet).select(F.expr("substring(content, 1, octet_length(content) - 1)").cast("string").alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
