"""Workbooks (XLSX) as a Spark data source: a reader with inline and shared strings, and a writer of one sheet of strings."""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Namespaces of the format; characters that XML can't hold.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
SCHEMA = "file string, row_no int, header array<string>, cells array<string>"


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def read_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet as strings; cells by their reference, or by position where they have none; blank rows drop out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        sheet = min(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))
        with z.open(sheet) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                cells: dict[int, str] = {}
                for at, c in enumerate(row.iter(f"{MAIN}c"), 1):
                    if c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    else:
                        v = c.find(f"{MAIN}v")
                        value = "" if v is None or v.text is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                    cells[column_number(c.get("r") or "") or at] = value
                row.clear()
                if any(v.strip() for v in cells.values()):
                    yield [cells.get(i, "") for i in range(1, max(cells) + 1)]


def write_rows(rows: Iterator[list[str | None]], path: str) -> None:
    """A workbook of inline strings, written beside its place and then moved there."""
    with zipfile.ZipFile(path + ".new", "w", zipfile.ZIP_DEFLATED) as z:
        types = "http://schemas.openxmlformats.org/package/2006/content-types"
        doc, rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("[Content_Types].xml", f'<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{doc}"><sheets><sheet name="texts" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{doc}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            for n, row in enumerate(rows, 1):
                cells = "".join(f'<c r="{column_name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(ILLEGAL.sub("", v or ""))}</t></is></c>' for i, v in enumerate(row, 1))
                f.write(f'<row r="{n}">{cells}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    os.replace(path + ".new", path)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.clean = options["path"], options.get("cleanControlChars", "false") == "true"

    def partitions(self) -> list[_File]:
        return [_File(p) for p in sorted(glob.glob(os.path.join(self.path, "*.xlsx")) if os.path.isdir(self.path) else glob.glob(self.path))]

    def read(self, part: _File) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            rows = read_rows(f.read())
        header = [h.strip() for h in next(rows, [])]
        for n, row in enumerate(rows, 1):
            yield os.path.basename(part.path), n, header, [ILLEGAL.sub("", v) for v in row] if self.clean else row


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by header; a file without one of them gives nulls there."""
    return rows.select("file", "row_no", *[F.when(F.array_contains("header", c), F.get("cells", (F.array_position("header", F.lit(c)) - 1).cast("int"))).alias(c) for c in columns])


def write(df: DataFrame, path: str) -> None:
    """One workbook of a frame, streamed through the driver partition by partition. A sheet holds at most 1,048,576 rows."""

    def rows() -> Iterator[list[str | None]]:
        yield df.columns
        for r in df.select(*[F.col(c).cast("string") for c in df.columns]).toLocalIterator():
            yield list(r)

    write_rows(rows(), path)
