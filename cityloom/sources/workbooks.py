"""Spreadsheet workbooks (zipped XML) to rows of text, and back.

Files come as bytes through Spark's own reader, so any store Spark reaches will do; one file is one row there, which the format bounds at
1 048 576 rows a sheet. A sheet is parsed as a stream and its rows leave in batches. Numbers become their shortest text, dates and
times (cells whose style shows one) ISO text, booleans TRUE or FALSE, errors and empty cells null. Absent rows give no row; a
row is as long as its last cell. A null or empty file has no rows; bytes that are no workbook are an error that names the file."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as X
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 4096
# Name spaces of the format, and its built-in styles that show a date or a time.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
DATE_STYLES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def column_number(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def shows_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", code.lower())
    return any(ch in bare for ch in "ymdhs") and "general" not in bare


def moment(days: float, from_1904: bool) -> str:
    """Serial day to text; serials below 60 count from a day later, the format's extra leap day."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    at = start + timedelta(milliseconds=round(days * 86_400_000))
    return at.isoformat(" ", "seconds") if at.time().isoformat() != "00:00:00" else at.date().isoformat()


def number(text: str) -> str:
    v = float(text)
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def shown(node) -> str:
    """Text of a string item: its own and its runs', without phonetic hints."""
    return "".join(t.text or "" for part in node if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in part.iter(f"{MAIN}t"))


class Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = X.fromstring(self.zip.read("xl/workbook.xml"))
        settings = book.find(f"{MAIN}workbookPr")
        self.from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        links = {r.get("Id"): r.get("Target") for r in X.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = [(s.get("name"), self.place(links[s.get(LINK)])) for s in book.iter(f"{MAIN}sheet") if "worksheets/" in links.get(s.get(LINK), "")]
        names = set(self.zip.namelist())
        self.texts = [shown(s) for s in X.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates = set()
        if "xl/styles.xml" in names:
            styles = X.fromstring(self.zip.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
            for i, f in enumerate(styles.iterfind(f"{MAIN}cellXfs/{MAIN}xf")):
                n = int(f.get("numFmtId") or 0)
                if shows_date(own[n]) if n in own else n in DATE_STYLES:
                    self.dates.add(str(i))

    @staticmethod
    def place(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def text(self, cell) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            node = cell.find(f"{MAIN}is")
            return shown(node) if node is not None else None
        node = cell.find(f"{MAIN}v")
        if node is None or not node.text or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(node.text)]
        if kind == "b":
            return "TRUE" if node.text == "1" else "FALSE"
        if kind == "n":
            return moment(float(node.text), self.from_1904) if cell.get("s") in self.dates else number(node.text)
        return node.text

    def rows(self, place: str):
        """(row number, cells) in order; a parsed row is let go at once."""
        at, data = 0, None
        with self.zip.open(place) as f:
            for event, node in X.iterparse(f, ("start", "end")):
                if event == "start":
                    data = node if node.tag == f"{MAIN}sheetData" else data
                elif node.tag == f"{MAIN}row":
                    at = int(node.get("r") or at + 1)
                    cells: list = []
                    for cell in node.iterfind(f"{MAIN}c"):
                        i = column_number(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (i + 1 - len(cells))
                        cells[i] = self.text(cell)
                    node.clear()
                    if data is not None:
                        data.clear()
                    if cells:
                        yield at, cells


def decode(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, cells) of ``files(path, content)``: all sheets, or the one named."""

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())))],
                                              ["path", "sheet", "row", "cells"])

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, content, held = path.as_py(), content.as_py(), []
                if not content:
                    continue
                try:
                    book = Workbook(content)
                except (zipfile.BadZipFile, KeyError, X.ParseError) as e:
                    raise ValueError(f"{path} is no workbook: {e}") from e
                for name, place in book.sheets:
                    if sheet is not None and name != sheet:
                        continue
                    for at, cells in book.rows(place):
                        held.append((path, name, at, cells))
                        if len(held) == BATCH:
                            yield batch_of(held)
                            held = []
                if held:
                    yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, "path string, sheet string, row int, cells array<string>")


def read_workbooks(spark: SparkSession, path: str, names: list[str], sheet: str | None = None, header_row: int = 1) -> DataFrame:
    """Text columns ``names``, read by position, of all workbooks under ``path``; rows up to ``header_row`` are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return table(decode(files, sheet), names, header_row)


def table(rows: DataFrame, names: list[str], header_row: int = 1) -> DataFrame:
    return rows.where(F.col("row") > header_row).select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def encode(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(keys..., content): a workbook for each key, with a header and ``columns`` in ``order``. A key's rows meet in one task, sorted,
    and pass through it as a stream that leaves the sheet's compressed bytes; they have to fit a sheet, more are an error. Times are kept to the second, from March 1900 on."""
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if kinds[c] in ("date", "timestamp", "timestamp_ntz"):
            seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
            serial = F.datediff(F.col(c).cast("date"), F.lit("1899-12-30")) + seconds / F.lit(86400.0)
            return F.struct(F.lit("d").alias("kind"), serial.cast("string").alias("text"))
        plain = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        return F.struct(F.lit("n" if plain else "s").alias("kind"), F.col(c).cast("string").alias("text"))

    fields = [f.name for f in df.select(*keys).schema]
    rows = df.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.array(*[value(c) for c in columns]).alias("_cells"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"_o{i}" for i in range(len(order))], "_cells").select(*keys, "_cells")

    def run(batches):
        book, key, written = None, None, None

        def closed():
            return pa.RecordBatch.from_arrays([*key, pa.array([book.close()], pa.binary())], [*fields, "content"])

        for batch in batches:
            parts = [c.to_pylist() for c in batch.columns]
            for i, cells in enumerate(parts[-1]):
                now = [p[i] for p in parts[:-1]]
                if book is None or any(a != b and (a == a or b == b) for a, b in zip(now, written)):
                    if book is not None:
                        yield closed()
                    book, written = Sheet(columns), now
                    key = [pa.concat_arrays([c.slice(i, 1)]) for c in batch.columns[:-1]]
                book.add([(c["kind"], c["text"]) for c in cells])
        if book is not None:
            yield closed()

    return dealt.mapInArrow(run, T.StructType([*df.select(*keys).schema, T.StructField("content", T.BinaryType())]))


class Sheet:
    """A one-sheet workbook written row by row; cells are (kind, text) with kind n (number), d (serial day) or s (string)."""

    def __init__(self, header: list[str], sheet: str = "data"):
        first, office = MAIN[1:-1], LINK[1:].split("}")[0]
        package = "http://schemas.openxmlformats.org/package/2006"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            + "".join(f'<Override PartName="/xl/{p}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{k}+xml"/>'
                      for p, k in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles"))) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/>'
            f'<Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{first}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/styles.xml": f'<styleSheet xmlns="{first}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
            '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        }
        self.out, self.rows = io.BytesIO(), 0
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        for name, text in parts.items():
            self.zip.writestr(name, XML + text)
        self.part = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.part.write(f'{XML}<worksheet xmlns="{first}"><sheetData>'.encode())
        self.add([("s", h) for h in header])

    def add(self, cells: list[tuple[str, str | None]]) -> None:
        self.rows += 1
        if self.rows > 1 << 20:
            raise ValueError("more rows than a sheet holds")
        self.part.write(f'<row r="{self.rows}">{"".join(shown_as(*c) for c in cells)}</row>'.encode())

    def close(self) -> bytes:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()
        self.zip.close()
        return self.out.getvalue()


def shown_as(kind: str, text: str | None) -> str:
    if text is None:
        return "<c/>"
    if kind == "s":
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
    return f'<c{" s=" + chr(34) + "1" + chr(34) if kind == "d" else ""}><v>{text}</v></c>'


def bytes_of(header: list[str], rows: list[list[tuple[str, str | None]]], sheet: str = "data") -> bytes:
    """A one-sheet workbook of rows held in memory."""
    book = Sheet(header, sheet)
    for r in rows:
        book.add(r)
    return book.close()
