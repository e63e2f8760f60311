"""Workbooks: round trips, and cells as other programs write them."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from cityloom.sources import workbooks as B


def rewritten(content: bytes, parts: dict[str, str]) -> bytes:
    """A workbook with some of its parts replaced or added."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            if name not in parts:
                new.writestr(name, old.read(name))
        for name, text in parts.items():
            new.writestr(name, text)
    return out.getvalue()


def sheet(rows: str) -> str:
    return f'<worksheet xmlns="{B.MAIN[1:-1]}"><sheetData>{rows}</sheetData></worksheet>'


def decoded(spark, files):
    df = spark.createDataFrame(files, "path string, content binary")
    return [(r["path"], r["row"], r["cells"]) for r in B.decode(df).orderBy("path", "sheet", "row").collect()]


def test_round_trip_through_files(spark, tmp_path):
    day = datetime.datetime(2018, 3, 4, 5, 6, 7)
    rows = [(1, 1, "Peñol & <b>  x", 1.5, day), (1, 2, None, -3.0, None), (2, 3, "", None, datetime.datetime(2019, 1, 1))]
    df = spark.createDataFrame(rows, "k int, id long, name string, v double, at timestamp")
    for r in B.encode(df, ["k"], ["id"], ["id", "name", "v", "at"]).collect():
        (tmp_path / f"book{r['k']}.xlsx").write_bytes(bytes(r["content"]))
    got = B.read_workbooks(spark, str(tmp_path), ["id", "name", "v", "at"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "Peñol & <b>  x", "1.5", "2018-03-04 05:06:07"), ("2", None, "-3", None), ("3", "", None, "2019-01-01")]


def test_cells_of_other_writers(spark):
    plain = B.bytes_of(["a"], [])
    shared = f'<sst xmlns="{B.MAIN[1:-1]}"><si><t>one</t></si><si><r><t>two </t></r><r><t>three</t></r><rPh><t>hint</t></rPh></si></sst>'
    cells = ('<row r="2"><c r="B2" t="s"><v>1</v></c><c r="AA2" t="s"><v>0</v></c></row><row r="5"><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c>'
             '<c t="str"><v>made</v></c><c s="1"><v>43101</v></c><c><v>1.0E2</v></c><c s="1"/></row><row r="9"/>')
    book = rewritten(plain, {"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet(cells)})
    assert decoded(spark, [("x", book)]) == [("x", 2, [None, "two three", *[None] * 24, "one"]), ("x", 5, ["TRUE", None, "made", "2018-01-01", "100", None])]


def test_empty_files_and_bytes_that_are_none(spark):
    assert decoded(spark, [("e", b""), ("n", None), ("h", B.bytes_of(["a"], []))]) == [("h", 1, ["a"])]
    with pytest.raises(Exception, match="bad.xlsx is no workbook"):
        decoded(spark, [("bad.xlsx", b"no zip")])


@pytest.mark.parametrize("code,date", [("yyyy-mm-dd", True), ("[h]:mm", True), ("0.00", False), ('0 "days"', False), ("[Red]0", False), ("General", False), ("#,##0", False)])
def test_styles_that_show_dates(code, date):
    assert B.shows_date(code) is date


def test_serial_days():
    assert [B.moment(d, False) for d in (1, 59, 61, 43101.5)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2018-01-01 12:00:00"]
    assert B.moment(0.0, True) == "1904-01-01"


def test_long_sheet_leaves_in_batches(spark):
    rows = [[("n", str(i)), ("s", "x")] for i in range(3 * B.BATCH + 7)]
    df = spark.createDataFrame([("long", B.bytes_of(["i", "t"], rows))], "path string, content binary")
    got = B.table(B.decode(df), ["i", "t"]).agg(F.count("*"), F.sum(F.col("i").cast("long")), F.max(F.length("t"))).first()
    assert tuple(got) == (len(rows), sum(range(len(rows))), 1)


def test_rows_of_a_key_pass_as_a_stream(spark):
    """No list of a key's rows is gathered; keys may be null or lie in several batches."""
    df = spark.range(0, 30_000).select(F.when(F.col("id") < 25_000, F.col("id") % 2).alias("k"), "id", F.lit("x").alias("t"))
    books = B.encode(df, ["k"], ["id"], ["id", "t"])
    assert "collect_list" not in books._jdf.queryExecution().toString()
    got = {r["k"]: r["content"] for r in books.collect()}
    assert got.keys() == {None, 0, 1}
    for k, want in {None: range(25_000, 30_000), 0: range(0, 25_000, 2), 1: range(1, 25_000, 2)}.items():
        assert [c[0] for _, c in B.Workbook(bytes(got[k])).rows("xl/worksheets/sheet1.xml")] == ["id", *map(str, want)]
