"""Workbooks (.xlsx): sheets scanned by Spark, a workbook a task, and tables written as workbooks.

Files reach the tasks as binary rows, from any store that Spark reads. A sheet has at most 1,048,576 rows by its
format; its XML is parsed as a stream, a batch of rows at a time. Cells come as texts with their kinds, so that names
and types are found over all workbooks of a folder at once.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS_OF_A_SHEET = 1_048_576
#: Rows that a task hands on at a time.
BATCH = 5000

CELLS = "path string, row int, value array<string>, kind array<string>"


def column_number(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(number: int) -> str:
    out, number = "", number + 1
    while number:
        number, digit = divmod(number - 1, 26)
        out = chr(65 + digit) + out
    return out


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in e.iter(f"{MAIN}t")) for _, e in ElementTree.iterparse(f) if e.tag == f"{MAIN}si"]


def _sheet(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The part that holds a sheet, given by name or place."""
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    found = [e for i, e in enumerate(sheets) if sheet in (i, e.get("name"))]
    if not found:
        raise ValueError(f"no sheet {sheet!r} among {[e.get('name') for e in sheets]}")
    for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if e.get("Id") == found[0].get(LINK):
            target = e.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"sheet {sheet!r} has no part")


def parse(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None], list[str | None]]]:
    """(row number from 1, values, kinds) of each row that has cells; kinds are n(umber), s(tring), b(oolean), e(rror)."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        with book.open(_sheet(book, sheet)) as f:
            number = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{MAIN}row":
                    continue
                number = int(e.get("r") or number + 1)
                values: list[str | None] = []
                kinds: list[str | None] = []
                for c in e.findall(f"{MAIN}c"):
                    at = column_number(c.get("r")) if c.get("r") else len(values)
                    values += [None] * (at + 1 - len(values))
                    kinds += [None] * (at + 1 - len(kinds))
                    kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        values[at], kinds[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t")), "s"
                    elif v is not None and v.text is not None:
                        values[at], kinds[at] = (shared[int(v.text)], "s") if kind == "s" else (v.text, "s" if kind in ("str", "d") else kind)
                e.clear()
                yield number, values, kinds


def cells(files: DataFrame, sheet: str | int = 0) -> DataFrame:
    """path, row, value, kind of every row with cells of the workbooks ``files`` (path, content)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for row in parse(bytes(content), sheet):
                    rows.append((path, *row))
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=["path", "row", "value", "kind"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "row", "value", "kind"])

    return files.select("path", "content").mapInPandas(run, CELLS)


def as_table(files: DataFrame, header: int = 0, sheet: str | int = 0) -> DataFrame:
    """The rows below the header row (counted from 0) of all workbooks, whose headers must agree.

    A column is a bigint or double if all its cells are numbers, boolean if all are booleans, else a string; errors
    and empty cells are null. Columns without a name, and rows without a cell, are left out."""
    found = cells(files, sheet)
    heads = found.filter(F.col("row") == header + 1).select("value").distinct().limit(2).collect()  # at most two rows
    if len(heads) != 1:
        raise ValueError("workbooks without a header row, or with different ones" if heads else "no header row")
    names = [(i, v) for i, v in enumerate(heads[0]["value"]) if v]
    if len({n for _, n in names}) < len(names):
        raise ValueError(f"names repeat among {[n for _, n in names]}")
    body = found.filter(F.col("row") > header + 1)
    aggs = []
    for i, _ in names:
        kind, value = F.get("kind", F.lit(i)), F.get("value", F.lit(i))
        known = kind.isNotNull() & (kind != "e")
        aggs += [F.bool_and(F.when(known, kind == k)).alias(f"{k}{i}") for k in "nb"]
        aggs.append(F.bool_and(F.when(known, value.rlike(r"^-?\d{1,18}$"))).alias(f"i{i}"))
    kinds = body.agg(*aggs).first()
    columns = []
    for i, name in names:
        value = F.when(F.get("kind", F.lit(i)) != "e", F.get("value", F.lit(i)))
        if kinds[f"n{i}"]:
            value = value.cast("bigint" if kinds[f"i{i}"] else "double")
        elif kinds[f"b{i}"]:
            value = value == "1"
        columns.append(value.alias(name))
    return body.select(*columns)


def scan(spark: SparkSession, path: str, header: int = 0, sheet: str | int = 0) -> DataFrame:
    """The workbooks at a path or below a folder, read by Spark from any store."""
    return as_table(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path), header, sheet)


def workbook(names: Sequence[str], rows: Iterator[Sequence], title: str = "Sheet1", above: Sequence[str] = ()) -> bytes:
    """An .xlsx file of one sheet: the texts ``above``, a row each, then names and rows."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

    def cell(value, at: str) -> str:
        if value is None or value != value:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{relation}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{relation}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
            n = 0
            for n, row in enumerate([*([t] for t in above), list(names)], 1):
                f.write(f'<row r="{n}">{"".join(cell(v, f"{column_name(i)}{n}") for i, v in enumerate(row))}</row>'.encode())
            for n, row in enumerate(rows, n + 1):
                if n > ROWS_OF_A_SHEET:
                    raise ValueError(f"a sheet has at most {ROWS_OF_A_SHEET} rows")
                f.write(f'<row r="{n}">{"".join(cell(v, f"{column_name(i)}{n}") for i, v in enumerate(row))}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def as_workbooks(df: DataFrame, key: str, rows: int = 100_000, above: Sequence[str] = ()) -> DataFrame:
    """(path, content): the table dealt by a hash of ``key`` into workbooks of about ``rows`` rows each. Columns are
    numbers, booleans or texts; others are written as texts."""
    plain = {"bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "string"}
    texts = df.select(*[F.col(c) if kind in plain else F.col(c).cast("string").alias(c) for c, kind in df.dtypes])
    names = texts.columns
    parts = max(1, -(-df.count() // rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, body = int(pdf["_part"].iloc[0]), pdf[names].astype(object).where(pdf[names].notna(), None)
        return pd.DataFrame({"path": [f"part-{part:05}.xlsx"], "content": [workbook(names, body.itertuples(index=False), above=above)]})

    dealt = texts.withColumn("_part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)))
    return dealt.groupBy("_part").applyInPandas(run, "path string, content binary")  # about ``rows`` rows each
