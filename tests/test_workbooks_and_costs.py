"""Workbooks read back, and peaks of a run's own jobs."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import battery
from sparkloom.sources import tables, workbooks

ROWS = [(1, "a <b> & c", 1.5, True, None), (2, None, -2.0, False, "x"), (3, "  déjà\nvu ", None, None, None), (10**15, "", 3e300, True, "é")]
SCHEMA = "ID long, name string, LIMIT double, ok boolean, rest string"


def test_columns():
    assert [workbooks.column_number(c) for c in ("A1", "Z9", "AA3", "XFD1")] == [0, 25, 26, 16383]
    assert all(workbooks.column_number(f"{workbooks.column_name(i)}1") == i for i in range(2000))


def test_workbooks_read_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    books = workbooks.as_workbooks(df, "ID", rows=2, above=["title"])
    got = workbooks.as_table(books, header=1)
    assert dict(got.dtypes) == dict(df.dtypes)
    assert sorted(map(tuple, got.collect())) == sorted(ROWS)
    for r in books.collect():
        (tmp_path / r["path"]).write_bytes(r["content"])
    out = tables.spreadsheet(spark, str(tmp_path), "ok", "target")
    assert out.columns == ["name", "LIMIT", "target", "rest"] and out.count() == 4


def test_shared_strings_gaps_and_errors(spark):
    content = workbooks.workbook(["a", "b"], iter([(1, 2)]))
    out = BytesIO()
    with zipfile.ZipFile(BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            data = old.read(n)
            if n.endswith("sheet1.xml"):
                body = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="C3" t="e"><v>#N/A</v></c></row><row r="4"><c r="A4"><v>7</v></c><c r="C4" t="str"><v>y</v></c></row>'
                data = data[: data.index(b"<sheetData>") + 11] + body.encode() + b"</sheetData></worksheet>"
            new.writestr(n, data)
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN[1:-1]}"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r></si></sst>')
    files = spark.createDataFrame([("f", bytearray(out.getvalue()))], "path string, content binary")
    assert sorted(map(tuple, workbooks.as_table(files).collect()), key=repr) == [(7, "y"), (None, None)]
    with pytest.raises(ValueError):
        workbooks.as_table(files, header=1)
    with pytest.raises(Exception, match="no sheet"):
        workbooks.cells(files, "other").collect()


def test_peaks_are_those_of_the_group(spark):
    with battery.job_group(spark, "some-jobs"):
        spark.range(200_000).repartition(5).groupBy((F.col("id") % 1000).alias("k")).count().orderBy("k").collect()
    spark.range(10).count()
    got = battery.job_peaks(spark, "some-jobs")
    assert got["tasks"] >= 6 and got["execution_mb"] > 0 and (got["heap_mb"] is None or got["heap_mb"] > 0)
    assert battery.job_peaks(spark, "no-jobs")["tasks"] == 0
