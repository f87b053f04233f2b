"""Files: page trees, outputs replaced as a whole, faults that stay with their row."""

import io
import os

import pytest
from pyspark.sql import functions as F

from pagetally import catalog
from pagetally.sources import files, pdf
from pagetally.sources.replacing import Replacing


def pages_of(data):
    return pdf.count_pages(io.BytesIO(data), len(data))


@pytest.mark.parametrize("pages", [1, 2, 3, 4, 5, 8, 17, 200, 1001])
def test_page_trees(pages):
    assert pages_of(pdf.plain_pdf(pages)) == pages == pages_of(pdf.plain_pdf(pages, fan=2))


def updated(data, pages):
    """A later revision of a file: its page tree's root again, with another number, in a table of its own."""
    start = data.rindex(b"startxref")
    before, at = int(data[start:].split()[1]), len(data)
    body = f"2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count {pages} >>\nendobj\n".encode()
    table = f"xref\n2 1\n{at:010d} 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev {before} >>\nstartxref\n{at + len(body)}\n%%EOF\n".encode()
    return data + body + table


def test_the_last_revision_counts():
    assert pages_of(updated(pdf.plain_pdf(4), 3)) == 3
    assert pages_of(updated(updated(pdf.plain_pdf(4), 3), 7)) == 7


def test_compressed_cross_references_are_counted_by_objects():
    data = pdf.plain_pdf(3)
    at = data.rindex(b"xref\n0 ")
    body = data[:at] + b"90 0 obj\n<< /Type /XRef /Size 9 >>\nstream\nx\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
    assert pages_of(body) == 3


@pytest.mark.parametrize("data", [b"", b"no", b"%PDF-1.4\nbroken", b"%PDF-1.4\nstartxref\n99999\n%%EOF", b"%PDF-1.4\nstartxref\n0\n%%EOF", pdf.plain_pdf(3)[:-150], pdf.plain_pdf(3).replace(b"1 0 obj", b"7 0 obj", 1), pdf.plain_pdf(3).replace(b"/Root 1", b"/Roof 1"), pdf.plain_pdf(2).replace(b"endobj", b"endxxx")])
def test_damaged_files_raise(data):
    with pytest.raises((ValueError, OSError)):
        pages_of(data)


def test_a_loop_in_the_tree_ends():
    data = pdf.plain_pdf(2).replace(b"/Kids [4 0 R 5 0 R]", b"/Kids [2 0 R 5 0 R]")
    assert pages_of(data) == 1


def test_files_read_as_a_source(spark, tmp_path):
    folder = f"file:{tmp_path}/in"
    rows = spark.createDataFrame([(f"a/b{i % 3}/{i}.pdf", i % 7) for i in range(40)] + [("c.PDF", 2), ("d.txt", 5)], "path string, pages int").repartition(3)
    assert pdf.write_pdfs(rows, folder).count() == 42
    spark.dataSource.register(pdf.PdfPages)
    read = spark.read.format("pdf_pages").option("perPartition", 7).load(folder)
    assert read.rdd.getNumPartitions() == 6
    got = {os.path.relpath(r.path, f"{tmp_path}/in"): (r.pages, r.error) for r in read.collect()}
    assert {k: v[0] for k, v in got.items()} == {f"a/b{i % 3}/{i}.pdf": i % 7 or None for i in range(40)} | {"c.PDF": 2}
    assert all((v[0] is None) == (v[1] is not None) for v in got.values()) and got["a/b0/0.pdf"][1].startswith("Unreadable")
    os.makedirs(f"{tmp_path}/empty")
    assert spark.read.format("pdf_pages").load(f"file:{tmp_path}/empty").collect() == []


def test_trees_are_listed_by_tasks(spark, tmp_path):
    """All depths, empty folders and none; every folder is listed in a task."""
    folder = f"file:{tmp_path}/in"
    rows = [(f"a/b{i % 3}/{i}.pdf", i % 7) for i in range(40)] + [("c.PDF", 2), ("d.txt", 5), ("e/f/g/h/i é %20.pdf", 3), ("_x/.y.pdf", 1)]
    pdf.write_pdfs(spark.createDataFrame(rows, "path string, pages int").repartition(3), folder).count()
    os.makedirs(f"{tmp_path}/in/empty/also")
    listed = files.listed_by_tasks(spark, folder)
    got = {os.path.relpath(r.path, f"{tmp_path}/in"): r.length for r in listed.collect()}
    assert got == {path: os.path.getsize(f"{tmp_path}/in/{path}") for path, _ in rows} and listed.count() == len(rows)
    pages = {os.path.relpath(r.path, f"{tmp_path}/in"): (r.pages, r.error is None) for r in pdf.pages_of(listed, folder).collect()}
    assert pages == {path: (n or None, n > 0) for path, n in rows}
    assert files.listed_by_tasks(spark, f"file:{tmp_path}/in/empty").collect() == []


@pytest.mark.parametrize("name", ["s01_list_files", "s06_page_counts"])
def test_the_driver_holds_no_listing(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("a listing of all files on the driver")

    monkeypatch.setattr(files, "list_files", refused)
    monkeypatch.setattr(pdf.PdfPages, "reader", refused)
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "pdf_pages" not in plan


def test_outputs_are_replaced_as_a_whole(spark, tmp_path):
    spark.dataSource.register(Replacing)
    out = f"{tmp_path}/out"
    put = lambda df: df.write.format("replacing").mode("overwrite").save(out)
    ids = lambda path=out: sorted(r.id for r in spark.read.parquet(path).collect())
    put(spark.range(10, numPartitions=3))
    assert ids() == list(range(10)) and sorted(os.listdir(tmp_path)) == ["out"]
    put(spark.range(5, numPartitions=2))
    assert ids() == list(range(5)) and ids(f"{out}.bak") == list(range(10))
    failing = spark.range(8, numPartitions=4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        put(failing)
    assert ids() == list(range(5)) and ids(f"{out}.bak") == list(range(10)) and sorted(os.listdir(tmp_path)) == ["out", "out.bak"]
    put(spark.range(0))
    assert ids(f"{out}.bak") == list(range(5)) and ids() == []


def test_unknown_ranges_are_named(spark, tmp_path):
    values = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3)], "range_name string, value bigint")
    ranges = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "range_name string")
    unknown = files.write_range_values(values, ranges, f"{tmp_path}/r")
    assert [r[0] for r in unknown.collect()] == ["x"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/r").collect())) == [("a", 1), ("b", 2)]


def test_faults_stay_with_their_row(spark):
    contents = [b"Pagina 2 de 4", b"\xff\xfe2 de 4", None, b"", b"3 de 2", "página 10de10 é".encode(), b"0 de 3", b"x" * 100_000 + b" 1 de 1"]
    df = spark.createDataFrame([(1, i, bytearray(c) if c is not None else None, "x") for i, c in enumerate(contents)], "pdf bigint, page int, content binary, error string")
    got = [tuple(r)[2:] for r in sorted(files.page_numbers(df).collect(), key=lambda r: r.page)]
    failed = lambda e: (None, None, "failed", e)
    assert got == [(2, 4, "direct", None), failed("bad bytes"), failed("no content"), failed("no number"), failed("3 of 2"), (10, 10, "direct", None), failed("0 of 3"), (1, 1, "direct", None)]
