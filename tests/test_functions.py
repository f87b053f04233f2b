"""Text functions against fixed cases and brute force; sources and sinks by round trips."""

import json
import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagetally.functions import text as fn
from pagetally.sources import files

DIR = "/root/testdata/sf0.001"


SMALL = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte".split()
TENS = {30: "treinta", 40: "cuarenta", 50: "cincuenta", 60: "sesenta", 70: "setenta", 80: "ochenta", 90: "noventa"}
HUNDREDS = {1: "ciento", 5: "quinientos", 7: "setecientos", 9: "novecientos"}


def spelled(n):
    """A number below a thousand, as it is said."""
    if n <= 20:
        return SMALL[n]
    if n < 30:
        return {22: "veintidós", 23: "veintitrés", 26: "veintiséis"}.get(n, "veinti" + SMALL[n - 20])
    if n < 100:
        return TENS[n - n % 10] + (f" y {SMALL[n % 10]}" if n % 10 else "")
    if n == 100:
        return "cien"
    return HUNDREDS.get(n // 100, SMALL[n // 100] + "cientos") + (f" {spelled(n % 100)}" if n % 100 else "")


def test_number_words(spark):
    cases = [(spelled(n), n) for n in range(1000)] + [(spelled(n).upper(), n) for n in range(0, 1000, 37)] + [(f"  {spelled(n)}\t", n) for n in range(0, 1000, 41)]
    cases += [(str(n), n) for n in (0, 7, 640, 999)] + [("1001", None), ("quizás", None), (" ", None), (None, None), ("ochocientos trescientos", None), ("seis hojas", 6), ("folio 12 o 13", 12)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    got = {r.id: r.value for r in fn.number_words(rows, "id", "text").collect()}
    assert {i: got[i] for i in got if got[i] != cases[i][1]} == {} and len(got) == len(cases)


def test_reply_and_strict_page(spark):
    replies = [("Página 3 de 10", (3, 10)), ("PÁG 12 de 15", (12, 15)), ("page 3 of 10", (3, 10)), ("3 out of 10", (3, 10)), ("a 3 de 10", (3, 10)), ("3/10", (3, 10)), ("1234/10", None), ("9 de 4, 1/2", (1, 2)), ("4 and 9", (4, 9)), ("9 and 4", None), ("1 2 3", None), ("", None), (None, None)]
    strict = [("Pagina 1 de 4", (1, 4)), ("Pág l de Z", (1, 2)), ("P 5 de 4", None), ("P 1 de 11", None), ("P. O de 4", None), ("nothing", None), ("Pagina 2 da 3", (2, 3)), (None, None)]
    for cases, f in ((replies, fn.reply_pages), (strict, fn.strict_page)):
        rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string").select("id", f(F.col("text")).alias("at")).collect()
        assert {r.id: r.at and tuple(r.at) for r in rows} == {i: v for i, (_, v) in enumerate(cases)}


def test_arithmetic_cases(spark):
    cases = [("12 + 3", 15), ("2*-3", -6), ("--2", 2), ("-(1+2)*3", -9), ("1/(1/0)", 0), ("2-3-4", -5), ("8/4/2", 1), (".5+5.", 5.5), ("2 3", None), ("", None), ("1/0", None), ("1.2.3", None), ("(1", None), ("1)", None), ("2(3)", None), ("+3", None), ("()", None), ("1+", None), ("a", None), (None, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string").select("id", fn.arithmetic("text").alias("v")).collect()
    assert {r.id: r.v for r in rows} == {i: v for i, (_, v) in enumerate(cases)}


numbers = st.integers(0, 99).map(str)
sums = st.recursive(numbers, lambda x: st.tuples(x, st.sampled_from("+-*/"), x).map("".join) | x.map(lambda e: f"({e})") | x.map(lambda e: f"-{e}"), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(sums)
def test_arithmetic_equals_python(text):
    try:
        want = float(eval(text))  # noqa: S307 - texts of digits, signs and brackets
    except ZeroDivisionError:
        return
    got = fn.evaluate(text)
    assert got is not None and math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-9)


def test_deep_brackets_are_bounded_by_the_text():
    assert fn.evaluate("(" * 20000 + "1" + ")" * 20000) == 1.0


def test_parsers_find_something(spark):
    from pagetally import catalog

    for name in ("f03_strict_parse", "f10_reader_reply"):
        rows = catalog.queries()[name](spark, DIR).agg(F.count("curr"), F.count("*")).first()
        assert 0 < rows[0] < rows[1]
    assert catalog.queries()["f15_arithmetic"](spark, DIR).filter("value is not null").count() > 0


def test_listing_and_cache(spark, tmp_path):
    for name in ("b.pdf", "sub/a.pdf", "sub/c.txt"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(name)
    rows = files.list_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows.collect()) == ["a.pdf", "b.pdf"]
    cache = rows.filter("path like '%a.pdf'").withColumn("pages", F.lit(3))
    assert [r.path[-5:] for r in files.stale_files(rows, cache).collect()] == ["b.pdf"]
    assert {(r.path[-5:], r.pages) for r in files.page_counts(rows, cache).collect()} == {("a.pdf", 3), ("b.pdf", None)}


def test_json_and_csv(spark, tmp_path):
    read = {"pdf_page": 1, "curr": 1, "total": 2, "method": "direct", "confidence": 1.0}
    for name in ("real/x.json", "archived/y.json"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"name": name, "source": "real", "reads": [read, read | {"pdf_page": 2, "curr": None, "total": None}]}, indent=1))
    rows = files.fixture_reads(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.pdf_page, r.curr) for r in rows) == [("real/x.json", 1, 1), ("real/x.json", 2, None)]
    (tmp_path / "t.json").write_text(json.dumps({"a": {"doc_count": 2, "complete_count": 1, "inferred_count": 0}}, indent=1))
    assert [tuple(r) for r in files.truth(spark, str(tmp_path / "t.json")).collect()] == [("a", 2, 1, 0)]
    index = spark.createDataFrame([("p", 1, "1/2", None), ("p", 2, None, "2/2"), ("p", 3, None, None)], "pdf_nickname string, page_num int, tier1_parsed string, tier2_parsed string")
    files.write_capture(index.selectExpr("*", "'' as tier1_text", "'' as tier2_text", "'' as tier3_text", "'i' as image_path"), str(tmp_path / "csv"))
    found, failed = files.capture_index(spark, str(tmp_path / "csv"))
    assert sorted((r.page_num, r.parsed) for r in found.collect()) == [(1, "1/2"), (2, "2/2")] and [r.page_num for r in failed.collect()] == [3]


def test_sinks(spark, tmp_path):
    ranges = spark.createDataFrame([("A_odi_count",)], "range_name string")
    unknown = files.write_range_values(spark.createDataFrame([("A_odi_count", 3), ("B_x_count", 4)], "range_name string, value int"), ranges, str(tmp_path / "out"))
    assert [r.range_name for r in unknown.collect()] == ["B_x_count"]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A_odi_count", 3)]
    ops = spark.createDataFrame([("op_1", "pending"), ("op_2", "applied")], "id string, status string")
    files.write_manifest(ops, str(tmp_path / "sweep_1.json"))
    assert [r.id for r in spark.read.json(str(tmp_path / "sweep_1.json")).collect()] == ["op_1"]
    with pytest.raises(ValueError):
        files.write_manifest(ops.filter("status = 'applied'"), str(tmp_path / "none"))
    (tmp_path / "r").mkdir()
    for n in (1, 2):
        (tmp_path / "r" / f"sweep_{n}.json").write_text("{}")
    assert files.latest_result(spark, str(tmp_path / "r")).endswith("sweep_2.json")
