"""Scalar parsers over texts derived from the tables; each has a text for DuckDB of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.anchors import folded
from ..plans.relations import values

_STRICT = "SELECT pdf, page, CASE WHEN partkey % 13 = 1 THEN replace(replace(text, ' 1 ', ' l '), '2', 'Z') ELSE text END AS text FROM (SELECT t.pdf, t.page, t.text, r.partkey FROM {page_text} AS t JOIN {page_reads} AS r ON t.pdf = r.pdf AND t.page = r.page) AS p"
_REPLY = """
    SELECT pdf, page, CASE partkey % 8 WHEN 0 THEN 'Pág. ' || c || ' de ' || t WHEN 1 THEN 'it says page ' || c || ' of ' || t WHEN 2 THEN c || ' out of ' || t || '.'
      WHEN 3 THEN 'folio ' || c || ' de ' || t || ' visible' WHEN 4 THEN 'read: ' || c || '/' || t WHEN 5 THEN 'numbers ' || c || ' and ' || t WHEN 6 THEN 'Pagina 9 de 4, or ' || c || '/' || t ELSE c || ' 7 ' || t END AS text
    FROM (SELECT pdf, page, partkey, CAST(curr AS STRING) AS c, CAST(total AS STRING) AS t FROM {page_reads} WHERE curr IS NOT NULL) AS p"""
_SPOKEN = """
    SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN CAST(p_partkey AS STRING) || ' hojas' WHEN 1 THEN 'Cuarenta  y ' || unit WHEN 2 THEN ' ciento ' || unit WHEN 3 THEN 'NOVECIENTOS noventa y ' || unit
      WHEN 4 THEN 'hola' WHEN 5 THEN 'veintitrés-' || unit ELSE 'novecientos quinientos' END AS text
    FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'uno' WHEN 1 THEN 'dos' WHEN 2 THEN 'siete' WHEN 3 THEN 'nueve' ELSE 'cero' END AS unit FROM {part}) AS p"""
_SUMS = "SELECT id, name, CAST(pages AS STRING) || CASE id % 6 WHEN 0 THEN ' + ' WHEN 1 THEN '*-' WHEN 2 THEN '/(' WHEN 3 THEN ' ' WHEN 4 THEN '-(2.5*' ELSE '/' END || CAST(id % 5 AS STRING) || CASE WHEN id % 6 IN (2, 4) THEN ')' ELSE '' END AS text FROM {files}"


def f03_strict_parse(s) -> DataFrame:
    return s.sql(_STRICT).withColumn("at", fn.strict_page(F.col("text"))).select("pdf", "page", "at.curr", "at.total")


def f10_reader_reply(s) -> DataFrame:
    return s.sql(_REPLY).withColumn("at", fn.reply_pages(F.col("text"))).select("pdf", "page", "at.curr", "at.total")


def f14_number_words(s) -> DataFrame:
    return fn.number_words(s.sql(_SPOKEN), "id", "text")


def f05_normalise_text(s) -> DataFrame:
    """Texts in small letters without accents (all that Unicode decomposes), separators and white space as single blanks."""
    rows = fn.normalised(s["documents"].filter("text is not null").select("doc_id", "text"))
    return rows.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def f15_arithmetic(s) -> DataFrame:
    return s.sql(_SUMS).select("id", "text", fn.arithmetic("text").alias("value"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def _plausible(pairs: list[tuple[str, str]]) -> list[str]:
    """Page and total as the first plausible pair's, in SQL."""
    return ["CASE " + " ".join(f"WHEN try_cast({a} AS INT) >= 1 AND try_cast({a} AS INT) <= try_cast({b} AS INT) THEN try_cast({(a, b)[k]} AS INT)" for a, b in pairs) + " END" for k in (0, 1)]


def _strict_sql() -> str:
    a, b = (f"try_cast(translate(regexp_extract(text, {_quoted(fn.PAGE_PATTERN)}, {g}), {_quoted(fn.CONFUSED)}, '{fn.DIGITS}') AS INT)" for g in (1, 2))
    return f"SELECT pdf, page, CASE WHEN a > 0 AND a <= b AND b <= {fn.MOST_PAGES} THEN a END AS curr, CASE WHEN a > 0 AND a <= b AND b <= {fn.MOST_PAGES} THEN b END AS total FROM (SELECT pdf, page, {a} AS a, {b} AS b FROM (SELECT pdf, page, regexp_replace(text, '(^|[^0-9])Z($|[^0-9])', '\\12\\2', 'g') AS text FROM ({_STRICT}) AS x) AS y) AS z"


def _reply_sql() -> str:
    pairs = [tuple(f"regexp_extract(text, {_quoted(p)}, {k})" for k in (g, g + 1)) for p, g in fn.REPLY_PATTERNS]
    pairs += [tuple(f"CASE WHEN len(alone) = 2 THEN alone[{k}] END" for k in (1, 2))]
    curr, total = _plausible(pairs)
    return f"SELECT pdf, page, {curr} AS curr, {total} AS total FROM (SELECT *, regexp_extract_all(text, '\\b([0-9]{{{{1,3}}}})\\b', 1) AS alone FROM ({_REPLY}) AS x) AS y"


SQL: dict[str, str] = {
    "f05_normalise_text": f"SELECT doc_id, md5(text) AS text_md5, length(text) AS n FROM (SELECT doc_id, {folded('', 'strip_accents(text)')} AS text FROM {{documents}} WHERE text IS NOT NULL) AS d",
    "f03_strict_parse": _strict_sql(),
    "f10_reader_reply": _reply_sql(),
    "f14_number_words": f"SELECT id, CASE WHEN v <= 999 THEN CAST(v AS INT) END AS value FROM (SELECT id, CASE WHEN digits <> '' THEN try_cast(digits AS BIGINT) ELSE n END AS v FROM (SELECT id, digits, sum(w.n) AS n FROM (SELECT id, regexp_extract(norm, '[0-9]+', 0) AS digits, unnest(regexp_split_to_array(norm, '[ -]+')) AS token FROM (SELECT id, trim(strip_accents(lower(text))) AS norm FROM ({_SPOKEN}) AS x) AS y) AS z LEFT JOIN ({values(list(fn.NUMBER_WORDS.items()), 'token, n')}) AS w ON w.token = z.token GROUP BY id, digits) AS q) AS r",
}
OPERATORS: dict[str, Callable] = {f.__name__: f for f in (f03_strict_parse, f05_normalise_text, f10_reader_reply, f14_number_words, f15_arithmetic)}
