"""Text functions: strict page numbers, readers' replies, number words and arithmetic."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters read for digits, and the digits; page numbers above the most are misreads.
CONFUSED, DIGITS = "OoIilLzZ|tT'‘’`´", "0011112201111111"
MOST_PAGES = 10
_DIGIT = "[0-9OoIilL|zZtT'‘’`´]{1,3}"
PAGE_PATTERN = rf"(?i)P.{{0,6}}[ \t\r\n]*({_DIGIT})[ \t\r\n]*\.?[ \t\r\n]*d[ea][ \t\r\n]*({_DIGIT})"
#: How a reader's reply names a page, the most specific first; groups 1 and 2 of those with no
#: prefix are guarded by what is no digit.
REPLY_PATTERNS = (
    (r"(?i)P[aáÁ]g(?:ina)?\.?[ \t\r\n]*([0-9]{1,3})[ \t\r\n]*de[ \t\r\n]*([0-9]{1,3})", 1),
    (r"(?i)Page[ \t\r\n]+([0-9]{1,3})[ \t\r\n]+of[ \t\r\n]+([0-9]{1,3})", 1),
    (r"(?i)([0-9]{1,3})[ \t\r\n]+out[ \t\r\n]+of[ \t\r\n]+([0-9]{1,3})", 1),
    (r"(^|[^0-9])([0-9]{1,3})[ \t\r\n]+de[ \t\r\n]+([0-9]{1,3})($|[^0-9])", 2),
    (r"(^|[^0-9])([0-9]{1,3})/([0-9]{1,3})($|[^0-9])", 2),
)
#: Spanish number words, without accents; a number up to 999 is the sum of its words.
NUMBER_WORDS = {
    "cero": 0, "uno": 1, "un": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
    "diez": 10, "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19,
    "veinte": 20, "veintiuno": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28, "veintinueve": 29,
    "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90,
    "cien": 100, "ciento": 100, "doscientos": 200, "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700, "ochocientos": 800, "novecientos": 900,
}


def _number(text: Column) -> Column:
    return text.try_cast("int")


def strict_page(text: Column) -> Column:
    """Page and total, both null unless 0 < page <= total <= 10; a Z away from digits is a 2."""
    text = F.regexp_replace(text, "(?<![0-9])Z(?![0-9])", "2")
    at = [_number(F.translate(F.regexp_extract(text, PAGE_PATTERN, g), CONFUSED, DIGITS)) for g in (1, 2)]
    return F.when((at[0] > 0) & (at[0] <= at[1]) & (at[1] <= MOST_PAGES), F.struct(at[0].alias("curr"), at[1].alias("total")))


def reply_pages(text: Column) -> Column:
    """Page and total of a reply: the first pattern whose numbers are plausible, else its only two integers."""
    pair = lambda a, b: F.when((a >= 1) & (a <= b), F.struct(a.alias("curr"), b.alias("total")))
    found = [pair(_number(F.regexp_extract(text, p, g)), _number(F.regexp_extract(text, p, g + 1))) for p, g in REPLY_PATTERNS]
    alone = F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,3})\b"), F.lit(1))
    return F.coalesce(*found, F.when(F.size(alone) == 2, pair(_number(F.get(alone, F.lit(0))), _number(F.get(alone, F.lit(1))))))


def number_words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """`value` per key: the first digits if any (null above 999), else the sum of the number words; null without any."""
    plain = F.trim(F.translate(F.lower(text), "áéíóúüñ", "aeiouun"))
    words = rows.sparkSession.createDataFrame(list(NUMBER_WORDS.items()), "token string, n int")
    tokens = rows.select(key, F.regexp_extract(plain, "[0-9]+", 0).alias("digits"), F.explode_outer(F.split(plain, "[ \t\r\n-]+")).alias("token"))
    total = tokens.join(F.broadcast(words), "token", "left").groupBy(key, "digits").agg(F.sum("n").alias("n"))
    value = F.when(F.col("digits") != "", F.col("digits").try_cast("bigint")).otherwise(F.col("n"))
    return total.select(key, F.when(value <= 999, value).cast("int").alias("value"))


_RANK = {"(": 0, "+": 1, "-": 1, "*": 2, "/": 2, "neg": 3}
_BINARY = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide}


def evaluate(text: str | None) -> float | None:
    """The value of + - * / and brackets over decimals; null for anything else, or if it isn't finite.

    Two stacks, so depth is bounded by the text alone. Digits parted by blanks are no number.
    """
    if text is None or re.search(r"[0-9]\s+[0-9]", text):
        return None
    values, waiting, wants_value = [], [], True

    def settle(least: int) -> None:
        while waiting and _RANK[waiting[-1]] >= least:
            op = waiting.pop()
            right = values.pop()
            values.append(-right if op == "neg" else _BINARY[op](values.pop(), right))

    with np.errstate(all="ignore"):
        for token in re.findall(r"[0-9.]+|.", re.sub(r"\s+", "", text)):
            if wants_value:
                if token in "-(":
                    waiting.append("neg" if token == "-" else "(")
                elif re.fullmatch(r"[0-9]+\.?[0-9]*|\.[0-9]+", token) and np.isfinite(np.float64(token)):
                    values.append(np.float64(token))
                    wants_value = False
                else:
                    return None
            elif token == ")":
                settle(1)
                if not waiting:
                    return None
                waiting.pop()
            elif token in "+-*/":
                settle(_RANK[token])
                waiting.append(token)
                wants_value = True
            else:
                return None
        if wants_value or "(" in waiting:
            return None
        settle(1)
    return float(values[0]) if np.isfinite(values[0]) else None


@F.pandas_udf(DoubleType())
def arithmetic(text: pd.Series) -> pd.Series:
    return text.map(evaluate).astype("float64")


@cache
def decompositions() -> dict[int, str]:
    """Of every code point that Unicode decomposes for compatibility, and of combining marks: what is left without marks."""
    found = ((c, "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in range(0x80, sys.maxunicode + 1))
    return {c: plain for c, plain in found if plain != chr(c)}


def normalised(rows: DataFrame) -> DataFrame:
    """(id, text): texts in small letters, decomposed, without marks, separators and white space as single blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text in b.column(1).to_pylist():
                plain = text if text is None or text.isascii() else text.translate(decompositions())
                texts.append(None if plain is None else re.sub(r"[ \t\n\r]+", " ", re.sub(r"[/_-]+", " ", plain.lower())).strip(" "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)
