"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are sorted by id (null first; repeated ids by text) over range partitions, encoded, and written
with their place in the order. Readers split files by stripes; a lookup of ids is pruned by file, stripe and
row group from minima, maxima and Bloom filters. Ids of all documents before one are found again from the
files: sums of files, then prefix sums within a file.

Null and empty texts hold the end id alone. Only id and text are written, so other columns cannot clash.
A text is cut at ASCII white space, which no token reaches across in a vocabulary whose pre-tokenizer drops
white space; equal words are found by a dictionary of the words and encoded once. Memory is bounded by a batch,
a piece of it or its longest text, and the memo.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bound, chunks, n_parts, release

#: Bytes of words and their ids that a worker keeps (each word takes some 150 bytes besides); beyond it, new
#: words are forgotten after their piece of a batch. It bounds memory, not results.
MEMO = 24_000_000
#: Bytes of text cut into words at once; a longer text is cut alone.
CHUNK = 8_000_000


def _steps(part: dict | None) -> list[dict]:
    """The steps of a tokenizers file's normalizer or pre-tokenizer."""
    part = part or {}
    return part.get("normalizers") or part.get("pretokenizers") or [part]


def _kinds(part: dict | None) -> set[str]:
    return {x.get("type") for x in _steps(part)}


def _taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items `at` of those that begin at start in flat, one after the other, and where each ends."""
    n = size[at]
    ends = np.cumsum(n)
    take = np.repeat(start[at] - (ends - n), n)
    take += np.arange(len(take))
    return flat[take], ends


def _upto(lists: pa.ListArray, ends: np.ndarray) -> np.ndarray:
    """Where each list ends if its items end at `ends`."""
    at = lists.offsets.to_numpy()
    return np.concatenate([[0], ends])[at - at[0]][1:]


class WordTokenizer:
    """A tokenizers file whose pre-tokenizer drops white space; a worker opens it once.

    fold: its normalizer lower-cases, so words of ASCII letters are looked up in lower case. cut: its pre-tokenizer
    parts letters from a full stop or comma, so one that ends a word is looked up by itself."""

    def __init__(self, raw: str):
        self.raw, self._tok = raw, None
        made = json.loads(raw)
        self.fold = "Lowercase" in _kinds(made.get("normalizer"))
        self.cut = any(x.get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") for x in _steps(made.get("pre_tokenizer")))

    def __getstate__(self):
        return {"raw": self.raw, "_tok": None, "fold": self.fold, "cut": self.cut}

    def _open(self):
        if self._tok is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tok, self._memo, self._held = Tokenizer.from_str(self.raw), {}, 0
        return self._tok

    def _learn(self, words: list[str]) -> None:
        """Encodes words as one text and cuts its ids where the words do."""
        e = self._tok.encode(" ".join(words), add_special_tokens=False)
        ids, at = np.array(e.ids, np.int32), np.array([s for s, _ in e.offsets], np.int64)
        first = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        cut = np.cumsum(np.bincount(np.searchsorted(first, at, "right") - 1, minlength=len(words))).tolist()
        for w, s, t in zip(words, [0, *cut], cut, strict=False):
            self._memo[w] = ids[s:t].tobytes()
            self._held += len(w) + 4 * (t - s)

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        memo = self._memo
        ids = list(map(memo.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        new = [words[i] for i in missing]
        for a, b in chunks([len(w) for w in new], 100_000):
            self._learn(new[a:b])
        for i, w in zip(missing, new, strict=True):
            ids[i] = memo[w]
        if self._held > MEMO:
            for w in new:
                self._held -= len(w) + len(memo.pop(w))
        return ids

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of texts, one after the other, and where each text's end."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        own = words.dictionary
        if self.fold:
            own = pc.if_else(pc.string_is_ascii(own), pc.ascii_lower(own), own)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(own, "([a-z])([.,])$", r"\1 \2") if self.cut else own)
        bases = parts.flatten().dictionary_encode()
        ids = self._known(bases.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, ends = _taken(np.frombuffer(b"".join(ids), np.int32), np.cumsum(size) - size, size, bases.indices.to_numpy(zero_copy_only=False))
        ends = _upto(parts, ends)
        size = np.diff(ends, prepend=0)
        flat, ends = _taken(flat, ends - size, size, words.indices.to_numpy(zero_copy_only=False))
        return flat, _upto(lists, ends)

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has. Null texts are empty."""
        self._open()
        texts = texts.cast(pa.large_string()).fill_null("")
        parts, sizes = [], []
        for s, e in chunks(pc.binary_length(texts).to_pylist(), CHUNK):
            ids, ends = self._words(texts.slice(s, e - s).cast(pa.string()))
            if end is not None:
                ids = np.insert(ids, ends, end)
                ends = ends + np.arange(1, e - s + 1)
            parts.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))


def load(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return bound(spark, WordTokenizer(f.read()))


def token_ids(tokenizer, end: int | None = 1):
    @F.arrow_udf("array<int>")
    def encode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            ids, sizes = tokenizer.value.encode(a, end)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
        release()

    return encode


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """CRC-32 of ids as little-endian unsigned 32-bit integers (null: of none)."""
    ids = ids.cast(pa.list_(pa.int32()))
    flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4").view(np.uint8)
    at = 4 * ids.offsets.to_numpy()
    ok = ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([zlib.crc32(flat[a:b]) if v else 0 for a, b, v in zip(at[:-1].tolist(), at[1:].tolist(), ok.tolist(), strict=True)], pa.int64())


def write_token_files(df: DataFrame, tokenizer, path: str, id: str = "doc_id", text: str = "text", end: int | None = 1) -> None:
    """Files of doc_id, place, n_tokens and ids, in ascending order of ids."""
    rows = df.select(df[id].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n_parts(df.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("place"), token_ids(tokenizer, end)(F.col("text")).alias("ids"))
    rows.select("doc_id", "place", F.size("ids").cast("bigint").alias("n_tokens"), "ids").write.option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "10000").option("orc.stripe.size", str(32 << 20)).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, place bigint, n_tokens bigint, ids array<int>").orc(path)


def starts(rows: DataFrame) -> DataFrame:
    """Adds `start`, the number of ids of all documents before each; rows has place and n_tokens."""
    rows = rows.withColumn("__file", F.shiftright("place", 33))
    upto = Window.partitionBy(F.lit(1)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("__file").agg(F.sum("n_tokens").alias("n")).select("__file", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__upto", F.sum("n_tokens").over(within)).join(files, "__file").withColumn("start", F.col("__base") + F.col("__upto") - F.col("n_tokens")).drop("__file", "__base", "__upto")


def find_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Documents by id; ORC skips stripes and row groups by minima, maxima and Bloom filters."""
    return read_token_files(spark, path).filter(F.col("doc_id").isin(ids))


def crc_column(ids: str = "ids") -> Column:
    return ids_crc32(F.col(ids))
