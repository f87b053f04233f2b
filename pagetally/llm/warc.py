"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Writing. Records are composed in SQL and written by Spark's text writer, whose line separator is the blank
line that ends a record. Of equal payloads of at least `least` bytes, the page with the largest id is the
response (every row with that id, if it is repeated) and the others revisit it.

Reading. Files are read by Spark's text reader with the record magic as line separator, so large files are
split and no task needs a whole file. Every magic is a candidate: tasks emit its offset and the offset of its
successor by the declared length. Per file, pointer jumping from offset 0 over these pairs (two integers a
candidate) keeps the reachable records; a magic inside a payload is no record's successor and is rejected.
A second pass takes the records out, from each split's first reachable one; only records that hold a magic,
and so came in several pieces, are put together by a shuffle.

WARC/1.0 and WARC/1.1 records are read, from plain files and from gzipped ones (a gzipped file is one split).
A file in which no record starts where the last one ends, or whose last record is cut short, is damaged: reading it
is an error, or with damaged="skip" ends with the records before the damage.

Null payloads are empty. Repeated rows give repeated records. A null id is written as `null` and read back
as null; such a page never is what others refer to. Line ends in addresses are percent-encoded. An empty table
gives no file. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, pieces, release, runs, schema, segments, staged

#: What every record starts with; the rest of its first line is a version.
MAGIC = b"WARC/1."
VERSIONS = (b"0\r\n", b"1\r\n")
END = "\r\n\r\n"
LEAST = 1000
DATE = "2020-01-01T00:00:00Z"
#: Splits up to which their first records are sent to all tasks (some 100 bytes each); beyond, rows are shuffled.
MOST_SPLITS = 100_000


def write_archives(df: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, compression: str = "none") -> None:
    pages = df.select(df[id].alias("id"), F.coalesce(df[url], F.lit("")).alias("url"), F.coalesce(df[payload], F.lit("")).alias("body"))
    pages = pages.select("*", F.octet_length("body").alias("bytes"), F.sha1("body").alias("sha1"))
    same = pages.filter(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    pages = pages.join(staged(same, "warc-same"), ["sha1", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.concat(F.lit("null:"), F.sha1(F.concat("url", F.lit("\n"), "body")))), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    pages = pages.select("*", http.alias("http"), (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).alias("length"))
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "body"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC.decode() + "1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.col("length").cast("string"), F.lit(END),
    )
    pages.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _length(segment: bytes) -> int:
    """Bytes of the record that starts before this segment, magic included; -1 if it is none."""
    end = segment.find(b"\r\n\r\n")
    if end < 0 or not segment.startswith(VERSIONS):
        return -1
    for line in segment[:end].split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"content-length" and value.strip().isdigit():
            return len(MAGIC) + end + 4 + int(value) + 4
    return -1


LOCATED = schema("path string, block bigint, at bigint, value binary")
CANDIDATES = schema("path string, block bigint, at bigint, size bigint, length bigint")
ENTRIES = schema("path string, block bigint, base bigint, owner bigint, owner_end bigint, file_end bigint")
PIECES = schema("path string, record bigint, piece bigint, bytes binary, whole boolean")


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds where each segment starts, counted from its split's first segment."""
    now, at, out = None, 0, arrow_schema(LOCATED)
    for key, b in segments(pieces(batches, 2), ["path", "block"]):
        if key != now:
            now, at = key, 0
        sizes = pc.binary_length(b.column(2)).to_numpy().astype(np.int64) + len(MAGIC)
        start = at + np.cumsum(sizes) - sizes
        at += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start), b.column(2)], schema=out)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = arrow_schema(CANDIDATES)
    for b in _located(batches):
        values = b.column(3).to_pylist()  # a piece of a batch
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(v) for v in values], pa.int64()), pa.array([_length(v) for v in values], pa.int64())], schema=out)
    release()


def reachable(offsets: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of the sorted candidates are reached from offset 0, by pointer jumping."""
    n = len(offsets)
    to = np.searchsorted(offsets, offsets + lengths)
    found = (lengths > 0) & (to < n) & (offsets[np.minimum(to, n - 1)] == offsets + lengths) if n else np.zeros(0, bool)
    jump = np.append(np.where(found, to, n), n)  # n: the end, or nowhere
    reach = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        reach[0] = True
    for _ in range(n.bit_length() + 1):
        reach[jump[reach]] = True
        jump = jump[jump]
    reach = reach[:n]
    return reach & (lengths > 0) & (offsets + lengths <= size)


def _entries(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _entries_of(batches, strict)

    return run


def _entries_of(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    """Per file: each split's place, and the record that reaches into it from before."""
    out = arrow_schema(ENTRIES)
    for (path,), own in runs(batches, ["path"]):
        block, at, size, length = (np.concatenate([b.column(i).to_numpy() for b in own]) for i in (1, 2, 3, 4))
        blocks, first = np.unique(block, return_index=True)
        totals = np.add.reduceat(size + len(MAGIC), first)
        base = np.cumsum(totals) - totals
        offset = base[np.searchsorted(blocks, block)] + at - len(MAGIC)  # a file's first segment comes before any magic
        is_record = offset >= 0
        end = int(totals.sum()) - len(MAGIC)
        keep = reachable(offset[is_record], length[is_record], end)
        records, ends = offset[is_record][keep], (offset + length)[is_record][keep]
        if strict and end > 0 and (last := int(ends.max(initial=0))) != end:
            raise ValueError(f"{path} is damaged: no whole record starts at byte {last} of {end}")
        before = np.searchsorted(records, base - len(MAGIC)) - 1  # the last record that starts before the split's first magic
        owner = np.where(before >= 0, records[np.maximum(before, 0)] if len(records) else -1, -1)
        owner_end = np.where(before >= 0, ends[np.maximum(before, 0)] if len(records) else 0, 0)
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(blocks)), pa.array(blocks), pa.array(base), pa.array(owner), pa.array(owner_end), pa.array(np.full(len(blocks), end))], schema=out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes records out of located segments: whole ones, and pieces of those that hold a magic."""
    out, now, record, end = arrow_schema(PIECES), None, -1, 0
    for key, b in segments(pieces(batches, LOCATED.names.index("value")), ["path", "block"]):
        rows = []
        for at, value, base, owner, owner_end, file_end in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("at", "value", "base", "owner", "owner_end", "file_end")), strict=True):
            if key != now:
                now, record, end = key, owner, owner_end
            start = base + at - len(MAGIC)
            if start < 0 or (start > end and start != 0):
                continue  # before the first record, or after the chain's end
            if start == end:
                if (n := _length(value)) < 0 or start + n > file_end:
                    end = -1
                    continue
                record, end = start, start + n
            if end >= 0 and record >= 0:
                rows.append((key[0], record, start, MAGIC + value, start == record and start + len(MAGIC) + len(value) >= end))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)
    release()


RECORDS = schema("path string, offset bigint, record_type string, record_id string, uri string, refers_to string, declared_digest string, declared_bytes bigint, payload binary")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = arrow_schema(RECORDS)

    def fields(raw: bytes) -> dict[str, str]:
        lines = (x.partition(b":") for x in raw.split(b"\r\n"))
        return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in lines}

    for b in pieces(batches, 2):
        rows = []
        for path, offset, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cut = raw.index(b"\r\n\r\n")
            head = fields(raw[len(MAGIC) : cut])
            body = raw[cut + 4 : cut + 4 + int(head["content-length"])]
            size = None
            if head.get("content-type", "").startswith("application/http"):
                cut = body.find(b"\r\n\r\n")
                http, body = (fields(body[:cut]), body[cut + 4 :]) if cut >= 0 else ({}, body)
                size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
            kind = head.get("warc-type")
            rows.append((path, offset, kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, size, None if kind == "revisit" else body))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)
    release()


JOINED = schema("path string, record bigint, bytes binary")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from their sorted pieces; one record is held at a time, and no other form of it than its bytes."""
    out = arrow_schema(JOINED)
    for (path, record), own in runs(batches, ["path", "record"]):
        whole = b"".join(x.as_buffer() for b in own for x in b.column(3))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([record], pa.int64()), pa.array([whole], pa.binary())], schema=out)
    release()


def read_archives(spark: SparkSession, path: str, most_splits: int = MOST_SPLITS, damaged: str = "error") -> DataFrame:
    """One row per record, with its payload (null for revisits). damaged: "error", or "skip" what follows damage."""
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    found = raw.mapInArrow(_candidates, CANDIDATES)
    entries = staged(found.repartition("path").sortWithinPartitions("path", "block", "at").mapInArrow(_entries(damaged != "skip"), ENTRIES), "warc-entries")
    few = entries.count() <= most_splits
    rows = raw.mapInArrow(_located, LOCATED).join(F.broadcast(entries) if few else entries, ["path", "block"])
    if not few:
        rows = rows.repartition("path", "block").sortWithinPartitions("path", "block", "at")
    taken = rows.mapInArrow(_pieces, PIECES)
    whole = taken.filter("whole").select("path", "record", "bytes")
    parts = taken.filter("not whole").select("path", "record", "piece", "bytes").repartition("path", "record").sortWithinPartitions("path", "record", "piece")
    parts = parts.mapInArrow(_joined, JOINED)
    return whole.unionByName(parts).mapInArrow(_parsed, RECORDS)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of what write_archives wrote."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = lambda c: F.when(F.length(number(c)) > 0, number(c).cast(T.LongType()))
    revisit = F.col("record_type") == "revisit"
    return records.select(
        page("record_id").alias("page_id"), F.when(revisit, F.col("declared_bytes")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.sha1("payload")).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )
