"""Sources and sinks beyond the tables: file listings, JSON fixtures, CSV indexes, range values and manifests.

Listings read no content: `binaryFile` prunes it when only path, time and length are asked for.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pdf import opened
from .replacing import Replacing

FIXTURE = "name string, source string, description string, base_fixture string, degraded_pages array<int>, reads array<struct<pdf_page: int, curr: int, total: int, method: string, confidence: double>>"
TRUTH = "map<string, struct<doc_count: int, complete_count: int, inferred_count: int>>"
INDEX = "pdf_nickname string, page_num int, tier1_parsed string, tier2_parsed string, tier1_text string, tier2_text string, tier3_text string, image_path string"

_NUMBER = re.compile(r"([0-9]{1,3}) *de *([0-9]{1,3})")


def unique() -> str:
    return uuid.uuid4().hex


@cache
def _own_folder(application: str) -> str:
    path = tempfile.mkdtemp(prefix=f"pagetally-{application}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file:{path}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where that is unset, in a temporary folder of our own
    if the driver is all there is (local master), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/pagetally/{name}-{unique()}"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modified, length of every matching file at any depth; sort by path where order matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def listed_by_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of every file at any depth, listed in tasks, for trees that a driver cannot hold. Level by level,
    each folder by one task; what a level has is written before the next is listed. `folder` is where pyarrow can read."""
    shape = pa.schema([("path", pa.string()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(path))
                for s in range(0, len(found), 10_000):
                    some = found[s : s + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path for f in some], pa.string()), pa.array([f.size if f.is_file else None for f in some], pa.int64())], schema=shape)

    out, levels = scratch(spark, "listing"), []
    todo = spark.createDataFrame([(opened(folder)[1],)], "path string")
    while True:
        levels.append(f"{out}/level={len(levels)}")
        todo.mapInArrow(run, "path string, length bigint").write.parquet(levels[-1])
        folders = spark.read.schema("path string, length bigint").parquet(levels[-1]).filter("length is null").select("path")
        if folders.isEmpty():
            return spark.read.schema("path string, length bigint").parquet(*levels).filter("length is not null")
        todo = folders.repartition(4 * spark.sparkContext.defaultParallelism)


def stale_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose page count isn't cached for their time and length; failures were never cached."""
    return files.join(cache, ["path", "modified", "length"], "left_anti")


def page_counts(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached page count of each file, null where it is stale."""
    return files.join(cache.select("path", "modified", "length", "pages"), ["path", "modified", "length"], "left")


def fixture_reads(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """One row per page read of each JSON fixture (or array of them) at any depth, but for those in a folder named archived."""
    rows = spark.read.schema(FIXTURE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)
    return rows.filter(~F.input_file_name().contains("/archived/") & F.col("reads").isNotNull()).select("name", "source", F.explode("reads").alias("r")).select("name", "source", "r.*")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """One row per name of JSON maps of expected counts."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.explode(F.from_json("value", TRUTH)).alias("name", "v"))
    return rows.select("name", "v.*")


def capture_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages that a tier read, and pages that none did, of a CSV index."""
    rows = spark.read.schema(INDEX).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    found = F.coalesce(F.nullif(F.trim("tier1_parsed"), F.lit("")), F.nullif(F.trim("tier2_parsed"), F.lit("")))
    rows = rows.withColumn("parsed", found)
    return rows.filter("parsed is not null"), rows.filter("parsed is null")


def write_capture(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_range_values(values: DataFrame, ranges: DataFrame, path: str) -> DataFrame:
    """Write `range_name`, `value` of known ranges, replacing what was there as a whole (and keeping it as `.bak`); return
    the names that no range has."""
    known = ranges.select("range_name").distinct()
    spark = values.sparkSession
    spark.dataSource.register(Replacing)
    values.join(known, "range_name", "left_semi").select("range_name", "value").write.format("replacing").mode("overwrite").save(path)
    return values.join(known, "range_name", "left_anti").select("range_name")


def page_numbers(contents: DataFrame) -> DataFrame:
    """pdf, page, curr, total, method, error of pages' contents (pdf, page, content: bytes of text). What goes wrong with a
    page stays with it: it is a row that failed, with its error."""

    def read(content: bytes | None) -> tuple[int, int]:
        if content is None:
            raise ValueError("no content")
        found = _NUMBER.search(content.decode("utf-8"))
        if found is None:
            raise LookupError("no number")
        curr, total = map(int, found.groups())
        if not 0 < curr <= total:
            raise ValueError(f"{curr} of {total}")
        return curr, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content in b.column(2).to_pylist():
                try:
                    rows.append((*read(content), "direct", None))
                except (ValueError, LookupError) as e:
                    rows.append((None, None, "failed", "bad bytes" if isinstance(e, UnicodeDecodeError) else str(e.args[0])))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["pdf", "page", "curr", "total", "method", "error"])

    return contents.select("pdf", "page", "content").mapInArrow(run, "pdf bigint, page int, curr int, total int, method string, error string")


def set_time(spark: SparkSession, path: str, seconds: int) -> None:
    """Sets when a file or folder was last changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setTimes(at, seconds * 1000, -1)


def write_manifest(ops: DataFrame, path: str) -> None:
    """Pending operations as JSON lines; none is an error."""
    pending = ops.filter("status = 'pending'")
    if pending.isEmpty():
        raise ValueError("no pending operation to write")
    pending.write.mode("overwrite").json(path)


def latest_result(spark: SparkSession, folder: str, pattern: str = "sweep_*.json") -> str | None:
    """The path of the last result by name."""
    return list_files(spark, folder, pattern).agg(F.max("path")).first()[0]


def latest_run(spark: SparkSession, folder: str, schema: str, by: str = "run") -> DataFrame:
    """The rows of the last run by name, of results partitioned by run: only its files are read."""
    rows = spark.read.schema(schema).json(folder)
    return rows.filter(F.col(by) == rows.agg(F.max(by)).first()[0])
