"""Shared helpers: the cluster's shared folder, staged tables, streaming over sorted partitions."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@cache
def _own_dir(application: str) -> str:
    return "file:" + tempfile.mkdtemp(prefix=f"pagetally-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary folder of our own if the driver is all
    there is (local master); on a cluster, where executors could not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir(spark.sparkContext.applicationId)
    return base.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It may be deleted once the results that read it are written: see `tidied`."""
    _made.append(f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made meanwhile; results that read them must have been written by then."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete(spark, path)
        del _made[before:]


def kept(df: DataFrame, name: str) -> DataFrame:
    """`staged`, to a path that `tidied` leaves alone."""
    out = staged(df, name)
    _made.pop()
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage is cut, a lost executor costs
    nothing already written, and the planner knows the table's size when it picks a join."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound(spark: SparkSession, value: object):
    """A broadcast of something whose size is fixed by a vocabulary, model or parameter file."""
    return spark.sparkContext.broadcast(value)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, most: str = "8m") -> Iterator[None]:
    """What is written meanwhile passes to Python in small Arrow batches, which executors hold off their heap and keep:
    at the usual 10,000 rows, some 300 MB of it. The session's settings are put back."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": most}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_TYPES = {"bigint": T.LongType, "int": T.IntegerType, "string": T.StringType, "binary": T.BinaryType, "double": T.DoubleType, "boolean": T.BooleanType}


def schema(ddl: str) -> T.StructType:
    """A schema of plain and array columns; unlike StructType.fromDDL, needs no session, so workers may import it."""

    def kind(name: str) -> T.DataType:
        return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else _TYPES[name]()

    return T.StructType([T.StructField(f.split()[0], kind(f.split()[1])) for f in ddl.split(",")])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `most` bytes in a column of texts or bytes."""
    for b in batches:
        for s, e in chunks(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist(), most):
            yield b.slice(s, e - s)


def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of batches whose rows have the same keys; a group may come in several slices."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[start]:
                yield rows[start], b.slice(start, i - start)
                start = i


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Groups of neighbouring rows with equal keys, from sorted batches; one group is held at a time."""
    now, held = None, []
    for key, part in segments(batches, keys):
        if held and key != now:
            yield now, held
            held = []
        now = key
        held.append(part)
    if held:
        yield now, held


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items with about `most` in all; a larger item makes a range alone."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
