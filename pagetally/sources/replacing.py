"""A sink that replaces its output as a whole: `df.write.format("replacing").mode("overwrite").save(folder)`.

Tasks write Parquet parts beside the output. When all have, the commit keeps the old output as `.bak` and renames the new
one into its place; when any has failed, what was written goes and the old output is as it was. A task's part is named
by its partition and attempt, and only parts that the commit knows are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .pdf import opened


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ReplacingWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.shape, self.aside = folder.rstrip("/"), schema, f"{folder.rstrip('/')}.tmp-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, root = opened(self.aside)
        system.create_dir(root, recursive=True)
        task, rows, shape = TaskContext.get(), 0, to_arrow_schema(self.shape)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.parquet"
        with system.open_output_stream(f"{root}/{name}") as out, pq.ParquetWriter(out, shape) as file:
            for b in iterator:
                file.write_batch(b.cast(shape))
                rows += b.num_rows
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, new = opened(self.aside)
        _, at = opened(self.folder)
        kept = {m.name for m in messages if m is not None}
        system.create_dir(new, recursive=True)
        for f in system.get_file_info(fs.FileSelector(new)):
            if f.base_name not in kept:  # of an attempt that was given up
                system.delete_file(f.path)
        exists = lambda p: system.get_file_info(p).type != fs.FileType.NotFound
        if exists(at):
            if exists(f"{at}.bak"):
                system.delete_dir(f"{at}.bak")
            system.move(at, f"{at}.bak")
        system.move(new, at)

    def abort(self, messages: list[Part | None]) -> None:
        system, new = opened(self.aside)
        if system.get_file_info(new).type != fs.FileType.NotFound:
            system.delete_dir(new)


class Replacing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replacing"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ReplacingWriter(self.options["path"], schema)
