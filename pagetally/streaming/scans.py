"""Scans as numbered events: file results merged one by one, a cell finalised behind a barrier, locked cells left alone.

A cell's events are numbered from 1; `cell_done` has the last number. A file result counts if it has a number read from
pages: what a file's name alone said stays as it was. Of results for one file the last by number stands. A cell is
finalised once, when its `cell_done` and all events numbered below have arrived, in whatever order and how often; then
its total is the sum of its files' counts, those that the scan has not touched included. Cells whose scan was cut off
stay open.

As a stream, each micro-batch appends to a folder of its number what it leaves: `open` has the events of cells that wait
for others, and is all that the next batch reads of the past besides the finalised cells' names; `final` has results. A
batch that runs again overwrites its own folders only, so it may.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relations import site
from . import locks

CELL = ("hospital", "sigla")
EVENT = "hospital string, sigla string, seq bigint, kind string, file string, count int, method string"

#: Each file is read, some twice with another result, some by name only; every seventh cell's scan is cut off.
EVENTS = """
    SELECT hospital, sigla, CAST(row_number() OVER (PARTITION BY hospital, sigla ORDER BY id, again) AS BIGINT) AS seq, 'file_result' AS kind, file, count, method FROM (
        SELECT id, 0 AS again, hospital, sigla, file, CASE WHEN pages > 0 THEN CAST(1 + id % 4 AS INT) END AS count, CASE WHEN id % 6 = 2 THEN 'filename_glob' ELSE 'pagination' END AS method FROM {file_counts}
        UNION ALL SELECT id, 1, hospital, sigla, file, CAST(2 + id % 3 AS INT), 'header_band_anchors' FROM {file_counts} WHERE id % 5 = 0) AS r
    UNION ALL SELECT hospital, sigla, CAST(1 + count(*) + count_if(id % 5 = 0) AS BIGINT), 'cell_done', CAST(NULL AS STRING), CAST(NULL AS INT), 'pagination' FROM {file_counts} GROUP BY hospital, sigla HAVING sum(id) % 7 <> 0"""


def finalised(events: DataFrame, files: DataFrame) -> DataFrame:
    """hospital, sigla, ocr_count, scanned, files, method of the cells whose events are complete.

    events: as EVENT; files: hospital, sigla, file, per_file, what each cell had before."""
    once = events.dropDuplicates([*CELL, "seq"])
    cells = once.groupBy(*CELL).agg(F.max(F.when(F.col("kind") == "cell_done", F.struct("seq", "method"))).alias("done"), F.count("*").alias("n"))
    cells = cells.filter(F.col("n") == F.col("done.seq")).select(*CELL, F.col("done.method").alias("method"))
    counts = (F.col("kind") == "file_result") & F.col("count").isNotNull() & (F.col("method") != "filename_glob")
    last = once.filter(counts).groupBy(*CELL, "file").agg(F.max(F.struct("seq", "count"))["count"].alias("scanned"))
    whole = files.select(*CELL, "file", "per_file").join(last, [*CELL, "file"], "full")
    sums = whole.groupBy(*CELL).agg(F.coalesce(F.sum(F.coalesce("scanned", "per_file")), F.lit(0)).cast("bigint").alias("ocr_count"), F.count("scanned").alias("scanned"), F.count("*").alias("files"))
    return cells.join(sums, [*CELL], "left").select(*CELL, F.coalesce("ocr_count", F.lit(0).cast("bigint")).alias("ocr_count"), "scanned", "files", "method")


class Merger:
    """foreachBatch: merges file events and finalises cells behind their barrier, under `path`."""

    def __init__(self, spark: SparkSession, path: str, files: DataFrame):
        self.spark, self.path, self.files = spark, path, files

    def _read(self, part: str, batch: int | None, ddl: str) -> DataFrame:
        """What a batch has left, or all batches before one."""
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = [] if not fs.exists(root) else sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root) if f.isDirectory())
        some = [n for n in there if n < batch] if part == "final" else [n for n in there if n < batch][-1:]
        return self.spark.read.schema(ddl).parquet(*[f"{self.path}/{part}/batch={n}" for n in some]) if some else self.spark.createDataFrame([], ddl)

    FINAL = "hospital string, sigla string, ocr_count bigint, scanned bigint, files bigint, method string"

    def __call__(self, batch: DataFrame, number: int) -> None:
        done = self._read("final", number, self.FINAL).select(*CELL)
        waiting = self._read("open", number, EVENT)
        events = waiting.unionByName(batch.select(*waiting.columns)).dropDuplicates([*CELL, "seq"]).join(done, [*CELL], "left_anti")
        touched = self.files.join(events.select(*CELL).distinct(), [*CELL], "left_semi")
        finalised(events, touched).write.mode("overwrite").parquet(f"{self.path}/final/batch={number}")
        closed = self.spark.read.schema(self.FINAL).parquet(f"{self.path}/final/batch={number}").select(*CELL)
        events.join(closed, [*CELL], "left_anti").write.mode("overwrite").parquet(f"{self.path}/open/batch={number}")

    def results(self) -> DataFrame:
        return self._read("final", 1 << 60, self.FINAL)


def merge_scans(stream: DataFrame, merger: Merger, checkpoint: str):
    return stream.writeStream.foreachBatch(merger).option("checkpointLocation", checkpoint)


def respected(events: DataFrame, held: DataFrame) -> DataFrame:
    """Events that a scan emits where cells may be held by somebody: results of held cells are dropped, their
    `cell_scanning` becomes `cell_skipped` with the holder, and `scan_complete` names the skipped cells.

    held: hospital, sigla, holder (one row a cell). Works on a stream of events with a table of holders."""
    skipped = held.groupBy("hospital").agg(F.array_sort(F.collect_set("sigla")).alias("names"))
    own = events.join(held, [*CELL], "left").join(skipped, "hospital", "left")
    locked = F.col("holder").isNotNull()
    kept = own.filter(~locked | ~F.col("kind").isin("file_result", "cell_done"))
    kind = F.when(locked & (F.col("kind") == "cell_scanning"), "cell_skipped").otherwise(F.col("kind"))
    last = F.col("kind") == "scan_complete"
    return kept.select(*CELL, "seq", kind.alias("kind"), "file", F.when(kind == "cell_skipped", F.col("holder")).alias("holder"), F.when(last, F.coalesce(F.array_join("names", ","), F.lit(""))).alias("skipped"))


_SCAN = f"""
    SELECT hospital, sigla, seq, kind, file FROM ({EVENTS}) AS e
    UNION ALL SELECT DISTINCT hospital, sigla, CAST(0 AS BIGINT), 'cell_scanning', CAST(NULL AS STRING) FROM {{file_counts}}
    UNION ALL SELECT DISTINCT hospital, CAST(NULL AS STRING), CAST(NULL AS BIGINT), 'scan_complete', CAST(NULL AS STRING) FROM {{file_counts}}"""


def _held(s) -> DataFrame:
    """Cells that somebody edits when the scan begins: a site is a session, a category one of its cells."""
    room = locks.x14_presence_snapshot(s).filter("mode = 'editor' and focused_cell is not null").select("session", F.col("focused_cell").alias("place"), F.col("member").alias("holder"))
    return s.spark.sql(f"SELECT {site('session')} AS hospital, d.sigla, r.holder FROM {{r}} AS r JOIN {{d}} AS d ON d.ord % {locks.CELLS} = r.place", r=room, d=s["dim_sigla"])


def x01_event_merge(s) -> DataFrame:
    """Cells finalised after all their file events."""
    return finalised(s.sql(EVENTS), s["file_counts"])


def x09_lock_skips(s) -> DataFrame:
    """What a scan of all cells emits while some are held."""
    return respected(s.sql(_SCAN), _held(s))


OPERATORS = {f.__name__: f for f in (x01_event_merge, x09_lock_skips)}
_held_sql = f"SELECT {site('session')} AS hospital, d.sigla, r.member AS holder FROM ({locks.SQL['x14_presence_snapshot']}) AS r JOIN {{dim_sigla}} AS d ON d.ord % {locks.CELLS} = r.focused_cell WHERE r.mode = 'editor'"
SQL = {
    "x01_event_merge": f"""
        SELECT d.hospital, d.sigla, CAST(sum(coalesce(x.count, f.per_file, 0)) AS BIGINT) AS ocr_count, count(x.count) AS scanned, count(*) AS files, min(d.method) AS method
        FROM (SELECT * FROM ({EVENTS}) AS a WHERE kind = 'cell_done') AS d JOIN {{file_counts}} AS f ON f.hospital = d.hospital AND f.sigla = d.sigla
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY hospital, sigla, file ORDER BY seq DESC) AS back FROM ({EVENTS}) AS b WHERE kind = 'file_result' AND count IS NOT NULL AND method <> 'filename_glob') AS x
          ON x.hospital = f.hospital AND x.sigla = f.sigla AND x.file = f.file AND x.back = 1 GROUP BY d.hospital, d.sigla""",
    "x09_lock_skips": f"""
        SELECT e.hospital, e.sigla, e.seq, CASE WHEN h.holder IS NOT NULL AND e.kind = 'cell_scanning' THEN 'cell_skipped' ELSE e.kind END AS kind, e.file, CASE WHEN e.kind = 'cell_scanning' THEN h.holder END AS holder,
          CASE WHEN e.kind = 'scan_complete' THEN coalesce((SELECT string_agg(DISTINCT k.sigla, ',' ORDER BY k.sigla) FROM ({_held_sql}) AS k WHERE k.hospital = e.hospital), '') END AS skipped
        FROM ({_SCAN}) AS e LEFT JOIN ({_held_sql}) AS h ON h.hospital = e.hospital AND h.sigla = e.sigla WHERE h.holder IS NULL OR e.kind NOT IN ('file_result', 'cell_done')""",
}
