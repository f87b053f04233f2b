"""Numbered scan events: by hand, and as streams of shuffled and repeated batches against the batch form."""

import random

from pagetally import catalog
from pagetally.plans.relations import Session
from pagetally.streaming import scans

DIR = "/root/testdata/sf0.001"


def test_a_cell_by_hand(spark):
    cell = ("HPV", "odi")
    files = spark.createDataFrame([(*cell, "a", 1), (*cell, "b", 2), (*cell, "c", None), ("HPV", "art", "d", 9)], "hospital string, sigla string, file string, per_file int")
    rows = [(*cell, 1, "file_result", "a", 5, "pagination"), (*cell, 2, "file_result", "b", None, "pagination"), (*cell, 3, "file_result", "b", 7, "filename_glob"), (*cell, 4, "file_result", "a", 4, "v4"), (*cell, 5, "file_result", "new", 1, "v4"), (*cell, 6, "cell_done", None, None, "v4")]
    rows += [("HPV", "art", 2, "cell_done", None, None, "v4"), ("HRB", "irl", 1, "cell_done", None, None, "v4")]  # one misses an event, one has no file
    got = lambda r: sorted(tuple(x) for x in scans.finalised(spark.createDataFrame(r, scans.EVENT), files).collect())
    assert got(rows) == got(rows[::-1] + rows[2:5]) == [("HPV", "odi", 4 + 2 + 0 + 1, 2, 4, "v4"), ("HRB", "irl", 0, None, None, "v4")]
    assert got(rows[1:]) == [("HRB", "irl", 0, None, None, "v4")] and got([]) == []


def test_shuffled_and_repeated_batches_equal_the_batch(spark, tmp_path):
    s = Session(spark, DIR)
    rows = s.sql(scans.EVENTS).select("hospital", "sigla", "seq", "kind", "file", "count", "method").collect()
    rng = random.Random(3)
    rng.shuffle(rows)
    src, merger = tmp_path / "in", scans.Merger(spark, str(tmp_path / "out"), s["file_counts"])
    n = len(rows) // 4 + 1
    for k in range(0, len(rows), n):
        some = rows[k : k + n] + rng.sample(rows[: k + n], 20)
        spark.createDataFrame(some, scans.EVENT).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(scans.EVENT).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = scans.merge_scans(stream, merger, str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    want = sorted(tuple(r) for r in catalog.queries()["x01_event_merge"](spark, DIR).collect())
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r) for r in merger.results().collect()), key=key) == sorted(want, key=key)
    last = spark.createDataFrame(rows[3 * n :], scans.EVENT)
    merger(last, 3)  # a batch that runs again
    merger(spark.createDataFrame(rows, scans.EVENT), 4)  # all of it, late
    assert sorted((tuple(r) for r in merger.results().collect()), key=key) == sorted(want, key=key)


def test_a_stream_leaves_held_cells_alone(spark, tmp_path):
    s = Session(spark, DIR)
    events, held = s.sql(scans._SCAN), scans._held(s)
    assert held.count() > 0
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = scans.respected(stream, held).writeStream.format("memory").queryName("emitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    rows = lambda df: sorted(map(repr, df.collect()))
    emitted = rows(spark.table("emitted"))
    assert emitted == rows(catalog.queries()["x09_lock_skips"](spark, DIR))
    assert {"cell_skipped", "scan_complete", "file_result"} <= {r.kind for r in spark.table("emitted").collect()}
