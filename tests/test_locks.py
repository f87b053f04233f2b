"""Presence and locks: the rule by hand, a plainer replay of every event, and the stream against the batch."""

import random

import pytest

from pagetally import catalog
from pagetally.streaming import locks

DIR = "/root/testdata/sf0.001"
S = 1_000_000
EVENTS = "session bigint, member bigint, t bigint, id bigint, kind string, cell bigint"


def test_rule_by_hand():
    room = locks.Room(0, 10 * S)
    assert room.step(5, 0, "focus", 1) == (None, None, None, None)  # no heartbeat yet
    assert room.step(5, 1, "heartbeat", None) == (None, "editor", None, None)
    assert room.step(5, 2, "focus", 1)[:2] == (1, "editor")
    room.step(6, 3, "heartbeat", None)
    assert room.step(6, 4, "focus", 1) == (1, "viewer", None, 5)
    assert room.step(6, 5, "lend", 1) == (1, "viewer", "skipped", 5)  # somebody else edits
    assert room.step(5, 6, "lend", 1) == (1, "viewer", "lent", 0)
    assert room.step(6, 7, "focus", 1)[:2] == (1, "viewer")  # the agent is not dethroned either
    assert room.step(9, 8, "unlend", None)[2] == "released"
    assert room.editor_of(1) == 5  # given back
    assert room.step(5, 9, "release", None)[:2] == (None, "editor")
    assert room.step(6, 10, "focus", 1)[:2] == (1, "editor")
    assert room.step(5, 6 + 10 * S, "heartbeat", None)[:2] == (None, "editor")
    assert room.step(6, 10 + 10 * S, "focus", 1) == (None, None, None, None)  # gone to the microsecond
    assert [locks._public(0, k, m) for k, m in room.members.items()] == [(0, 5, "user 5", locks.COLORS[5], "human", None, "editor")]
    room.join(0, 11 + 10 * S)
    assert locks._public(0, 0, room.members[0])[2:5] == locks.AGENT


def plainly(rows, life):
    """Every event again, over lists of all that ever joined."""
    out, lease, where, edits, loans = [], {}, {}, {}, {}
    for session, who, t, i, kind, cell in sorted(rows, key=lambda r: (r[2], r[3])):
        here = lambda k: lease.get((session, k), -1) > t  # noqa: E731, B023
        editors = lambda c, but=None: [k for (s, k), at in where.items() if s == session and at == c and c is not None and k != but and edits.get((s, k)) and here(k)]  # noqa: E731, B023
        agent, outcome = session * locks.SEATS, None

        def place(k, c):
            edits[session, k], where[session, k], lease[session, k] = not editors(c, k), c, t + life  # noqa: B023

        def join(k):
            if not here(k):  # noqa: B023
                where[session, k], edits[session, k] = None, True  # noqa: B023
            lease[session, k] = t + life  # noqa: B023

        if kind == "heartbeat":
            join(who)
        elif kind in ("focus", "release") and here(who):
            place(who, cell)
        elif kind == "leave":
            lease.pop((session, who), None)
        elif kind == "lend":
            held = editors(cell, agent)
            outcome = "claimed" if not held else "lent" if held == [who] else "skipped"
            if outcome == "lent":
                edits[session, who] = False
                loans.setdefault(session, []).append((cell, who))
            if outcome != "skipped":
                join(agent)
                place(agent, cell)
        elif kind == "unlend":
            outcome = "released" if here(agent) else "idle"
            lease.pop((session, agent), None)
            for c, k in loans.pop(session, []):
                if here(k) and where[session, k] == c and not editors(c):
                    edits[session, k] = True
        now = editors(cell)
        out.append((session, who, t, i, kind, cell, where[session, who] if here(who) else None, ("editor" if edits[session, who] else "viewer") if here(who) else None, outcome, now[0] if now else None))
    return sorted(out)


def made(seed, n=600):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 2, 5]) * S
        kind = rng.choice(["heartbeat", "heartbeat", "focus", "focus", "focus", "release", "leave", "lend", "lend", "unlend"])
        session = rng.randrange(3)
        rows.append((session, session * locks.SEATS + rng.randrange(5), t, i, kind, rng.randrange(3) if kind in ("focus", "lend") else None))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_steps_equal_a_plain_replay(spark, seed):
    rows = made(seed)
    want = plainly(rows, 45 * S)
    random.Random(seed).shuffle(rows)
    got = sorted(tuple(r) for r in locks.steps(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == want and {r[8] for r in got} == {None, "lent", "claimed", "skipped", "released", "idle"}


def test_queries_replay_all_events(spark):
    events = spark.read.parquet(f"{DIR}/events.parquet").selectExpr("event_id", "user_id", "event_type", "unix_micros(CAST(ts AS TIMESTAMP)) AS t").collect()

    def seen(r):
        kind = {"signup": "heartbeat", "view": "focus", "click": "focus" if r.event_id % 10 else "release", "purchase": "lend"}.get(r.event_type) or ("leave", "heartbeat", "unlend")[r.event_id % 3]
        return r.user_id // locks.SEATS, r.user_id, r.t, r.event_id, kind, r.event_id % locks.CELLS if kind in ("focus", "lend") else None

    want = plainly([seen(r) for r in events], locks.LIFE * S)
    got = sorted(catalog.queries()["x08_lock_lending"](spark, DIR).collect())
    assert [tuple(r) for r in got] == sorted((r[3], r[0], r[1], r[4], r[5], r[8], r[9]) for r in want if r[8])


def test_an_empty_table(spark):
    none = spark.createDataFrame([], EVENTS)
    assert locks.steps(none).collect() == [] and locks.snapshot(none).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    """Events come out of order, in several batches, some twice."""
    rows = made(7, 300)
    rng = random.Random(7)
    blocks = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    src, schema = tmp_path / "in", spark.createDataFrame([], EVENTS).schema
    for k, block in enumerate(blocks):
        some = block + rng.sample(block, 3) + rows[max(0, 60 * k - 5) : 60 * k]
        rng.shuffle(some)
        spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(str(src))
    far = (9, 9 * locks.SEATS, 10**15, 10**6, "leave", None)
    spark.createDataFrame([far], EVENTS).coalesce(1).write.mode("append").parquet(str(src))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        out = locks.step_stream(stream, late="30 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        out.awaitTermination(240)
        assert out.exception() is None and not out.isActive
    finally:
        spark.conf.set(store, before)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*locks.STEPS.names).collect())
    assert got == plainly(rows, 45 * S)


def test_paced_stream_equals_batch(spark, tmp_path):
    """Events out of order, in several batches, some twice: those let through are those of the batch form."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from pagetally.streaming import events

    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id"))) == 1
    rows = spark.read.parquet(f"{DIR}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").withColumn("final", last)
    own = sorted(rows.collect(), key=lambda r: r.t)
    rng, src = random.Random(2), tmp_path / "in"
    n = len(own) // 4 + 1
    for k in range(0, len(own), n):
        some = [tuple(r) for r in own[k : k + n]]
        some += rng.sample(some, 5)
        rng.shuffle(some)
        spark.createDataFrame(some, rows.schema).coalesce(1).write.mode("append").parquet(str(src))
    spark.createDataFrame([(-1, 5 * 10**15, -1, False)], rows.schema).coalesce(1).write.mode("append").parquet(str(src))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        out = events.paced_stream(stream, 12 * 3600, late="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        out.awaitTermination(240)
        assert out.exception() is None and not out.isActive
    finally:
        spark.conf.set(store, before)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, catalog.queries()["x05_rate_limit"](spark, DIR).collect()))
