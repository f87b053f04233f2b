"""Who is present and who edits which cell: one rule, folded over each session's events in order.

A member joins or renews its lease by a heartbeat; a focus renews it too, but a focus before any heartbeat is ignored. A
lease that is not renewed for its life is gone, and so is who leaves. Who focuses a free cell edits it, later ones view;
nobody is dethroned. A session has one agent. It claims the cell that a member starts a scan on, unless somebody else
than that member edits it; the member's own hold is lent to it and given back at the scan's end, if the cell is free then.

In batch, sessions are sorted partitions that stream past the fold, which holds a session's live members only. As a
stream it is `transformWithState`: members and loans are state of the session's key, events wait in it until the
watermark has passed them, so order and repetition on the way do not matter, and event-time timers take away members whose
lease has ended. Both forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A lease's life, and what the agent is called.
LEASE_SECONDS = 45
AGENT = ("Agent", "#0ea5e9", "agent")
#: Users of a session; the first is the agent's id. Cells of a session.
SEATS = 16
CELLS = 5
#: The registered queries' life: events of the given tables are hours apart.
LIFE = 12 * 3600

#: Events as a session sees them. A scan is started and ended by the kinds `lend` and `unlend`.
PRESENCE = f"""
    SELECT CAST(floor(user_id / {SEATS}) AS BIGINT) AS session, user_id AS member, {{t}} AS t, event_id AS id,
      CASE event_type WHEN 'signup' THEN 'heartbeat' WHEN 'view' THEN 'focus' WHEN 'click' THEN CASE WHEN event_id % 10 = 0 THEN 'release' ELSE 'focus' END WHEN 'purchase' THEN 'lend'
        ELSE CASE event_id % 3 WHEN 0 THEN 'leave' WHEN 1 THEN 'heartbeat' ELSE 'unlend' END END AS kind,
      CASE WHEN event_type IN ('view', 'purchase') OR event_type = 'click' AND event_id % 10 <> 0 THEN event_id % {CELLS} END AS cell FROM {{events}}"""


@dataclass
class Member:
    expires: int
    kind: str = "human"
    cell: int | None = None
    editor: bool = True


class Room:
    """A session's members and loans. Times are microseconds."""

    def __init__(self, session: int, life: int, members: dict[int, Member] | None = None, loans: list[tuple[int, int]] | None = None):
        self.agent, self.life, self.members, self.loans = session * SEATS, life, members or {}, loans or []

    def purge(self, now: int) -> None:
        for k in [k for k, m in self.members.items() if m.expires <= now]:
            del self.members[k]

    def editor_of(self, cell: int | None, but: int | None = None) -> int | None:
        return next((k for k, m in self.members.items() if k != but and m.editor and m.cell == cell), None) if cell is not None else None

    def join(self, who: int, now: int) -> None:
        m = self.members.setdefault(who, Member(now, "agent" if who == self.agent else "human"))
        m.expires = now + self.life

    def focus(self, who: int, cell: int | None, now: int) -> None:
        if m := self.members.get(who):
            m.expires = now + self.life
            m.editor = self.editor_of(cell, who) is None
            m.cell = cell

    def lend(self, who: int, cell: int, now: int) -> str:
        holder = self.editor_of(cell, self.agent)
        if holder is not None and holder != who:
            return "skipped"
        if holder is not None:
            self.members[who].editor = False
            self.loans.append((cell, who))
        self.join(self.agent, now)
        self.focus(self.agent, cell, now)
        return "claimed" if holder is None else "lent"

    def give_back(self) -> str:
        was = self.members.pop(self.agent, None)
        for cell, who in self.loans:
            m = self.members.get(who)
            if m and m.cell == cell and self.editor_of(cell) is None:
                m.editor = True
        self.loans.clear()
        return "released" if was else "idle"

    def step(self, member: int, now: int, kind: str, cell: int | None) -> tuple:
        """What an event leaves: its member's cell and role (none if it is no member), what came of a scan's start or
        end, and who edits the event's cell."""
        self.purge(now)
        outcome = None
        if kind == "heartbeat":
            self.join(member, now)
        elif kind in ("focus", "release"):
            self.focus(member, cell, now)
        elif kind == "leave":
            self.members.pop(member, None)
        elif kind == "lend":
            outcome = self.lend(member, cell, now)
        elif kind == "unlend":
            outcome = self.give_back()
        m = self.members.get(member)
        return (m.cell, "editor" if m.editor else "viewer") + (outcome, self.editor_of(cell)) if m else (None, None, outcome, self.editor_of(cell))


def _schema(ddl: str) -> T.StructType:
    kinds = {"bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


STEPS = _schema("session bigint, member bigint, t bigint, id bigint, kind string, cell bigint, at bigint, role string, outcome string, holder bigint")
ROSTER = _schema("session bigint, member bigint, name string, color string, kind string, focused_cell bigint, mode string")
#: Six colours that members wear.
COLORS = ("#f97316", "#a855f7", "#22c55e", "#ec4899", "#eab308", "#14b8a6")


def _public(session: int, who: int, m: Member) -> tuple:
    """What others see of a member: an agent is always called alike."""
    name, color, kind = AGENT if m.kind == "agent" else (f"user {who}", COLORS[who % len(COLORS)], "human")
    return session, who, name, color, kind, m.cell, "editor" if m.editor else "viewer"


def _made(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)


def _folded(events: DataFrame, life: int, made: T.StructType, each, last) -> DataFrame:
    """Sorted sessions streamed past their rooms. each(event, left by it) and last(room, session, its last time) make rows."""
    out = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, room, at, rows = None, None, 0, []
        for b in batches:
            for e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if e[0] != now:
                    if room is not None:
                        rows += last(room, now, at)
                    now, room = e[0], Room(e[0], life)
                at = e[2]
                rows += each(e, room.step(e[1], *e[2:3], *e[4:]))
            if rows:
                yield _made(rows, out)
                rows = []
        if room is not None and (rows := last(room, now, at)):
            yield _made(rows, out)

    return events.repartition("session").sortWithinPartitions("session", "t", "id").mapInArrow(run, made)


def steps(events: DataFrame, life: int = LEASE_SECONDS * 1_000_000) -> DataFrame:
    """Each event with what it leaves. events: session, member, t (microseconds), id, kind, cell."""
    return _folded(events.select(*STEPS.names[:6]), life, STEPS, lambda e, left: [(*e, *left)], lambda room, session, at: [])


def snapshot(events: DataFrame, life: int = LEASE_SECONDS * 1_000_000) -> DataFrame:
    """Who is present in each session after its last event, as others see them."""
    return _folded(events.select(*STEPS.names[:6]), life, ROSTER, lambda e, left: [], lambda room, session, at: [_public(session, k, m) for k, m in room.members.items()])


_MEMBER = _schema("expires bigint, kind string, cell bigint, editor boolean")
_LOAN = _schema("cell bigint, member bigint")
_EVENT = T.StructType(STEPS.fields[1:6])


class SessionLocks(StatefulProcessor):
    """A session's room as state. Events wait until the watermark passes them; a timer then applies them in order."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", T.StructType([T.StructField("member", T.LongType())]), _MEMBER)
        self.loans = handle.getListState("loans", _LOAN)
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, times = [], set()
        for frame in rows:
            for r in frame[_EVENT.names].itertuples(index=False):
                held.append(tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r))
                times.add(held[-1][1] // 1000 + 1)
        self.waiting.appendList(held)
        for ms in times:
            self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted({tuple(e) for e in self.waiting.get()}, key=lambda e: (e[1], e[2]))
        due = [e for e in waiting if e[1] < now]
        session, before = int(key[0]), {k[0]: Member(*m) for k, m in self.members.iterator()}
        room = Room(session, self.life, dict(before), [tuple(x) for x in self.loans.get()])
        out = [(session, *e, *room.step(e[0], e[1], *e[3:])) for e in due]
        room.purge(now)
        for k in before.keys() - room.members.keys():
            self.members.removeKey((k,))
        for k, m in room.members.items():
            self.members.updateValue((k,), astuple(m))
            self.handle.registerTimer(m.expires // 1000 + 1)
        self._replace(self.loans, room.loans)
        if due:
            self._replace(self.waiting, [e for e in waiting if e[1] >= now])
            yield pd.DataFrame(out, columns=STEPS.names).astype({f.name: "Int64" for f in STEPS if isinstance(f.dataType, T.LongType)})

    @staticmethod
    def _replace(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def step_stream(events: DataFrame, life: int = LEASE_SECONDS * 1_000_000, late: str = "1 hour") -> DataFrame:
    """Streaming `steps`, emitted once the watermark has passed an event; repeated events count once. It needs the state
    store of spark.sql.streaming.stateStore.providerClass to be RocksDB's."""
    timed = events.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", late)
    return timed.groupBy("session").transformWithStateInPandas(SessionLocks(life), STEPS, "Append", "EventTime")


def _presence(s, kinds: str) -> DataFrame:
    text = PRESENCE.replace("{t}", "unix_micros(CAST(ts AS TIMESTAMP))").replace("{events}", "{e}")
    return s.spark.sql(f"SELECT * FROM ({text}) AS p WHERE kind {kinds} ('lend', 'unlend')", e=s["events"])


def x07_lock_claim(s, life: int = LIFE * 1_000_000) -> DataFrame:
    """Who edits and who views, after every event but scans."""
    return steps(_presence(s, "NOT IN"), life).select("id", "session", "member", F.col("at").alias("cell"), "role")


def x08_lock_lending(s, life: int = LIFE * 1_000_000) -> DataFrame:
    """What came of each scan's start and end, and who holds its cell, with all other events between."""
    text = PRESENCE.replace("{t}", "unix_micros(CAST(ts AS TIMESTAMP))").replace("{events}", "{e}")
    return steps(s.spark.sql(text, e=s["events"]), life).filter("outcome is not null").select("id", "session", "member", "kind", "cell", "outcome", "holder")


def x14_presence_snapshot(s, life: int = LIFE * 1_000_000) -> DataFrame:
    """Members of each session that are present after its last event, agents under their own name."""
    return snapshot(_presence(s, "NOT IN"), life)


OPERATORS = {f.__name__: f for f in (x07_lock_claim, x08_lock_lending, x14_presence_snapshot)}

# A member's presence is a run of its events with no gap of a lease's life and no leave between, from a heartbeat on; its
# stay at a cell ends by its next move, its leave or its lease. A cell's focuses are then taken one after the other.
_CLAIMS = f"""
  WITH RECURSIVE p AS (SELECT * FROM ({PRESENCE.replace("{t}", "epoch_us(ts)")}) AS p WHERE kind NOT IN ('lend', 'unlend')),
  g AS (SELECT *, lag(t) OVER w AS t0, lag(kind) OVER w AS kind0 FROM p WINDOW w AS (PARTITION BY member ORDER BY t, id)),
  s AS (SELECT *, sum(CASE WHEN t0 IS NULL OR t - t0 >= {LIFE}000000 OR kind0 = 'leave' THEN 1 ELSE 0 END) OVER (PARTITION BY member ORDER BY t, id) AS seg FROM g),
  a AS (SELECT *, kind <> 'leave' AND count(*) FILTER (WHERE kind = 'heartbeat') OVER (PARTITION BY member, seg ORDER BY t, id) > 0 AS live FROM s),
  m AS (SELECT member, seg, id, t, cell, lag(cell) OVER w AS cell0, row_number() OVER w AS k FROM a WHERE live AND kind IN ('focus', 'release') WINDOW w AS (PARTITION BY member, seg ORDER BY t, id)),
  y AS (SELECT *, sum(CASE WHEN k = 1 OR cell IS DISTINCT FROM cell0 THEN 1 ELSE 0 END) OVER (PARTITION BY member, seg ORDER BY t, id) AS stay FROM m),
  z AS (SELECT member, seg, max(t) AS last, bool_or(kind = 'leave') AS leaves, max(CASE WHEN kind = 'leave' THEN id END) AS leave_id FROM a GROUP BY member, seg),
  e AS (SELECT y.member, y.seg, y.stay, min(y.t) AS t, min(y.id) AS id, lead(min(y.t)) OVER w AS next_t, lead(arg_min(y.id, (y.t, y.id))) OVER w AS next_id FROM y GROUP BY y.member, y.seg, y.stay WINDOW w AS (PARTITION BY y.member, y.seg ORDER BY y.stay)),
  f AS (SELECT a.session, y.cell, y.member, y.t, y.id, y.seg, y.stay, coalesce(e.next_t, CASE WHEN z.leaves THEN z.last ELSE z.last + {LIFE}000000 END) AS end_t, coalesce(e.next_id, CASE WHEN z.leaves THEN z.leave_id ELSE -1 END) AS end_id,
      row_number() OVER (PARTITION BY a.session, y.cell ORDER BY y.t, y.id) AS n
    FROM y JOIN e ON e.member = y.member AND e.seg = y.seg AND e.stay = y.stay JOIN z ON z.member = y.member AND z.seg = y.seg JOIN a ON a.id = y.id WHERE y.cell IS NOT NULL),
  r AS (SELECT session, cell, n, id, 'editor' AS role, member AS who, seg AS in_seg, stay AS in_stay, end_t, end_id FROM f WHERE n = 1
    UNION ALL SELECT f.session, f.cell, f.n, f.id, CASE WHEN x.own OR x.free THEN 'editor' ELSE 'viewer' END, CASE WHEN x.free THEN f.member ELSE r.who END, CASE WHEN x.free THEN f.seg ELSE r.in_seg END,
        CASE WHEN x.free THEN f.stay ELSE r.in_stay END, CASE WHEN x.free THEN f.end_t ELSE r.end_t END, CASE WHEN x.free THEN f.end_id ELSE r.end_id END
      FROM r JOIN f ON f.session = r.session AND f.cell = r.cell AND f.n = r.n + 1,
        LATERAL (SELECT f.t > r.end_t OR f.t = r.end_t AND f.id > r.end_id AS free, f.member = r.who AND f.seg = r.in_seg AND f.stay = r.in_stay AS own) AS x),
  o AS (SELECT a.*, last_value(CASE WHEN a.live AND a.kind IN ('focus', 'release') THEN a.id END IGNORE NULLS) OVER (PARTITION BY a.member, a.seg ORDER BY a.t, a.id) AS placed FROM a),
  c AS (SELECT o.id, o.session, o.member, o.t, o.live, o.seg, CASE WHEN o.live THEN q.cell END AS cell, CASE WHEN o.live THEN coalesce(r.role, 'editor') END AS role
    FROM o LEFT JOIN a AS q ON q.id = o.placed LEFT JOIN r ON r.id = o.placed)"""
SQL = {
    "x07_lock_claim": f"SELECT id, session, member, cell, role FROM ({_CLAIMS} SELECT * FROM c) AS x",
    "x14_presence_snapshot": f"""
      SELECT session, member, CASE WHEN member % {SEATS} = 0 THEN '{AGENT[0]}' ELSE 'user ' || member END AS name, CASE WHEN member % {SEATS} = 0 THEN '{AGENT[1]}' ELSE CASE member % {len(COLORS)} {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(COLORS))} END END AS color,
        CASE WHEN member % {SEATS} = 0 THEN '{AGENT[2]}' ELSE 'human' END AS kind, cell AS focused_cell, role AS mode
      FROM ({_CLAIMS} SELECT *, row_number() OVER (PARTITION BY member ORDER BY t DESC, id DESC) AS back, max(t) OVER (PARTITION BY session) AS closing FROM c) AS x WHERE back = 1 AND live AND t + {LIFE}000000 > closing""",
}
