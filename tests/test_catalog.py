import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagetally import catalog
from pagetally.operators import auditing, inference
from pagetally.operators.inference import PRODUCTION, REPLAYED, SPACE, Inference, Rules, autocorrelation_period, file_period, reinferred
from pagetally.plans.relations import TABLES, Session

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    try:
        return float(f"{float(v):.10g}")
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = duck.execute(catalog.oracle_sql()[name])
    at = [d[0] for d in out.description]
    assert sorted(at) == columns
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in out.fetchall()), key=repr)


def recover(curr, dom):
    """The cycle fill as a loop."""
    out = list(curr)
    for i, c in enumerate(curr):
        if c is None and dom:
            if i and out[i - 1] is not None:
                out[i] = out[i - 1] % dom + 1
            elif i + 1 < len(curr) and curr[i + 1] is not None:
                out[i] = (curr[i + 1] - 2) % dom + 1
    return out


def test_window_recovery_equals_loop(spark):
    queries = catalog.queries()
    reads, dom = {}, {r.pdf: r.dom for r in queries["a10_dominant_total"](spark, DIR).collect()}
    rows = queries["w01_gap_recovery"](spark, DIR).orderBy("pdf", "page").collect()
    for r in rows:
        reads.setdefault(r.pdf, []).append(r)
    for pdf, own in reads.items():
        assert [r.curr for r in own] == recover([r.curr if r.status == "direct" else None for r in own], dom.get(pdf))


def test_sequence_operators(spark):
    queries = catalog.queries()
    rows = lambda name: queries[name](spark, DIR).collect()
    reads = {}
    for r in spark_reads(spark):
        reads.setdefault(r.pdf, []).append(r)
    solved, settled = {}, {}
    for name, into in (("w11_gap_solver", solved), ("w16_inference", settled)):
        for r in rows(name):
            into.setdefault(r.pdf, {})[r.page] = r
    orphans = {(r.pdf, r.page) for r in rows("w12_orphan_candidates")}
    checked = {(r.pdf, r.page): r.confidence for r in rows("w13_cross_validation")}
    kept = {(r.pdf, r.page): r.method for r in rows("w18_orphan_suppression")}
    docs = {(r.pdf, r.doc): r["class"] for r in rows("a28_reliability")}
    for pdf, own in reads.items():
        x = Inference([r.curr for r in own], [r.total for r in own]).fill()
        assert [tuple(solved[pdf][r.page][c] for c in ("curr", "total", "method")) for r in own] == [(*p, k) for p, k in zip(x.pages, x.kinds)]
        assert {own[i].page for i in x.doubtful()} == {page for q, page in orphans if q == pdf}
        sure = list(x.cap().sure)
        assert [checked[pdf, r.page] for r in own] == pytest.approx(sure)
        x = Inference([r.curr for r in own], [r.total for r in own]).fill().settle()
        assert [(settled[pdf][r.page].curr, settled[pdf][r.page].method) for r in own] == [(p[0], k) for p, k in zip(x.pages, x.kinds)]
        assert {r.page for r, k in zip(own, x.kinds) if k == "excluded"} == {page for (q, page), k in kept.items() if q == pdf and k == "excluded"}
        doc, groups = 0, {}
        for (number, total), kind, sure in zip(x.pages, x.kinds, x.sure):
            if number is not None:
                doc += number == 1
                if doc:
                    groups.setdefault(doc, []).append((number, total, kind, sure))
        for doc, pages in groups.items():
            ordered = all(i == 0 or k == "inferred" or (n, t) == (i + 1, pages[0][1]) for i, (n, t, k, _) in enumerate(pages))
            guesses = [c for _, _, k, c in pages if k == "inferred"]
            want = "incomplete" if len(pages) != pages[0][1] or not ordered else "direct" if not guesses else "inferred_hi" if min(guesses) >= 0.75 else "inferred_lo"
            assert docs.pop((pdf, doc)) == want, (pdf, doc)
    assert not docs
    assert queries["w20_undercount_recovery"](spark, DIR).groupBy().sum("merged").first()[0] is not None
    docs = queries["w03_segmentation"](spark, DIR).count()
    assert sum(r.merged + 1 for r in rows("w20_undercount_recovery")) == docs
    assert queries["w21_min_gap"](spark, DIR).count() <= docs
    lag = {r.pdf: r.period for r in rows("w07_autocorrelation")}
    for pdf, own in reads.items():
        curr = np.array([np.nan if r.curr is None else r.curr for r in own])
        assert lag[pdf] == brute_lag(curr)


def spark_reads(spark):
    return Session(spark, DIR)["page_reads"].orderBy("pdf", "page").collect()


def brute_lag(curr):
    """The first peak of the autocorrelation, by the textbook."""
    known = np.flatnonzero(~np.isnan(curr))
    if len(curr) < 4 or len(known) < 6:
        return None
    x = np.interp(np.arange(len(curr)), known, curr[known])
    x = x - x.mean()
    if not (x * x).sum():
        return None
    r = np.correlate(x, x, "full")[len(x) - 1 :] / (x * x).sum()
    return next((k for k in range(2, min(len(x) // 2, 50)) if r[k] > 0.3 and r[k] > r[k - 1] and r[k] >= r[k + 1]), None)


def test_replayed_rules(spark):
    """Every parameter's every value once; the sets replayed equal single runs."""
    assert len(REPLAYED) == 1 + sum(len(v) for v in SPACE.values()) - len(SPACE) and len(SPACE) == 22
    assert all(getattr(PRODUCTION, k) in v for k, v in SPACE.items())
    rules = (PRODUCTION, Rules(), Rules(window=1, dropout=0.3))
    got = {r.config: r for r in inference.w27_rule_replay(Session(spark, DIR), rules).collect()}
    files = {}
    for r in spark_reads(spark):
        files.setdefault(r.pdf, []).append(r)
    for k, own in enumerate(rules):
        runs = [Inference([r.curr for r in f], [r.total for r in f], own).part_starts().drop_odd().fill().settle() for f in files.values()]
        assert got[k].files == len(files) and got[k].documents == sum(p[0] == 1 for x in runs for p in x.pages)
        assert got[k].excluded == sum(x.kinds.count("excluded") for x in runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(0, 5), st.none() | st.integers(1, 4)), max_size=30), st.integers(1, 4), st.lists(st.fixed_dictionaries({k: st.sampled_from(v) for k, v in SPACE.items()}), max_size=8))
def test_replays_of_a_file_equal_single_runs(odd, period, drawn):
    """Odd reads, and odd ones among regular ones; every set that is replayed, and any mixture of values."""
    regular = [(c, t) if i % 3 == 0 else (i % period + 1, period) for i, (c, t) in enumerate(odd)]
    rules = [*REPLAYED, *(Rules(**own) for own in drawn)]
    tree = inference.stepwise(enumerate(rules))
    for reads in (odd, regular):
        curr, total = [c for c, _ in reads], [None if c is None else t for c, t in reads]
        got = {k: (pages, kinds) for pages, kinds, own in inference.replayed(curr, total, tree) for k in own}
        runs = [Inference(curr, total, r).part_starts().drop_odd().fill().settle() for r in rules]
        assert got == {k: (x.pages, x.kinds) for k, x in enumerate(runs)}


def test_a_replay_passes_on_sums(spark):
    """One row a set of rules and batch, not one a file."""
    found = inference.w27_rule_replay(Session(spark, DIR), (PRODUCTION, Rules()))
    made = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in made and "files#" in made.partition("MapInArrow")[2]
    assert {r.config: r.files for r in found.collect()} == dict.fromkeys((0, 1), Session(spark, DIR)["true_counts"].count())


def test_dropped_reads_last_resorts_and_close_starts():
    curr, total = [1, 2, 3, 1, 2, 3, 1, 1, 2, 3, 1, 2, 3], [3] * 6 + [1] + [3] * 6
    x = Inference(curr, total, Rules(dropout=0.3)).drop_odd()
    assert x.kinds[6] == "failed" and x.kinds.count("failed") == 1
    assert Inference(curr, total).drop_odd().kinds.count("failed") == 0
    x = Inference([1, 2, None], [2, 2, None], Rules(last_resort=0.15)).last_resort()
    assert x.pages[2] == (1, 2) and x.sure[2] == 0.15
    cycle = [1, 2, 3, 4] * 6
    cycle[9] = 1  # right after the start at 8
    x = Inference(cycle, [4] * 24, Rules(least_gap=2)).part_starts()
    assert x.kinds[9] == "excluded" and x.kinds.count("excluded") == 1
    assert Inference(cycle, [4] * 24).part_starts().kinds.count("excluded") == 0


def test_reinference():
    curr, total = [1, 2, None, 2, 1, 2, 1, 2], [2, 2, None, 2, 2, 2, 2, 2]
    x = Inference(curr, total).fill().settle()
    page = list(range(1, 9))
    again = reinferred(page, x, {}, set())
    assert again.pages == x.pages and again.kinds == x.kinds
    fixed = reinferred(page, x, {3: (1, 2)}, {8})
    assert fixed.pages[2] == (1, 2) and fixed.kinds[2] == "manual" and fixed.sure[2] == 1.0
    assert fixed.pages[7] == (None, None) and fixed.kinds[7] == "excluded"


CELL = "hospital string, sigla string, user_override int, ocr_count int, filename_count int, reorg_delta int, worker_delta int, excluded boolean, note string, note_status string, confirmed boolean, worker_status string, confidence string, errors int, migrated boolean, method string"
FILE = "id bigint, hospital string, sigla string, file string, pages int, per_file int, override int, method string"
MARK = "id bigint, hospital string, sigla string, file string, page int, count int"


def month(spark, cells, files=(), marks=()):
    """A session whose cells, files and marks are these; cells: (sigla, values by name)."""
    names = [c.split()[0] for c in CELL.split(", ")]
    rows = [tuple({"hospital": "HPV", "sigla": sigla, "reorg_delta": 0, "worker_delta": 0, "excluded": False, "confirmed": False, "errors": 0, "migrated": True, **own}.get(n) for n in names) for sigla, own in cells]
    s = Session(spark, DIR)
    s.made["cells"] = spark.createDataFrame(rows, CELL)
    s.made["file_counts"] = spark.createDataFrame([(i, "HPV", *f) for i, f in enumerate(files)], FILE)
    s.made["marks"] = spark.createDataFrame([(i, "HPV", *m) for i, m in enumerate(marks)], MARK)
    for other in ("ops", "stored_suspects"):
        s.made[other] = Session(spark, DIR)[other].filter("false")
    return s


def test_cell_count_order(spark):
    cells = [("odi", {"user_override": 40, "ocr_count": 1}), ("irl", {"ocr_count": 6}), ("art", {"ocr_count": 0, "filename_count": 9}), ("ext", {"filename_count": 8}), ("exc", {}), ("bodega", {"filename_count": 3, "reorg_delta": -7}), ("maquinaria", {"ocr_count": 50, "reorg_delta": 2}), ("charla", {"user_override": 0, "reorg_delta": 4, "worker_delta": -9})]
    files = [("odi", "a", 3, 2, None, None), ("irl", "b", 3, 2, 5, None), ("irl", "c", 3, 4, None, None), ("irl", "d", 3, None, 1, None), ("irl", "e", 3, None, None, None), ("maquinaria", "m", 1, 9, None, None)]
    marks = [("maquinaria", "m", 1, 3), ("maquinaria", "m", 2, 4), ("maquinaria", "gone", 1, 90), ("charla", "m", 1, 5)]
    got = {r.sigla: (r["count"], r.workers) for r in month(spark, cells, files, marks)["cell_count"].collect()}
    assert got == {"odi": (40, 0), "irl": (10, 0), "art": (0, 0), "ext": (8, 0), "exc": (0, 0), "bodega": (0, 0), "maquinaria": (9, 7), "charla": (4, 0)}


def test_settled_and_ready(spark):
    cells = [("odi", {}), ("irl", {}), ("art", {}), ("ext", {"note_status": "por_resolver", "confirmed": True}), ("exc", {"confirmed": True}), ("maquinaria", {"worker_status": "terminado"}), ("altura", {"migrated": False, "confidence": "high"}), ("bodega", {"migrated": False, "confidence": "high"}), ("chps", {"method": "pagination"}), ("senal", {})]
    files = [("odi", "a", 1, 1, None, "filename_glob"), ("odi", "b", 4, 2, None, "ratio_n"), ("irl", "a", 2, 1, None, "filename_glob"), ("art", "a", 3, 2, None, "pagination"), ("ext", "a", 1, 1, None, "page_count_pure"), ("altura", "a", 3, 2, 2, "pagination"), ("bodega", "a", 3, 2, None, "pagination"), ("chps", "a", 1, 1, None, None), ("senal", "irl.pdf", 1, 1, None, "page_count_pure")]
    s = month(spark, cells, files)
    s.made["foreign_names"] = spark.createDataFrame([("senal", "HPV", "irl.pdf", "irl")], "host string, hospital string, name string, suggested string")
    for name, column, want in (
        ("settled_cells", "settled", {"odi": True, "irl": False, "art": False, "ext": False, "exc": False, "maquinaria": True, "altura": True, "bodega": False, "chps": False, "senal": True}),
        ("reliable_cells", "all_reliable", {"odi": True, "irl": False, "art": False, "ext": False, "exc": False, "maquinaria": True, "altura": True, "bodega": False, "chps": False, "senal": False}),
        ("ready_cells", "ready", {"odi": True, "irl": False, "art": False, "ext": False, "exc": True, "maquinaria": True, "altura": True, "bodega": False, "chps": False, "senal": False}),
    ):
        assert {r.sigla: r[column] for r in s[name].collect()} == want, name


def test_operation_ids_never_repeat(spark):
    s = Session(spark, DIR)
    s.made["ops"] = spark.range(1_000_050)
    ids = s.sql(auditing.OPERATORS["w26_op_ids"])
    assert ids.select("op_id").distinct().count() == 1_000_050
    assert {r.op_id for r in ids.filter("id in (0, 998, 999, 1000000)").collect()} == {"op_001", "op_999", "op_1000", "op_1000001"}


def test_period_and_gap_rules():
    cycle = np.array([1, 2, 3, np.nan, 2, 3, 1, 2, 3, 1, 2, 3], float)
    assert autocorrelation_period(cycle)[0] == 3
    assert autocorrelation_period(np.array([1.0, 1, 1, 1, 1]))[0] is None
    assert file_period([1, 2, 1, 2, 1, 2], [2] * 6)[0] == 2 and file_period([1, 2, 3], [3] * 3) == (None, 0.0, None)


def test_gap_cases():
    fill = lambda curr, total: Inference(curr, total).fill().pages
    assert fill([1, None, 3], [3, None, 3]) == [(1, 3), (2, 3), (3, 3)]
    assert fill([None, 2, 1, 2], [None, 2, 2, 2]) == [(1, 2), (2, 2), (1, 2), (2, 2)]
    assert fill([1, 2, 1, None], [2, 2, 2, None]) == [(1, 2), (2, 2), (1, 2), (2, 2)]
    assert fill([None, None], [None, None]) == [(1, 2), (2, 2)]
    assert Inference([], []).fill().settle().pages == []


def test_contradictions_and_doubtful_starts():
    curr, total = [1, 2] * 12, [2] * 24
    total[5] = 7
    x = Inference(curr, total).fill().settle()
    assert x.pages[5] == (2, 2) and x.kinds[5] == "inferred" and x.sure[5] == 0.5
    x = Inference([1, 2, 1, 2, None, 1, 2, 1, 2], [2, 2, 2, 2, None, 2, 2, 2, 2]).fill()
    assert x.pages[4] == (2, 2) and x.doubtful() == []  # a clash costs less than a total and a period unlike the file's
    x = Inference([1, 2, 1, 2, None, 1, 2, 1, 2], [2, 2, 2, 2, None, 2, 2, 2, 2], Rules(clash=9.0)).fill()
    assert x.pages[4] == (1, 1) and x.doubtful() == [4]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.integers(1, 4), max_size=30))
def test_inference_keeps_reads_and_fills_all(curr):
    total = [None if c is None else 4 for c in curr]
    x = Inference(curr, total).fill()
    assert all(p == (c, 4) for p, c in zip(x.pages, curr) if c is not None) and all(None not in p for p in x.pages)
    x.settle()
    assert all(0 <= c <= 1 for c in x.sure) and all((k == "excluded") == (p[0] is None) for k, p in zip(x.kinds, x.pages))


def test_streaming_forms(spark, tmp_path):
    from pagetally.streaming import events

    src = tmp_path / "in"
    spark.read.parquet(f"{DIR}/events.parquet").select("event_id", "user_id", "event_type", "value", spark_ts()).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    for name, df in (("leases", events.lease_windows(stream, "user_id")), ("once", events.deduplicated(stream, ["user_id", "event_type"], late="2 days"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = sorted((r.user_id, r.ts, r.event_id, r.event_type) for r in spark.read.parquet(str(src)).collect())
    end, leases = max(r[1] for r in rows), []
    for user, at, *_ in rows:
        if leases and leases[-1][0] == user and (at - leases[-1][2]).total_seconds() <= 45:
            leases[-1][2:] = [at, leases[-1][3] + 1]
        else:
            leases.append([user, at, at, 1])
    closed = sorted((u, a, n) for u, a, b, n in leases if (end - b).total_seconds() > 300 + 45)
    assert sorted((r.user_id, r.lease.start, r.beats) for r in spark.table("leases").collect()) == closed
    assert {(r.user_id, r.event_type) for r in spark.table("once").collect()} == {(u, k) for u, _, _, k in rows}


def spark_ts():
    from pyspark.sql import functions as F

    return F.col("ts").cast("timestamp").alias("ts")


def test_numbers_are_finite(spark):
    rows = catalog.queries()["a29_priors"](spark, DIR).collect()
    assert math.isclose(sum(r.p for r in rows), 1.0)


def test_retries_and_slots(spark):
    from pagetally.streaming.events import BatchSlot, Busy, retried

    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert retried(flaky, wait=0) == "done" and len(tries) == 3
    tries.clear()
    with pytest.raises(OSError):
        retried(flaky, times=1, wait=0)
    slot = BatchSlot(spark)
    with slot.run("one"), pytest.raises(Busy), slot.run("two"):
        pass
    with slot.run("three"):
        assert spark.range(3).count() == 3
    assert slot.running is None
