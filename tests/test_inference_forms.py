"""Relational forms of inference's rules against the class that weighs a file's pages in order."""

import random
from collections import Counter, defaultdict

import pytest

from pagetally.operators import inference
from pagetally.operators.inference import PRODUCTION, Inference, Rules
from pagetally.plans.relations import Session

DIR = "/root/testdata/sf0.001"
READS = "pdf bigint, page int, curr int, total int, partkey bigint, suppkey bigint, period int, true_curr int, code string, method string, confidence double"


def made(seed, files=60):
    """Files of one period, with reads that fail, contradict, or start too early."""
    rng = random.Random(seed)
    rows = []
    for pdf in range(files):
        period, bad = rng.choice([1, 2, 3, 4, 6, 9]), rng.choice([0.0, 0.05, 0.3])
        for page in range(1, rng.choice([1, 3, 8, 30, 70])):
            curr, total = (page - 1) % period + 1, period
            if rng.random() < rng.choice([0.1, 0.4, 0.9]):
                curr = total = None
            elif rng.random() < bad:
                curr, total = rng.choice([(1, 1), (1, period), (rng.randint(1, 12), period + rng.choice([-1, 1, 3])), (curr, total + 1)])
            rows.append((pdf, page, curr, total, page, page, period, (page - 1) % period + 1, None, "failed" if curr is None else "direct", 0.0))
    return rows


@pytest.fixture(scope="module", params=["tables", 0, 1])
def case(request, spark):
    s = Session(spark, DIR, inference.FRAMES)
    if request.param != "tables":
        s.made["page_reads"] = spark.createDataFrame(made(request.param), READS)
    files = defaultdict(list)
    for r in s["page_reads"].select("pdf", "page", "curr", "total").collect():
        files[r.pdf].append((r.page, r.curr, r.total))
    return s, {k: tuple(zip(*sorted(v, key=lambda x: x[0]), strict=True)) for k, v in files.items()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fallback_fill(case):
    s, files = case
    want = []
    for pdf, (page, curr, total) in files.items():
        x = Inference(curr, total, Rules(last_resort=0.15)).last_resort()
        want += [(pdf, p, *x.pages[i], x.kinds[i], x.sure[i]) for i, p in enumerate(page)]
    assert rows(inference.w14_fallback_fill(s)) == sorted(want, key=repr)


def test_period_evidence(case):
    s, files = case
    got = {r[:4]: r[4] for r in map(tuple, inference.w15_period_evidence(s).collect())}
    want = {}
    for pdf, (page, curr, total) in files.items():
        x = Inference(curr, total).fill()
        for i, kind in enumerate(x.kinds):
            if kind == "inferred" and x.period:
                want |= {(pdf, page[i], *k): w for k, w in x.evidence(i).items()}
    assert got.keys() == want.keys() and len(want) > 20 and all(got[k] == pytest.approx(w, abs=2e-9) for k, w in want.items())


def test_contradictions(case):
    s, files = case
    want = []
    for pdf, (page, curr, total) in files.items():
        x = Inference(curr, total).fill()
        before = list(x.pages)
        if x.period is not None and round(x.period_sure, 9) >= 0.5 and x.expected is not None:
            x._overrule(x.expected)
        want += [(pdf, p, *was, *now) for p, was, now in zip(page, before, x.pages, strict=True) if was != now]
    assert rows(inference.w17_contradictions(s)) == sorted(want, key=repr)


def test_starts_apart(case):
    s, files = case
    for gap in (2, 3):
        want = []
        for pdf, (page, curr, total) in files.items():
            x = Inference(curr, total, Rules(least_gap=gap)).part_starts()
            want += [(pdf, p, x.pages[i][0] == 1) for i, p in enumerate(page) if curr[i] == 1]
        assert rows(inference.w21_min_gap(s, gap)) == sorted(want, key=repr)


def test_dropped_reads(case):
    s, files = case
    want = []
    for pdf, (page, curr, total) in files.items():
        x = Inference(curr, total, Rules(dropout=0.30, agreement=0.60)).drop_odd()
        want += [(pdf, p, round(x.sure[i], 9), x.kinds[i]) for i, p in enumerate(page) if total[i] == 1]
    assert rows(inference.w19_anomaly_dropout(s)) == sorted(want, key=repr)


def test_telemetry(case):
    s, files = case
    got = {r.pdf: r for r in inference.a27_telemetry(s).collect()}
    assert got.keys() == files.keys()
    for pdf, (_, curr, total) in files.items():
        x, docs = Inference(curr, total).fill().settle(), []
        for (number, whole), kind in zip(x.pages, x.kinds, strict=True):
            if number == 1:
                docs.append([(number, whole, kind)])
            elif number is not None and docs:
                docs[-1].append((number, whole, kind))
        ordered = [all(i == 1 or k == "inferred" or (n == i and t == d[0][1]) for i, (n, t, k) in enumerate(d, 1)) for d in docs]
        full = [o and len(d) == d[0][1] for o, d in zip(ordered, docs, strict=True)]
        r, kinds = got[pdf], Counter(x.kinds)
        assert (r.documents, r.complete, r.out_of_order, r.undercounted) == (len(docs), sum(full), ordered.count(False), sum(o and not f for o, f in zip(ordered, full, strict=True)))
        assert r.sizes == " ".join(f"{k}p:{n}" for k, n in sorted(Counter(d[0][1] for d in docs).items()))
        assert (r.direct, r.inferred, r.excluded, r.failed) == tuple(kinds[k] for k in ("direct", "inferred", "excluded", "failed"))
        assert (r.period, r.expected_total) == (x.period, x.expected)


def test_production_keeps_its_gap():
    assert PRODUCTION.least_gap == 2
