"""Gates and sums once more, in plain Python over the rows that they are made of: a second text beside the shared SQL."""

from collections import Counter, defaultdict

import pytest

from pagetally import catalog
from pagetally.plans.relations import Session

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def month(spark):
    s = Session(spark, DIR)
    rows = {n: s[n].collect() for n in ("cells", "dim_sigla", "dim_hospital", "file_counts", "marks", "ops", "rescans", "locked_cells", "config_counts", "true_counts", "open_suspects")}
    rows["files"] = defaultdict(list)
    for f in rows["file_counts"]:
        rows["files"][f.hospital, f.sigla].append(f)
    rows["type"] = {d.sigla: d.count_type for d in rows["dim_sigla"]}
    return rows


def got(spark, name):
    return catalog.queries()[name](spark, DIR).collect()


def marks_of(month, hospital, sigla, only=None):
    """Marks of a cell on files that are there; None if it was never marked."""
    names = {f.file for f in month["files"][hospital, sigla]}
    own = [m for m in month["marks"] if (m.hospital, m.sigla) == (hospital, sigla)]
    return [m for m in own if m.file in names and (only is None or only(m))], bool(own)


def base_count(month, c):
    if c.user_override is not None:
        return c.user_override
    marks, _ = marks_of(month, c.hospital, c.sigla)
    if month["type"][c.sigla] == "checks":
        return sum(m["count"] for m in marks)
    counted = [f.override if f.override is not None else f.per_file for f in month["files"][c.hospital, c.sigla]]
    counted = [n for n in counted if n is not None]
    if counted:
        return sum(counted)
    return next((n for n in (c.ocr_count, c.filename_count) if n is not None), 0)


def counts(month):
    out = {}
    for c in month["cells"]:
        marks, _ = marks_of(month, c.hospital, c.sigla)
        out[c.hospital, c.sigla] = max(0, base_count(month, c) + (c.reorg_delta or 0)), max(0, sum(m["count"] for m in marks) + (c.worker_delta or 0))
    return out


def test_cell_counts_and_enrichment(spark, month):
    want = counts(month)
    assert {(r.hospital, r.sigla): r.effective for r in got(spark, "a31_session_dump") if r.session_id == "2026-04"} == {k: v[0] for k, v in want.items()}
    suspects = defaultdict(list)
    for x in month["open_suspects"]:
        suspects[x.hospital, x.sigla].append(x)
    for r in got(spark, "p21_enriched_cells"):
        key, kind = (r.hospital, r.sigla), month["type"][r.sigla]
        assert r.worker_count == (want[key][1] if kind in ("documents_workers", "checks") else None)
        assert r.checks_count == (want[key][0] if kind == "checks" else None)
        own = suspects[key]
        assert (r.open_suspects, r.counted_suspects, r.first_id) == (len(own), sum(x.counted for x in own), min((x.suspect_id for x in own), default=None))


def test_worker_values_and_warnings(spark, month):
    want, values, warned = counts(month), {}, set()
    for c in month["cells"]:
        files = month["files"][c.hospital, c.sigla]
        scanned = any(f.per_file is not None for f in files)
        special = c.hospital == "HPV" and c.sigla == "dif_pts"
        if c.sigla in ("charla", "chintegral") and (marks_of(month, c.hospital, c.sigla)[1] or c.worker_status is not None):
            values[f"{c.hospital}_workers_{'chgen' if c.sigla == 'charla' else c.sigla}"] = want[c.hospital, c.sigla][1]
        if special:
            values["HPV_workers_difpts"] = want[c.hospital, c.sigla][1]
        if (c.sigla in ("charla", "chintegral") or special) and scanned and c.worker_status != "terminado":
            warned.add((c.hospital, c.sigla))
    assert {r.range_name: r.value for r in got(spark, "p19_worker_values")} == values and values
    assert {(r.hospital, r.sigla) for r in got(spark, "p19_worker_warnings")} == warned


def test_operations_are_checked(spark, month):
    files = {(f.hospital, f.sigla, f.file): f for f in month["file_counts"]}
    want, before = set(), defaultdict(list)
    for o in sorted(month["ops"], key=lambda o: o.id):
        say = lambda e: want.add((o.id, e))  # noqa: E731, B023
        f = files.get((o.src_hospital, o.src_sigla, o.file))
        if o.op_type not in ("move_file", "extract_pages", "split_in_place", "rotate"):
            say("op_type")
            continue
        moves, extracts, ranged = o.op_type == "move_file", o.op_type == "extract_pages", o.page_from is not None
        if (moves or extracts) and (o.src_hospital, o.src_sigla) == (o.dst_hospital, o.dst_sigla):
            say("same_cell")
        if f is None:
            say("missing_file")
        if moves and ranged:
            say("move_with_range")
        if extracts and not ranged:
            say("no_range")
        if extracts and ranged:
            if not 1 <= o.page_from <= o.page_to <= (f.pages if f else 0):
                say("out_of_bounds")
            if any(a <= o.page_to and o.page_from <= b for a, b in before[o.file]):
                say("overlap")
            if o.status == "pending":
                before[o.file].append((o.page_from, o.page_to))
        if o.rotation not in (0, 90, 180, 270):
            say("rotation")
        elif o.op_type == "rotate" and o.rotation == 0:
            say("no_rotation")
        if o.doc_count is not None:
            contribution = None if f is None else next((n for n in (f.override, f.per_file) if n is not None), 1)
            if o.doc_count < 0:
                say("negative_count")
            elif extracts and ranged and o.doc_count > o.page_to - o.page_from + 1:
                say("count_over_range")
            elif moves and contribution is not None and o.doc_count > contribution:
                say("count_over_file")
    rows = [(r.id, r.error) for r in got(spark, "p12_op_errors")]
    assert len(rows) == len(set(rows)) and set(rows) == want and len({e for _, e in want}) >= 9


def test_operations_defaults_status_and_deltas(spark, month):
    files = {(f.hospital, f.sigla, f.file): f for f in month["file_counts"]}
    marks = defaultdict(list)
    for m in month["marks"]:
        marks[m.hospital, m.sigla, m.file].append(m)
    defaults, status, deltas = {}, {}, Counter()
    for o in month["ops"]:
        key = o.src_hospital, o.src_sigla, o.file
        f = files.get(key)
        docs, workers = o.doc_count, 0
        if o.op_type == "move_file":
            docs = docs if docs is not None else next((n for n in (f and f.override, f and f.per_file) if n is not None), 1)
            workers = sum(m["count"] for m in marks[key])
        elif o.op_type == "extract_pages":
            docs = docs if docs is not None else 1
            workers = sum(m["count"] for m in marks[key] if o.page_from is not None and o.page_from <= m.page <= o.page_to)
        defaults[o.id] = docs if docs is not None else 0, workers
        status[o.id] = "applied" if o.status == "pending" and f is None else o.status
        if status[o.id] == "pending" and o.op_type in ("move_file", "extract_pages"):
            for cell, sign in (((o.src_hospital, o.src_sigla), -1), ((o.dst_hospital, o.dst_sigla), 1)):
                deltas[(*cell, "doc")] += sign * defaults[o.id][0]
                deltas[(*cell, "worker")] += sign * workers
    assert {r.id: (r.documents, r.workers) for r in got(spark, "f22_op_defaults")} == defaults
    assert {r.id: r.status for r in got(spark, "x11_applied_ops")} == status
    for r in got(spark, "a15_net_deltas"):
        assert (r.delta, r.worker_delta) == (deltas[r.hospital, r.sigla, "doc"], deltas[r.hospital, r.sigla, "worker"])


def test_single_file_rescans(spark, month):
    scans, locked = {r.id: r["count"] for r in month["rescans"]}, {(c.hospital, c.sigla) for c in month["locked_cells"]}
    seen = Counter()
    for r in got(spark, "x15_single_file_rescan"):
        f = next(x for x in month["files"][r.hospital, r.sigla] if x.id == r.id)
        want = "untouched" if r.id not in scans else "error" if f.pages == 0 else "locked" if (r.hospital, r.sigla) in locked else "done"
        seen[want] += 1
        assert r.outcome == want
        if want == "done":
            assert (r.per_file, r.method) == (scans[r.id], "pagination")
        else:  # what went wrong or is locked is not merged
            assert (r.per_file, r.method) == (f.per_file, f.method)
    assert seen["done"] and seen["untouched"]


def test_composite_scores(spark, month):
    truth = {t.pdf: t for t in month["true_counts"]}
    by = {(c.config, c.pdf): c for c in month["config_counts"]}
    ok = lambda c: c.documents == truth[c.pdf].documents and (c.pdf % 3 == 0 or c.complete == truth[c.pdf].complete)
    want = Counter()
    for (config, pdf), c in by.items():
        t, d = truth[pdf], abs(c.documents - truth[pdf].documents)
        if pdf % 3 == 0:
            want[config] += (5 if d == 0 else -3 * d) + (2 if c.complete >= t.complete else c.complete - t.complete)
        else:
            want[config] += (3 if d == 0 else -d) + (2 if d == 0 and c.complete == t.complete else 0) - abs(c.n_inferred - t.failed)
        if ok(by["direct", pdf]) and not ok(c):
            want[config] -= 5
    assert {r.config: r.composite for r in got(spark, "a25_composite_score")} == dict(want)
