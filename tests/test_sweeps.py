"""The search over rules against a plain loop; texts' decomposition against Unicode's."""

import sys
import unicodedata
from collections import Counter, defaultdict

from pagetally import catalog
from pagetally.functions import text
from pagetally.operators import inference, sweeps
from pagetally.operators.inference import PRODUCTION, Inference
from pagetally.plans.relations import Session

DIR = "/root/testdata/sf0.001"


def test_draws_are_even_and_neighbours_one_step_away():
    values = sweeps.space()
    got = sweeps.drawn(values, 30)
    assert got == sweeps.drawn(values, 30) != sweeps.drawn(values, 30, seed=1) and len(got) == 30
    for k, own in enumerate(values.values()):
        n = Counter(c[k] for c in got)
        assert set(n) == set(range(len(own))) and max(n.values()) - min(n.values()) <= 1
    near = sweeps.neighbours(values, got[0])
    assert len(set(near)) == len(near) and all(sum(abs(a - b) for a, b in zip(got[0], x, strict=True)) == 1 for x in near)
    assert all(0 <= x < len(v) for c in near for x, v in zip(c, values.values(), strict=True))


def plainly(s, values, n, keep):
    files, truth = defaultdict(list), {r.pdf: r for r in s["true_counts"].collect()}
    for r in s["page_reads"].select("pdf", "page", "curr", "total").collect():
        files[r.pdf].append((r.page, r.curr, r.total))
    files = {k: list(zip(*sorted(v, key=lambda x: x[0]), strict=True)) for k, v in files.items()}

    def counted(rules, pdf):
        _, curr, total = files[pdf]
        x = Inference(curr, total, rules).part_starts().drop_odd().fill().settle()
        docs, now = [], None
        for (c, t), kind in zip(x.pages, x.kinds, strict=True):
            if c == 1:
                now = [(c, t, kind)]
                docs.append(now)
            elif c is not None and now is not None:
                now.append((c, t, kind))
        whole = [len(d) == d[0][1] and all(k == "inferred" or (c == i and t == d[0][1]) for i, (c, t, k) in enumerate(d, 1) if i > 1) for d in docs]
        return len(docs), sum(whole), x.kinds.count("inferred")

    def passes(pdf, got):
        t = truth[pdf]
        return got[0] == t.documents and (pdf % 3 == 0 or got[1] == t.complete)

    base = {pdf: passes(pdf, counted(PRODUCTION, pdf)) for pdf in files}

    def score(config):
        rules, composite, delta, lost = sweeps.rules(values, config), 0, 0, 0
        for pdf in files:
            t, (docs, complete, inferred) = truth[pdf], counted(rules, pdf)
            d = abs(docs - t.documents)
            if pdf % 3 == 0:
                composite += (5 if d == 0 else -3 * d) + (2 if complete >= t.complete else complete - t.complete)
            else:
                composite += (3 if d == 0 else -d) + (2 if d == 0 and complete == t.complete else 0) - abs(inferred - t.failed)
            if base[pdf] and not passes(pdf, (docs, complete, inferred)):
                composite, lost = composite - 5, lost + 1
            delta += d
        return composite, delta, lost

    found, todo = {}, sweeps.drawn(values, n)
    best = lambda k: sorted(found, key=lambda c: (-found[c][0], found[c][1], ",".join(map(str, c))))[:k]
    for k in [*keep, 0]:
        found |= {c: score(c) for c in todo if c not in found}
        todo = [x for b in best(k) for x in sweeps.neighbours(values, b)]
    return found, best


def test_a_search_equals_a_plain_loop(spark):
    s, values = Session(spark, DIR), sweeps.space(("start", "window", "least_start"))
    found, best = plainly(s, values, 4, (2, 1))
    scores = sweeps.searched(s, values, 4, (2, 1))
    rows = {tuple(map(int, r.config.split(","))): (r.composite, r.delta, r.regressions) for r in scores.collect()}
    assert rows == found and len(found) > 8
    assert [tuple(map(int, r.config.split(","))) for r in sweeps.top(scores, 5).collect()] == best(5)


def test_a_search_gathers_files_once(spark, monkeypatch):
    s, made = Session(spark, DIR), []
    whole = sweeps.gathered
    monkeypatch.setattr(sweeps, "gathered", lambda *x: made.append(1) or whole(*x))
    scores = sweeps.searched(s, sweeps.space(("start", "window")), 3, (1, 1))
    assert made == [1] and scores.select("round").distinct().count() == 3
    files = {r.pdf: (r.true_documents, r.true_complete, r.true_inferred) for r in sweeps.with_truth(s).collect()}
    assert files == {r.pdf: (r.documents, r.complete, r.failed) for r in s["true_counts"].collect()}


def test_configurations_of_a_file_share_their_steps(monkeypatch):
    """Its period is found once a file, not once a configuration."""
    made, whole = [], inference.file_period
    monkeypatch.setattr(inference, "file_period", lambda *x: made.append(1) or whole(*x))
    values = sweeps.space()
    rules = [sweeps.rules(values, c) for c in sweeps.drawn(values, 20)]
    curr, total = [1, None, 3, 1, 2, None, None, 2, 3], [3, None, 3, 3, 4, None, None, 3, 3]
    got = {k: sweeps.outcome(pages, kinds) for pages, kinds, own in inference.replayed(curr, total, inference.stepwise(enumerate(rules))) for k in own}
    assert made == [1] and set(got) == set(range(20))


def test_the_registered_search_is_a_whole_sweep(spark):
    """All parameters, 500 configurations, and every step away from the best 20 and then the best 5 of all."""
    values = dict(inference.SPACE)
    scores = [(tuple(map(int, r.config.split(","))), r) for r in sweeps._search(Session(spark, DIR)).collect()]
    rounds, best = defaultdict(list), lambda k, n: [c for c, r in sorted(scores, key=lambda x: (-x[1].composite, x[1].delta, x[1].config)) if r.round <= k][:n]
    for config, r in scores:
        rounds[r.round].append(config)
    assert len(rounds[0]) == 500 and set(rounds[0]) == set(sweeps.drawn(values, 500)) and all(len(c) == 22 for c in rounds[0])
    assert len(set().union(*rounds.values())) == len(scores)
    for k, n in ((0, 20), (1, 5)):
        done = set().union(*(rounds[j] for j in range(k + 1)))
        assert set(rounds[k + 1]) == {x for c in best(k, n) for x in sweeps.neighbours(values, c)} - done


def test_neighbours_of_the_best(spark):
    values = sweeps.space()
    s = Session(spark, DIR)
    best = [tuple(map(int, r.config.split(","))) for r in sweeps.top(sweeps._search(s), sweeps.SECOND).collect()]
    got = {r.config for r in catalog.queries()["t09_neighbour_configs"](spark, DIR).collect()}
    assert got == {",".join(map(str, x)) for b in best for x in sweeps.neighbours(values, b)}


def test_every_code_point_is_decomposed(spark):
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    table = text.decompositions()
    assert all(c.translate(table) == plain(c) for c in chars)
    rows = [(i, "".join(chars[i : i + 997])) for i in range(0x80, len(chars), 997)] + [(-1, None), (-2, ""), (-3, "Ça_va /- ﬁn½  Ａ"), (-4, "각 é/é")]
    got = {r.id: r.text for r in text.normalised(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got[-1] is None and got[-2] == "" and got[-3] == "ca va fin1⁄2 a" and got[-4] == plain("각") + " e e"
    assert all(got[i] == __import__("re").sub(r"[ \t\n\r]+", " ", __import__("re").sub(r"[/_-]+", " ", plain(t).lower())).strip(" ") for i, t in rows if i >= 0)
