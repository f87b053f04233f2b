"""Hard negatives, toxicity and phrases against brute force, closed cases and held-out labels."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.llm import negatives, phrases, toxicity

VECTORS = "vec_id bigint, embedding array<float>, label int, n bigint, score string, part string"


def whole(v, scale):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [max(-(1 << 63), min((1 << 63) - 1, math.floor(float(np.float32(x)) * scale))) for x in v]


def brute_negatives(rows, scale=256, k=5, low=80, high=100):
    rows = [(i, label, whole(v, scale)) for i, v, label in rows]
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    dot = lambda a, b: clip(sum(x * y for x, y in zip(a, b, strict=True)))
    out = []
    for i, label, v in {(r[0], r[1], tuple(r[2])): r for r in rows if r[0] % 10 == 0}.values():
        others = [(dot(v, w), j, other) for j, other, w in rows if j != i and len(w) == len(v)]
        best = sorted([x for x in others if x[2] == label], key=lambda x: (-x[0], x[1]))[:k]
        for p, j, _ in best:
            window = sorted([x for x in others if x[2] != label and low * p <= high * x[0] <= high * p], key=lambda x: (-x[0], x[1]))[:k]
            out += [(i, j, rank, n, p, s) for rank, (s, n, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], VECTORS)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


def vectors(seed, n=300, dims=6, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, dims))
    rows = [(i, [float(x) for x in centres[rng.integers(clusters)] + rng.normal(0, 0.1, dims)], int(rng.choice([1, 1, 1, 2, 3]))) for i in range(n)]
    rows += [(i, v, 4) for i, v, _ in rows[:20]]  # ids again, of another label
    rows += rows[30:40] * 3  # repeated rows
    return rows + [(n + i, list(rows[0][1]), 2) for i in range(15)]  # ties


@pytest.mark.parametrize("seed", range(2))
def test_hard_negatives_equal_brute_force(spark, seed):
    rows = vectors(seed)
    assert mined(spark, rows, block=40) == brute_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors(3, 60) + [(None, [0.1] * 6, 1), (70, None, 1), (80, [0.1] * 6, None), (90, [None] * 6, 1), (91, [float("nan")] * 6, 1), (92, [float("inf")] * 6, 1), (100, [1.0, 2.0], 1), (101, [1.0, 2.5], 1), (102, [0.9, 2.2], 2), (110, [], 1), (111, [], 1), (112, [], 2)]
    rows += [(120, [1e30] * 3, 1), (121, [2e30] * 3, 1), (122, [1e12, 1e12, 1e12], 2), (123, [-1e30] * 3, 2), (130, [4e6] * 4, 1), (131, [4e6, 4e6, 4e6, 3e6], 1), (132, [4e6, 4e6, 3.5e6, 3e6], 2)]
    got = mined(spark, rows, block=16)
    assert got == brute_negatives(rows) and {r[0] for r in got} >= {100, 110, 120, 130}
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 1)]) == []


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 200, (40, 16))
    rows = np.floor(centres[rng.integers(40, size=4000)] + rng.normal(0, 8, (4000, 16))).astype(np.int64)
    inner = np.quantile(rows[:500], np.arange(1, negatives.CELLS) / negatives.CELLS, axis=0, method="lower").T
    edges = np.hstack([rows.min(axis=0)[:, None], inner, rows.max(axis=0)[:, None]])
    block = negatives.Approximations(np.arange(4000), rows, edges)
    for i in range(0, 4000, 400):
        low, high = block.bounds(rows[i])
        exact = rows @ rows[i]
        assert (low <= exact).all() and (exact <= high).all()
        block.best(i, rows[i], 5)
        block.windows(i, rows[i], sorted(exact)[-7:-2], 5, (80, 100))
    assert block.scored < 0.25 * 2 * 10 * 4000


def mined_phrases(docs, least, longest=5, most=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        rows, long = [], [p for p, a in own.items() if len(p) > 1 and a >= least]
        inside = {p[i:j] for p in long for i in range(len(p)) for j in range(i + 1, len(p) + 1) if (i, j) != (0, len(p)) and own[p[i:j]] <= own[p]}
        for p in long:
            if p not in inside:
                score, k = min((1000 * own[p] * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -own[p], " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "c", "B", "é", "\x01", "x\x00", "a\x01", "long" * 5, "ñandú"]
    docs = []
    for _ in range(n):
        out = [rng.choice(words) if rng.random() < 0.6 else rng.choice(["of the", "of  the\tend", "of the end of the", "of the end , of"]) for _ in range(rng.choice([0, 1, 2, 5, 40, 120]))]
        docs.append(("".join(w + rng.choice([" ", " ", " ", ", ", "\n", "\t ", "? "]) for w in out), rng.choice(["en", "en", "fr", None, "und"])))
    return docs + [(None, "en"), ("", None), (" \t\n.", "de"), ("Only Once", "de")]


@pytest.mark.parametrize(("seed", "least", "longest", "most"), [(0, 5, 5, 2000), (1, 2, 5, 2000), (2, 3, 2, 40), (3, 4, 3, 7)])
def test_phrases_equal_brute_force(spark, seed, least, longest, most):
    docs = texts(seed)
    df = spark.createDataFrame([(t, g, 1, "w") for t, g in docs], "text string, lang string, n bigint, phrase string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least, longest, most).collect())
    assert got == mined_phrases(docs, least, longest, most) and len(got) > 5


def test_hot_beginnings_are_dealt_and_summed(spark):
    """Two words open nearly all suffixes, with many continuations; copies of a text; one very long text."""
    rng = random.Random(9)
    docs = [(" ".join(f"of the {rng.choice('abcdefghij')} {rng.choice('klmnop')}" for _ in range(80)), "en") for _ in range(40)] + [("again and again, of the same", "en")] * 50
    docs.append((" ".join(rng.choice(["of the end", "x y", "zz\n"]) for _ in range(200_000)), "en"))
    df = spark.createDataFrame(docs, "text string, lang string").repartition(6)
    got = sorted(tuple(r) for r in phrases.collocations(df, 30).collect())
    assert got == mined_phrases(docs, 30)


def test_suffixes_sent_do_not_outgrow_the_text(spark, monkeypatch):
    """Of five times the text nearly all pairs are frequent, but only the planted phrase is as a triple."""
    sent, count = [], phrases._count

    def counting(least, longest):
        sent.append(spark.sparkContext.accumulator(0))
        run, own = count(least, longest), sent[-1]

        def counted(batches):
            for b in batches:
                own.add(len(b))
                yield b

        return lambda batches: run(counted(batches))

    monkeypatch.setattr(phrases, "_count", counting)
    rng = random.Random(4)
    docs = [(" ".join(["p q r s t" if rng.random() < 0.02 else rng.choice("abcdefghijkl") for _ in range(100)]), "en") for _ in range(200)]
    for some in (docs[:40], docs):
        got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(some, "text string, lang string").repartition(2), 60).collect())
        assert got == mined_phrases(some, 60)
    assert 0 < sent[0].value and sent[1].value <= 12 * sent[0].value


def test_numbers_are_of_frequent_words_alone(spark):
    """A salt with which another word has a frequent word's hash is passed over."""
    words = spark.createDataFrame([("en", b"a", 9), ("en", b"b", 20), ("fr", b"a", 7), ("en", b"c", 1)], "lang string, word binary, n bigint")
    with pytest.MonkeyPatch.context() as m:
        plain = phrases._hash
        m.setattr(phrases, "_hash", lambda salt: F.when(F.lit(salt == 0) & (F.col("n") < 8), F.lit(5)).otherwise(F.when(F.lit(salt == 0) & (F.col("word") == b"b"), F.lit(5)).otherwise(plain(salt))))
        numbers = phrases._numbers(words, words.filter("n > 5")).value
    assert numbers.salt == 1
    codes = {lang: phrases._Codes(lang, numbers, numbers.bits(), []) for lang in ("en", "fr")}
    ids = {(lang, w): codes[lang].ids[codes[lang][w]] for lang in codes for w in (b"a", b"b", b"c")}
    assert ids == {("en", b"b"): 1, ("en", b"a"): 2, ("fr", b"a"): 3, ("en", b"c"): 0, ("fr", b"b"): 0, ("fr", b"c"): 0}


def test_phrases_of_nothing(spark):
    for docs in ([], [(None, None)], [("", "en"), (" . ", "en")]):
        assert phrases.collocations(spark.createDataFrame(docs, "text string, lang string")).collect() == []


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_007, 9_000_000_000_000, 3_000_000_011, 4_000_000_007)], "a bigint, n bigint, l bigint, r bigint")
    got = df.select(phrases._score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000 * 3_000_000_007 * 9_000_000_000_000 // (3_000_000_011 * 4_000_000_007)


def test_sections_keep_pieces_whole():
    rng = random.Random(2)
    text = b"".join(rng.choice([b"word ", b"w. ", b"x\n"]) for _ in range(700_000))
    assert len(list(phrases._sections(text))) > 1
    assert list(phrases.pieces(text)) == [w for p in phrases.BREAKS.split(text) if (w := p.split())]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    steps, first = rng.uniform(0.1, 2, (2, 2)), rng.uniform(0.1, 2, 2)
    sizes = [1, 5, 2, 8, 1, 3]
    e = rng.normal(0, 2, sum(sizes))
    starts = np.zeros(len(e), bool)
    starts[np.cumsum([0, *sizes[:-1]])] = True
    got = toxicity.marginals(*toxicity.messages(e, starts, steps, first))
    want, at = [], 0
    for n in sizes:
        total = np.zeros(n + 1)
        for y in itertools.product((0, 1), repeat=n):
            w = first[y[0]] * math.prod(steps[a, b] for a, b in itertools.pairwise(y)) * math.exp(sum(v * t for v, t in zip(e[at : at + n], y, strict=True)))
            total += w * np.array([*y, 1])
        want += (total[:-1] / total[-1]).tolist()
        at += n
    assert np.allclose(got, want)


def test_gradient_step_raises_the_likelihood():
    """Trained tags: a marked word is found again, in words never seen by its beginning."""
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["house", "tree", "walk", "blue", "river", "stone"]) + rng.choice("abc") for _ in range(30))
    bad = lambda: " ".join([*plain().split()[:15], "vilest" + rng.choice("abcdefgh"), *plain().split()[15:], "wretch"])
    data = [plain() for _ in range(200)] + [bad() for _ in range(60)]
    field = toxicity.fitted(data, [False] * 200 + [True] * 60, 60 / 260)
    memory = toxicity._Weighed(field.weights)
    clean, toxic = [plain() for _ in range(30)], [bad().replace("vilest", "vilestx") for _ in range(30)]
    score, spans = toxicity.scored(field, clean + toxic, memory)
    assert score[:30].max() < 0.3 < score[30:].min()
    assert all(not s for s in spans[:30]) and all("wretch" in {t[x["start"] : x["end"]] for x in s} for t, s in zip(toxic, spans[30:], strict=True))


def test_toxicity_of_documents(spark):
    rng = random.Random(6)
    plain = lambda n: " ".join(rng.choice(["uno", "dos", "tres", "cuatro", "cinco", "seis"]) + rng.choice("abc") for _ in range(n))
    docs = [(i, plain(20) + (" 😀 Idiota! " if i % 4 == 0 else " ") + plain(10), "x", 0.5) for i in range(240)]
    labels = [(i, int(i % 4 == 0), 1) for i in range(200)] + [(None, 1, 1), (7, None, 1), (9999, 1, 1), (0, 0, 1)]
    far = plain(300_000) + " idiota " + plain(3)
    odd = [(1000, None, "x", 0.5), (1001, "", None, None), (None, "idiota", "x", 0.5), (1002, far, "x", 0.1), (1003, "é" * 400_000, "x", 0.1), (4, docs[4][1], "x", 0.5), (1004, " \n!? ", "x", 0.2)]
    df = spark.createDataFrame(docs + odd, "doc_id bigint, text string, toxic string, score double")
    field = toxicity.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int"))
    got = toxicity.score_documents(df, field).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.toxic == (r.score >= 0.3) for r in got)
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 240)
    by = {r.doc_id: r for r in got}
    text = docs[8][1]
    assert [text[s.start : s.end] for s in by[8].spans] == ["Idiota"]
    assert [far[s.start : s.end] for s in by[1002].spans] == ["idiota"]
    assert by[1000].score == by[1001].score == by[1004].score and not by[1000].toxic and by[1000].spans == [] and by[1003].spans == []
    assert by[None].spans[0].start == 0 and len({r.score for r in got if r.doc_id == 4}) == 1
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score_documents(df, toxicity.fit(df, none)).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(df, toxicity.fit(df, spark.createDataFrame([(0, 1), (1, 1)], "doc_id bigint, toxic int"))).collect()} == {1.0}
    assert toxicity.score_documents(df.limit(0), field).collect() == []


def test_toxicity_on_held_out_labels(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in __spark_entry__.queries()["op12_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    english = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").collect()}
    held = [r for i, r in got.items() if r.held_out and i in labels]
    assert len(got) == 1000 and all(r.predicted == (r.score >= 0.3) for r in got.values())
    right = [labels[r.doc_id] == r.predicted for r in held if r.doc_id in english]
    assert sum(right) / len(right) > 0.95
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in held for b in held if labels[a.doc_id] > labels[b.doc_id]]
    assert sum(pairs) / len(pairs) > 0.85
