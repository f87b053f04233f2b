import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetally.llm import components, fingerprint, jaccard, mixing, topk, warc
from pagetally.llm.common import scratch

DOCS = "doc_id bigint, text string, n_shingles int, source string"


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def brute(rows, n, num, den):
    least, component = {}, brute_components(rows, n, num, den)
    for c, (d, _) in zip(component, rows, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    sets = [shingles(t, n) for _, t in rows]
    return sorted(((d, len(s), least.get(c) if s else d) for c, (d, _), s in zip(component, rows, sets, strict=True)), key=repr)


def near_copies(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(30))
    rows, bases = [], [[word() for _ in range(rng.choice([3, 5, 9, 20, 40, 90, 250]))] for _ in range(n // 6)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w[at:at] = [word()]
            elif at < len(w) and len(w) > 1:
                del w[at]
        text = " ".join(w) + (f" {passage}" if rng.random() < 0.3 else "")
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE\t"), (905, "one two"), (None, "one two"), (3, rows[3][1]), (906, "é É"), (907, "é é")]


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 4, 85), (2, 5, 80), (3, 4, 85), (4, 2, 50)])
def test_jaccard_components_equal_brute_force(spark, seed, n, num):
    rows = near_copies(seed)
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], DOCS).repartition(5)
    got = jaccard.jaccard_components(df, n=n, num=num, block=8 if seed == 3 else jaccard.BLOCK)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, n, num, 100)


def test_low_bounds_reach_all_size_classes(spark):
    """At 30 of 100 linked sets may be two size classes apart."""
    rng = random.Random(6)
    rows = []
    for i in range(40):
        words = [f"{i}x{rng.random():.6f}" for _ in range(33)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(rng.sample(words, 10)))]
    got = jaccard.jaccard_components(spark.createDataFrame([(*r, 7, "s") for r in rows], DOCS), n=1, num=30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 1, 30, 100)


def test_chains_are_multiplied_by_star(spark, monkeypatch):
    """A long chain of weak links is one component, but few of its blocks share a key."""
    words = [f"w{i}" for i in range(1900)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 24])) for i in range(600)] + [(1000 + i, words[i] + " unlike") for i in range(9)]
    asked = []
    real = jaccard._groups
    monkeypatch.setattr(jaccard, "_groups", lambda *a: asked.append(real(*a)) or asked[-1])
    got = jaccard.jaccard_components(spark.createDataFrame([(*r, 7, "s") for r in rows], DOCS), n=1, num=60, block=8)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 1, 60, 100)
    assert asked[0].filter("exists(groups, g -> g.star <> cluster)").count() > 0


def test_long_regular_words_have_different_names():
    """Thue-Morse words collide under any polynomial modulo 2^64."""
    import pyarrow as pa

    bit = lambda i, flip: "ab"[(i.bit_count() + flip) % 2]
    one, two = ("".join(bit(i, flip) for i in range(4096)) for flip in (0, 1))
    sets, sizes = jaccard.shingle_sets(pa.array([one, two, one.upper()]), 4)
    assert sizes.tolist() == [1, 1, 1] and sets[0] != sets[1]
    assert sets[0] == sets[2]


def test_one_of_each(spark):
    """Of each component one row stays: the smallest id, a null id only if all are null; rows without words stay."""
    rows = near_copies(5, 40) + [(None, rows_text) for rows_text in ("only nulls here", "only nulls here")] + [(None, None), (7000, "seven thousand is unlike"), (7000, "a repeated id of another text"), (7000, "a repeated id of another text")]
    df = spark.createDataFrame([(*r, 7, "s") for r in rows], DOCS)
    df = df.withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("none", F.lit(0)).withColumn("text_hash", F.lit(2)).withColumn("component", F.lit(3))
    kept = jaccard.one_of_each(df, n=4, num=85)
    assert kept.columns == df.columns
    sets = [shingles(t, 4) for _, t in rows]
    want = Counter()
    component = brute_components(rows, 4, 85, 100)
    for root in set(component):
        own = [i for i, r in enumerate(component) if r == root]
        if not sets[own[0]]:
            want.update(rows[i][0] for i in own)
        else:
            want[min((rows[i][0] is None, rows[i][0] or 0) for i in own)[1] if any(rows[i][0] is not None for i in own) else None] += 1
    got = kept.collect()
    assert Counter(r.doc_id for r in got) == want
    assert sum(r.doc_id == 7000 for r in got) == 2
    assert jaccard.one_of_each(df.filter("false")).collect() == []


def test_jaccard_edges(spark, monkeypatch):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    import pyarrow as pa

    text = pa.array([" ".join(f"w{i * i % 977}" for i in range(3000)), "short one"])
    whole = jaccard.shingle_sets(text, 4)
    monkeypatch.setattr(jaccard, "CHUNK", 500)
    assert all((a == b).all() for a, b in zip(whole, jaccard.shingle_sets(text, 4), strict=True))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300) if i % 100 != 99] + [(500, 500), (7, 3), (3, 7)]
    got = components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), "u", "v").collect()
    assert len({r.component for r in got}) == 3 and len(got) == 300 + 1 - (1 if not any(r.node == 300 for r in got) else 0)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6).round(1)], 1) for i in range(400)]
    rows += [(400, None, 1), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (404, [1.0, 2.0], 1), (500, rows[7][1], 1), (None, rows[8][1], 1), (0, rows[0][1], 1), (600, [1e30] * 6, 1), (700, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=4, shard=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    low, top = -(1 << 63), (1 << 63) - 1
    whole = [(i, [max(low, min(top, int(np.floor(1024 * x)))) for x in v]) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for q in {i for i, _ in whole if i % 50 == 0}:
        v = next(v for i, v in whole if i == q)
        found = sorted((-max(low, min(top, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole if i != q and len(w) == len(v))[:4]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(found)], q
    assert topk.top_k(df.filter("false"), F.lit(True)).collect() == []


def test_top_k_prunes_shards(spark, monkeypatch):
    """Vectors in far clusters: queries go to few shards; crowded and equal vectors are split; results are whole."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 8)) * 20
    rows = [(int(i), [float(x) for x in (middles[i % 12] + rng.normal(size=8))]) for i in range(2400)] + [(5000 + i, [1.0] * 8) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    asked = []
    real = topk._reached

    def counted(balls):
        asked.append(sum(len(s) for s, _, _ in balls.value.values()))
        return real(balls)

    monkeypatch.setattr(topk, "_reached", counted)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=10, shard=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert asked[0] >= 33
    x = np.array([np.floor(1024 * np.array(np.float32(v), np.float64)) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    for q in range(0, 5900, 100):
        if q in ids:
            score = x @ x[ids.tolist().index(q)]
            best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)[:10]
            assert sorted(got[q]) == [(n + 1, i, int(-s)) for n, (s, i) in enumerate(best)], q
    placed = topk._placed(df.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda c: F.floor(c * 1024).cast("bigint")).alias("v"), F.lit(True).alias("asks"), F.lit(8).alias("dim")), 100)
    assert placed.groupBy("shard").count().agg(F.max("count")).first()[0] <= 300


def test_fingerprints(spark):
    body = [f"Line {i} of some text, with clause {i}; and number {i * i}." for i in range(40)]
    shuffled = body[:]
    random.Random(1).shuffle(shuffled)
    rows = [(5, "\n".join(body)), (9, "\n".join(shuffled)), (7, None), (8, ""), (12, "x"), (13, "ü🎉" * 9), (None, "last, really"), (20, "other words here.\n" * 30), (21, "\n".join(f"Quite another {i}." for i in range(60))), (9, "same id")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, n_chars int, k string").repartition(3)
    got = fingerprint.fingerprint_documents(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 4
        r = by[d, len(t)]
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    one, two = by[5, len("\n".join(body))], by[9, len("\n".join(body))]
    assert one.fingerprint == two.fingerprint  # order does not matter
    assert 0.5 < one.near_edited < 0.95 and by[7, 0].near_next == 1.0 and by[21, len(rows[8][1])].near_next < 0.4
    alone = fingerprint.fingerprint_documents(df.filter("doc_id = 13")).first()
    assert alone.near_next == 1.0 and fingerprint.fingerprint_documents(df.filter("false")).collect() == []


def test_fingerprint_updates(spark):
    v = fingerprint.fingerprint_vector
    df = spark.createDataFrame([("a, b.\nc", "c\nd e", "a, b.\nc\nc\nd e")], "x string, y string, xy string").select(v("x").alias("x"), v("y").alias("y"), v("xy").alias("xy"))
    row = df.select(fingerprint.added("x", "y").alias("sum"), "xy", fingerprint.removed("xy", "y").alias("rest"), "x", fingerprint.likeness("x", "xy").alias("l")).first()
    assert row.sum == row.xy and row.rest == row.x and row.x != row.xy and 0 < row.l < 1


def test_fingerprint_counters_hold_more_than_a_million_pieces(spark):
    """Doubling a vector counts as many pieces as a long text has; one more piece hardly changes it."""
    v = fingerprint.fingerprint_vector
    df = spark.createDataFrame([("a line", "another one")], "x string, y string").select(v("x").alias("one"), v("y").alias("other")).withColumn("v", F.col("one"))
    for _ in range(24):
        df = df.withColumn("v", fingerprint.added("v", "v"))
        df = spark.createDataFrame(df.collect(), df.schema)
    row = df.withColumn("more", fingerprint.added("v", "other")).select(F.col("v")[0].alias("n"), fingerprint.likeness("v", "more").alias("near"), fingerprint.likeness("v", "one").alias("far"), fingerprint.removed("more", "v").alias("rest"), "other").first()
    assert row.n == 1 << 24 and row.near > 0.9999 and row.far < 0.01 and row.rest == row.other


def test_fingerprint_of_many_pieces_is_summed_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(f"{'same. ' * 7}\n" + "".join(f"{i}, " for i in range(n)),) for n in (0, 1, 2, 3, 8)] + [("",), (None,)], "x string")
    whole = df.select(fingerprint.fingerprint_vector("coalesce(x, '')").alias("v")).collect()
    monkeypatch.setattr(fingerprint, "SOME", 3)
    assert df.select(fingerprint.fingerprint_vector("coalesce(x, '')").alias("v")).collect() == whole
    assert whole[4].v[0] == 15 and whole[5].v == [0] * fingerprint.WIDTH


def test_fingerprint_likeness_follows_the_pieces(spark):
    """An edit of a quarter of many pieces leaves about three quarters alike; unlike texts are not alike."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, ". ".join(f"{word()} {word()}" for _ in range(rng.randint(40, 160)))) for i in range(80)] + [(900, "。".join(word() for _ in range(80)))]
    got = fingerprint.fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    near = sorted(r.near_edited for r in got)
    assert 0.65 < near[len(near) // 2] < 0.85 and near[0] > 0.45
    assert max(r.near_next for r in got) < 0.3


def fill(sizes, weights, total, most):
    """Water-filling by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), total * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        for s in free:
            target[s] = left * w[s] / sum(w[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
            capped.add(s)
            left -= target[s]


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), rng.choice(["a"] * 8 + ["b", "é", "c", None, "tiny"])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "void"), (None, "no id", "b"), (None, "no id", "b"), (5, "twice this", "a")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, source string, taken int").repartition(4)
    quality = mixing.quality_weights(spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id bigint, quality int"))
    plan = mixing.mix_documents(df, quality)
    got = plan.drop("text_hash").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = fill(sizes, (5, 2, 1), 1.5, 2.0)
    by_size = {v: k for k, v in sizes.items()}
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, mixing.mix_documents(df.repartition(7), quality).collect()), key=repr) == sorted(map(tuple, plan.collect()), key=repr)
    mix = mixing.mixed(df, plan).collect()
    assert abs(sum(len((r.text or "").split()) for r in mix) - sum(r.taken for r in got)) <= 1
    assert mixing.mix_documents(df.filter("false"), quality).collect() == []


def test_heavier_documents_come_first(spark):
    rows = [(i, "w " * 10, "a" if i < 4000 else "z") for i in range(4400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    quality = spark.createDataFrame([(i, 4.0) for i in range(0, 4000, 2)], "doc_id bigint, weight double")
    got = mixing.mix_documents(df, quality, weights=(1, 1), total=0.5, most=2.0).filter("doc_id < 4000").collect()
    share = [sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert share[0] > 1.5 * share[1] > 0


def test_warc_round_trip(spark):
    trap = "<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n" + "x" * 1500
    same, short = "é" * 600, "same"
    rows = [(1, "http://a", same), (2, "http://b\r\nX: y", same), (3, None, None), (4, "u", ""), (5, "u", short), (6, "u", short), (7, "u", trap), (8, "u", trap), (9, "u", "WARC/1.1\r\n"), (None, "u", same), (10, "u", "\r\n\r\n"), (2, "http://b", same), (11, "u", "long" * 200_000)]
    rows += [(100 + i, "u", f"page {i} WARC/1.1\r\n" * (i % 4)) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_type string").repartition(2)
    path = scratch(spark, "t8")
    warc.write_archives(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = Counter((i, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), "revisit" if (t == same and i != 2) or (t == trap and i == 7) else "response", 2 if t == same and i != 2 else 8 if t == trap and i == 7 else None) for i, _, t in rows)
    try:
        for size, most in (("64m", warc.MOST_SPLITS), ("3k", warc.MOST_SPLITS), ("3k", 0)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = Counter(map(tuple, warc.page_records(warc.read_archives(spark, path, most)).collect()))
            assert got == want, (size, most)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    empty = scratch(spark, "t8e")
    warc.write_archives(df.filter("false"), empty)
    assert warc.page_records(warc.read_archives(spark, empty)).collect() == []


def test_warc_versions_compression_and_damage(spark, tmp_path):
    record = lambda version, body: f"WARC/1.{version}\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{len(body)}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    whole = record(0, "a") + record(1, "WARC/1.0\r\n\r\nbb") + record(0, "") + record(1, "x WARC/1.2\r\n" * 50)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(whole)
    (tmp_path / "zipped").mkdir()
    import gzip

    (tmp_path / "zipped" / "a.warc.gz").write_bytes(gzip.compress(whole[:60]) + gzip.compress(whole[60:]))
    want = ["", "WARC/1.0\r\n\r\nbb", "a", "x WARC/1.2\r\n" * 50]
    for folder in ("plain", "zipped"):
        got = warc.read_archives(spark, str(tmp_path / folder)).collect()
        assert sorted(bytes(r.payload).decode() for r in got) == want
    for name, raw in (("cut", whole[:-9]), ("gap", record(1, "a") + b"??" + record(1, "b"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(raw)
        with pytest.raises(Exception, match="is damaged"):
            warc.read_archives(spark, str(tmp_path / name)).collect()
    assert [bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "gap"), damaged="skip").collect()] == [b"a"]
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 40) for i in range(30)] + [(None, "u", "n"), (None, "v", "n")], "page_id bigint, url string, html string")
    path = scratch(spark, "t8z")
    warc.write_archives(pages, path, compression="gzip")
    back = warc.read_archives(spark, path)
    assert back.select("record_id").distinct().count() == 32
    assert sorted(r.page_id for r in warc.page_records(back).filter("page_id is not null").collect()) == list(range(30))


def test_reachable():
    offsets, lengths = np.array([0, 4, 10, 13, 30]), np.array([10, 9, 20, 17, 99])
    assert warc.reachable(offsets, lengths, 200).tolist() == [True, False, True, False, True]
    assert warc.reachable(offsets, lengths, 100).tolist() == [True, False, True, False, False]
    assert warc.reachable(np.array([3]), np.array([5]), 8).tolist() == [False]


def test_warc_pieces_are_joined(spark):
    """Records whose pieces lie in several splits, out of order and in several batches."""
    parts = {("a", 0): [b"x" * 10, b"", b"yz"], ("a", 7): [b"\x00\xff" * 70_000, b"q"], ("b", 0): [b""]}
    rows = [(p, r, k, bytearray(x)) for (p, r), own in parts.items() for k, x in enumerate(own)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "path string, record bigint, piece bigint, bytes binary").repartition(2, "path", "record").sortWithinPartitions("path", "record", "piece")
    assert {(r.path, r.record): bytes(r.bytes) for r in df.mapInArrow(warc._joined, warc.JOINED).collect()} == {k: b"".join(v) for k, v in parts.items()}


def test_sources_are_ranked_by_ranges(spark):
    """As many sources as there are hosts: turns and prefix sums in ranges give what one loop over all of them gives."""
    rng = random.Random(8)
    sizes = [(f"host{rng.randrange(10**6):06d}.example", rng.choice([0, 1, 5, 40, 1000, 70_000])) for _ in range(900)] + [(None, 77), ("", 3), ("é", 12), ("\U0001f600", 9)]
    sizes = list(dict(sizes).items())
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size bigint").repartition(5)).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    left, open_, target = 1.5 * sum(n for _, n in sizes), dict(sizes), {}
    while True:
        share = left / sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if share * weight[s] > 2 * n]
        if not over:
            break
        for s in over:
            target[s] = 2 * open_.pop(s)
            left -= target[s]
    target |= {s: share * weight[s] for s in open_}
    assert len(got) == len(sizes) and all(got[s].source_size == n and got[s].target == pytest.approx(target[s], abs=1e-6) for s, n in sizes)
    assert mixing.source_targets(spark.createDataFrame([], "source string, source_size bigint")).collect() == []


def fingerprint_by_hand(spark, texts):
    """The sum of each text's hashed pieces, component by component, in Python integers."""
    import re

    pieces = {t: [p.strip(" \t\r") for p in re.split(r"(?<=[.!?;:,|\u3002\uff01\uff1f\uff1b\uff1a\uff0c\u3001\u060c\u061f\u061b\u2026])\n?|\n", t)] for t in texts}
    every = sorted({p for own in pieces.values() for p in own if p})
    hashed = spark.createDataFrame([(p,) for p in every] or [("",)], "p string").select("p", *[F.xxhash64(F.lit(k), "p").alias(f"h{k}") for k in range(1, 5)])
    bits = {r.p: [r[f"h{k}"] & (1 << 64) - 1 for k in range(1, 5)] for r in hashed.collect()}
    out = {}
    for t, own in pieces.items():
        own = [bits[p] for p in own if p]
        counters = [sum(h[k] >> s & 1 for h in own) + (sum(h[k] >> (s + 30) & 1 for h in own) << 30) for k in (0, 1) for s in range(30)]
        out[t] = [x % (1 << 60) for x in [len(own), *counters, *(sum(h[k] & fingerprint.MASK for h in own) for k in (2, 3))]]
    return out


def likeness_by_hand(a, b):
    lanes = lambda v: [2 * (x >> s & fingerprint.LANE) - v[0] for x in v[1:61] for s in (0, 30)]
    x, y = lanes(a), lanes(b)
    whole = sum(i * i for i in x) + sum(i * i for i in y)
    return 1.0 if a == b else 0.0 if not whole else max(0.0, 1 - sum((i - j) ** 2 for i, j in zip(x, y, strict=True)) / whole)


def test_fingerprints_equal_a_sum_by_hand(spark):
    texts = ["", "one", "One. two, three;\nfour\n\n two", "a\n" * 40 + "b.", "x, " * 3000, "Grüße！ 你好。ok\t\r\n ok", "  \n\t", "one. two, three;\nfour\n two \n", "long " * 100_000 + ". end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(df).collect()}
    follow = lambda i: texts[(i + 1) % len(texts)]
    edited = [t[: len(t) - len(t) // 4] + follow(i)[: len(t) // 4] for i, t in enumerate(texts)]
    want = fingerprint_by_hand(spark, {*texts, *edited})
    spelled = lambda v: "".join(f"{x:015x}" for x in v)
    for i, t in enumerate(texts):
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (spelled(want[t]), spelled(want[edited[i]]))
        assert got[i].near_edited == pytest.approx(likeness_by_hand(want[t], want[edited[i]])) and got[i].near_next == pytest.approx(likeness_by_hand(want[t], want[follow(i)]))


def test_very_long_texts_are_mixed_and_archived(spark):
    words = " ".join(f"w{i % 977}" for i in range(400_000))
    docs = [(1, words, "a"), (2, "short text", "a"), (3, words[::-1], "b")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    plan = mixing.mix_documents(df, spark.createDataFrame([], "doc_id bigint, weight double"))
    assert {r.doc_id: r["size"] for r in plan.collect()} == {i: len(t.split()) for i, t, _ in docs}
    mix = [r.text.split() for r in mixing.mixed(df, plan).collect()]
    assert sum(map(len, mix)) == plan.agg(F.sum("taken")).first()[0]
    path = scratch(spark, "t8long")
    warc.write_archives(df.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html"), path)
    got = {r.page_id: r for r in warc.page_records(warc.read_archives(spark, path)).collect()}
    assert all((got[i].payload_bytes, got[i].payload_digest) == (len(t), hashlib.sha1(t.encode()).hexdigest()) for i, t, _ in docs)
