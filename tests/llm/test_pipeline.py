"""The pipeline's stages one by one, and as a whole, against plain Python."""

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagetally.llm import bpe, entries, langid, mixing

from .test_set_ops import brute_components, fill, shingles

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, predicted string, row string, at string, taken int, component string, `text hash` int"
MORE = ("mine", "mine", "mine", 5, "mine", 6)
WORDS = {"en": "the and of with that which house water people from their", "de": "der und nicht eine wasser haus straße schön über mit", "fr": "le et être une maison eau française avec très pour"}


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(8, 60))), lang, rng.choice(["a", "b", "c", None])))
    base = rows[0][1]
    rows += [(n + i, base, "en", "a") for i in range(30)] + [(n + 100 + i, f"{base} {w}", None, "b") for i, w in enumerate("the and of".split())]
    rows += [(None, rows[1][1], "en", "a"), (None, None, None, None), (5000, None, "en", "a"), (5001, "", "en", "a"), (5002, " \n", "en", "c"), (5003, "12345 !!", "en", "c"), (3, rows[3][1], rows[3][2], rows[3][3]), (6000, " ".join(rows[4][1] for _ in range(20000)), rows[4][2], "c")]
    return [(*r, len(r[1] or ""), *MORE) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(120, 3), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100, 3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_pass_empty_tables(spark, docs, folder, name):
    out = STAGES[name](spark, docs, folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    empty = STAGES[name](spark, docs.filter("false"), folder)
    assert empty.columns == docs.columns and empty.collect() == []


def test_language_stage(spark, docs, folder):
    """Documents without letters go; natural texts stay, as they came."""
    out = rows_of(STAGES["language_id"](spark, docs, folder))
    want = Counter(tuple(r) for r in made(120, 3) if any(c.isalpha() for c in r[1] or ""))
    assert out == want


def test_near_copies_stage(spark, docs, folder):
    out = STAGES["ngram_jaccard"](spark, docs, folder).collect()
    rows = [(r[0], r[1]) for r in made(120, 3)]
    groups = {}
    for root, (d, t) in zip(brute_components(rows, 5, 80, 100), rows, strict=True):
        groups.setdefault(root, []).append((d, t))
    want = Counter()
    for own in groups.values():
        if not shingles(own[0][1], 5):
            want.update(d for d, _ in own)
        else:
            want[min((d is None, d or 0) for d, _ in own)[1] if any(d is not None for d, _ in own) else None] += 1
    assert Counter(r.doc_id for r in out) == want
    assert rows_of(docs.filter("text is null")) == Counter(tuple(r) for r in out if r.text is None)


def test_mixing_stage(spark, docs, folder):
    out = STAGES["mix_sources"](spark, docs, folder).collect()
    rows = made(120, 3)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    target = fill(sizes, mixing.WEIGHTS, 1.5, 2.0)
    taken = Counter()
    for r in out:
        taken[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text) and (r.predicted, r.row, r["text hash"]) == ("mine", "mine", 6)
    assert all(abs(taken[s] - target[s]) <= 2 for s in sizes)
    by_text = {" ".join((r[1] or "").split()): r for r in rows}
    whole = [r for r in out if " ".join(r.text.split()) in by_text]
    assert len(out) - len(whole) <= len(sizes)  # one cut document a source
    assert rows_of(spark.createDataFrame(out)) == rows_of(STAGES["mix_sources"](spark, docs.repartition(7), folder))


def test_encoding_stage(spark, docs, folder):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = STAGES["byte_bpe"](spark, docs, folder).collect()
    rows = made(120, 3)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in out)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r[0], tuple(lib.encode_ordinary(r[1] or ""))) for r in rows)
    assert STAGES["byte_bpe"](spark, docs.filter("false"), folder).collect() == []


def test_whole_pipeline(spark, docs, folder):
    """What comes out is what the stages give, each on its predecessor's rows; every text comes from a document that both filters keep."""
    out = corpus_pipeline.run(spark, folder).collect()
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name in list(STAGES)[:2]:
        now = spark.createDataFrame(STAGES[name](spark, now, folder).collect(), now.schema)
    kept = {r.doc_id: r.text for r in now.collect()}
    assert len(kept) == now.count() and {r.doc_id for r in out} <= set(kept)
    codec = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).value.ready()
    texts = [(r.doc_id, codec.decode(r.ids).decode()) for r in out]
    assert sum(kept[d] != t for d, t in texts) <= 4 and all(r.exact for r in out)
    assert all(kept[d].split()[: len(t.split())] == t.split() for d, t in texts)
    total = Counter()
    for d, t in kept.items():
        total[d] += len(t.split())
    assert abs(sum(len(t.split()) for _, t in texts) - sum(fill_of(now).values())) <= 4


def test_intermediate_tables_go(spark, docs, folder):
    import os

    from pagetally.llm import common

    top = common.shared_dir(spark).removeprefix("file:") + "/llm"
    before = set(os.listdir(top))
    with common.tidied(spark):
        out = common.kept(STAGES["ngram_jaccard"](spark, docs, folder), "mine")
    left = set(os.listdir(top)) - before
    assert len(left) == 1 and left.pop().startswith("mine-") and out.count() > 0


def fill_of(df):
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += len((r.text or "").split())
    return fill(sizes, mixing.WEIGHTS, 1.5, 2.0)


def test_identification_keeps_names_and_repeats(spark, docs):
    """Columns called like helpers pass; repeated rows get one answer; a text of over a megabyte is read whole."""
    long = "le et être " * 1000 + "the house and water of people with that which " * 40000
    df = docs.unionByName(docs).unionByName(spark.createDataFrame([(7000, long, None, None, 0, *MORE)], SCHEMA))
    model = langid.fit_text_model(df)
    out = langid.identify(df, model, F.col("text"), F.col("lang"), F.col("source"))
    assert out.columns == [c for c in df.columns if c != "predicted"] + ["predicted", "posterior", "n_bigrams", "accepted"]
    seen = {}
    for r in out.collect():
        key = (r.doc_id, r.text, r.lang, r.source)
        assert seen.setdefault(key, (r.predicted, r.posterior, r.n_bigrams, r.accepted)) == (r.predicted, r.posterior, r.n_bigrams, r.accepted)
        assert (r.row, r.at, r.component) == ("mine", "mine", "mine")
    found = seen[7000, long, None, None]
    letters = sum(len(w.encode()) - 1 for w in long.split())
    assert found[0] == "en" and found[2] == letters
    assert langid.identify(df.filter("false"), model, F.col("text"), F.col("lang"), F.col("source")).collect() == []


def test_ties_go_to_the_first_language(spark):
    df = spark.createDataFrame([(1, "abab", "y", "s"), (2, "abab", "X", "s")], "doc_id bigint, text string, lang string, source string")
    model = langid.fit_text_model(df)
    assert model.languages == ["x", "y"]
    got = langid.identify(df, model, F.col("text"), F.lit(None).cast("string"), F.col("source")).collect()
    assert [r.predicted for r in got] == ["x", "x"]
    said = langid.identify(df, model, F.col("text"), F.col("lang"), F.col("source")).collect()
    assert [r.predicted for r in said] == ["y", "x"]


def test_posterior_equals_bayes(spark):
    """The fused posterior, computed anew from its parts."""
    import math

    rows = [(i, t, lang, h) for i, (t, lang, h) in enumerate([("the house", "en", "a.x.org"), ("der wasser", "de", "b.x.org"), ("house der", None, "a.x.org"), ("water und", "en", "c.y.org"), ("people", "de", None)] * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, url string")
    train = spark.createDataFrame([(i, w, lang) for lang in ("de", "en") for i, w in enumerate(WORDS[lang].split())], "doc_id bigint, text string, lang string")
    model = langid.fit_text_model(train)
    got = {r.doc_id: r for r in langid.identify(df, model, F.col("text"), F.col("lang"), F.concat(F.lit("http://"), F.col("url"))).collect()}
    votes = {d: int(model.score(t)[0].argmax()) for d, t, _, _ in rows}
    host, parent, every = Counter(), Counter(), Counter()
    for d, _, _, h in rows:
        if h:
            host[h, votes[d]] += 1
            parent[h[1:], votes[d]] += 1
            every[votes[d]] += 1
    n = lambda c, h: sum(v for (k, _), v in c.items() if k == h)
    base = [(every[i] + 1) / (sum(every.values()) + 2) for i in range(2)]
    for d, t, lang, h in rows:
        prior = base
        if h:
            up = [(parent[h[1:], i] + langid.KAPPA * base[i]) / (n(parent, h[1:]) + langid.KAPPA) for i in range(2)]
            prior = [(host[h, i] + langid.KAPPA * up[i]) / (n(host, h) + langid.KAPPA) for i in range(2)]
        like = model.score(t)[0]
        log = [math.log(prior[i]) + langid.TEMPER * like[i] + (0 if lang is None else math.log(langid.TRUST if model.languages[i] == lang else 1 - langid.TRUST)) for i in range(2)]
        best = max(range(2), key=lambda i: log[i])
        assert got[d].predicted == model.languages[best]
        assert got[d].posterior == pytest.approx(1 / sum(math.exp(x - log[best]) for x in log))


def test_held_out_accuracy(spark):
    """Fitted on half of the documents: text alone and, with one declaration in five wrong, all evidence on the other half."""
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").filter("lang is not null and length(text) >= 40")
    model = langid.fit_text_model(all_docs.filter("doc_id % 2 = 0"))
    held = all_docs.filter("doc_id % 2 = 1").withColumn("said", F.when(F.col("doc_id") % 10 < 2, F.lit(model.languages[0])).otherwise(F.col("lang")))
    share = lambda df: df.agg(F.avg((F.col("predicted") == F.col("lang")).cast("double"))).first()[0]
    none = F.lit(None).cast("string")
    alone = share(langid.identify(held, model, F.col("text"), none, none))
    fused = share(langid.identify(held, model, F.col("text"), F.col("said"), F.col("source")))
    print("held out: text alone", alone, "fused", fused)
    assert alone > 0.97 and fused > 0.97


def test_registered_language_queries(spark, folder):
    """The query over documents gives what the operator gives."""
    got = {r.doc_id: r.accepted for r in entries.queries()["op10_language_id"](spark, folder).collect() if r.doc_id is not None}
    want = {r[0]: any(c.isalpha() for c in r[1] or "") for r in made(120, 3) if r[0] is not None}
    assert got == want
