import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagetally.llm import bpe, chat, langid, tokenfile, wordpiece
from pagetally.llm.common import scratch

ODD = [None, "", " ", "a", "  \n\n \t x", "Äö ñandú 東京 🎉🎉 e\u0301", "aaaa" * 3000, "<|endoftext|> x<|startoftext|>", "it's we'll I'D ΣΑΣ Σ", "\x1c\x1d\x85\xa0z\u200b", "\\### Assistant: </turn> ok", "1234567 89", "tail   ", "\r\n\r\nx", "word " * 9000]


def texts(spark):
    rng = random.Random(5)
    alphabet = "abcdeéß東🎉 \n\t.,'\\<>/1234 \u0301"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(150)]
    rows = [(i, t, "ids", i) for i, t in enumerate(ODD + made)] + [(None, "no id", "x", 1), (3, "a", "ids", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int").repartition(3), rows


@pytest.fixture(scope="module")
def codec(spark):
    return bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_equals_library_and_round_trips(spark, codec):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df, rows = texts(spark)
    got = bpe.round_trip_documents(df, codec).withColumn("d", bpe.ids_digest(F.col("ids"))).collect()
    assert len(got) == len(rows)
    for r in got:
        want = lib.encode_ordinary(r.text or "")
        assert r.ids == want, r.text
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.d == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_bpe_edges(spark, codec):
    c = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert sorted(c.table.find([c.tokens[i] for i in c.known]).tolist()) == list(range(len(c.known)))
    df = spark.createDataFrame([(None,), ([],), ([5, None, 99999999],)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in bpe.decode_documents(df, codec).collect()] == [None, bytearray(b""), c.tokens[5] + b"\xef\xbf\xbd" * 2]
    assert bpe.encode_documents(spark.createDataFrame([], "text string"), codec).collect() == []


def test_long_text_in_pieces(codec, monkeypatch):
    c = codec.value.ready()
    text = "alpha, béta 12\n" * 400
    whole = c.encode([text])
    monkeypatch.setattr(bpe, "CHUNK", 64)
    assert c.encode([text]) == whole


def greedy(word, opening, going):
    n, at = 0, 0
    while at < len(word):
        own = opening if at == 0 else going
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy_search():
    rng = random.Random(3)
    for _ in range(300):
        opening, going = ({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 9))} for _ in range(2))
        auto = wordpiece.Automaton(opening, going)
        for _ in range(20):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert auto.count(w) == greedy(w, opening, going), (w, opening, going)


def test_token_counts(spark, monkeypatch):
    df, rows = texts(spark)
    v = wordpiece.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    opening, going = v.value.sets
    got = wordpiece.count_tokens(df.withColumn("row", F.lit("mine")), v).collect()
    known: dict[bytes, int] = {}
    for r in got:
        words = (r.text or "").encode().split()
        assert (r.n_words, r.row) == (len(words), "mine")
        assert r.n_tokens == sum(known.setdefault(w, greedy(w, opening, going)) if w not in known else known[w] for w in words)
    assert len(got) == len(rows)
    assert wordpiece.count_tokens(df.filter("false"), v).collect() == []
    monkeypatch.setattr(wordpiece, "MEMO", 10)
    monkeypatch.setattr(wordpiece, "CHUNK", 50)
    auto = wordpiece.Vocabulary(opening, going).automaton()
    assert [auto.counts(r.text.encode().split()) for r in got if r.text] == [r.n_tokens for r in got if r.text]


def test_memos_bound_memory_and_not_results(codec, monkeypatch):
    """With memos of a few bytes, and pieces of a few characters, all is as with large ones."""
    import pyarrow as pa

    rng = random.Random(9)
    own = [t or "" for t in ODD] + ["".join(rng.choice("abc ,.\nÄß") for _ in range(300)) for _ in range(20)]
    c = codec.value.ready()
    words = tokenfile.WordTokenizer(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    ids, (flat, sizes) = c.encode(own), words.encode(pa.array(own), 1)
    monkeypatch.setattr(bpe, "MEMO", 10)
    monkeypatch.setattr(bpe, "CHUNK", 90)
    monkeypatch.setattr(tokenfile, "MEMO", 10)
    monkeypatch.setattr(tokenfile, "CHUNK", 90)
    small = tokenfile.WordTokenizer(words.raw)
    assert bpe.Codec(c.tokens, c.pattern).ready().encode(own) == ids
    again, n = small.encode(pa.array(own), 1)
    assert again.tolist() == flat.tolist() and n.tolist() == sizes.tolist() and small._held <= 10 + max(map(len, own)) * 5


def test_words_are_looked_up_as_the_library_cuts_them():
    """Folding, commas and full stops, combining marks, marks of other scripts: as if every text were encoded whole."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(10)
    parts = ["A", "b", "Cd", "J", "h", "\u030c", "\u0331", "\u0307", "é", "É", "e\u0301", "İ", "ß", "Σ", ",", ".", "'S", "'t", "’", "…", "9", "۳", "東", "\x85", "\xa0", "\u2003", "\x1c", " ", "\n", "🎉", "ﬁ", "K"]
    own = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["J\u030c,", "j\u030c.", "A,\u0301", "a.\u0301 b", "x,y.z", "x,,", "A.", "it's, It'S."]
    flat, sizes = tokenfile.WordTokenizer(open(path, encoding="utf-8").read()).encode(pa.array(own), 1)
    at = 0
    for t, n in zip(own, sizes.tolist(), strict=True):
        assert flat[at : at + n].tolist() == lib.encode(t, add_special_tokens=False).ids + [1], repr(t)
        at += n


def test_chat_formatting(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", " é🎉 <turn>\\<says>\n"), (1, 2, "assistant", "again"), (2, 0, "assistant", None), (2, 1, None, "x"), (None, 0, "user", "u"), (-7, 0, "user", said), (-7, 1, "assistant", said), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (5, None, "<says>", "</turn><\\turn>"), (6, 0, "assistant", "long " * 30000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(df, chat.load(spark, public_tokenizers.path("byte_bpe_50k.json")))).collect()}
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.filter("false"), chat.load(spark, public_tokenizers.path("byte_bpe_50k.json"))).collect() == []


def test_token_files(spark):
    import numpy as np
    from tokenizers import Tokenizer

    df, rows = texts(spark)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = scratch(spark, "t9")
    tokenfile.write_token_files(df, tokenfile.load(spark, public_tokenizers.path("word_bpe_49k.json")), path)
    back = tokenfile.starts(tokenfile.read_token_files(spark, path).withColumn("crc", tokenfile.crc_column())).orderBy("place").collect()
    assert len(back) == len(rows)
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    at, last = 0, -1
    for r in back:
        assert r.ids in by_id[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.crc == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert (-1 if r.doc_id is None else r.doc_id) >= last
        at, last = at + len(r.ids), -1 if r.doc_id is None else r.doc_id
    assert sorted(r.doc_id for r in tokenfile.find_documents(spark, path, [3, 7]).collect()) == [3, 3, 7]
    assert tokenfile.find_documents(spark, path, [10**9]).collect() == []
    empty = scratch(spark, "t9e")
    tokenfile.write_token_files(df.filter("false"), tokenfile.load(spark, public_tokenizers.path("word_bpe_49k.json")), empty)
    assert tokenfile.starts(tokenfile.read_token_files(spark, empty)).collect() == []


WORDS = {"en": "the and of with that which house water people", "de": "der und nicht eine wasser haus straße schön über", "fr": "le et être une maison eau française avec très"}


def lang_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 40))), lang, f"h{i % 3}.{lang}"))
    return rows


def test_language_id(spark):
    df = spark.createDataFrame(lang_rows(200, 1), "doc_id bigint, text string, lang string, source string")
    model = langid.fit_text_model(df)
    assert model.languages == ["de", "en", "fr"]
    held = lang_rows(60, 2)
    odd = [(900, None, "de", None), (901, "", None, "x"), (902, "12345 !!", "en", "h0.en"), (903, "the water of the people and that house", "fr", "h0.en"), (904, "the house", None, None)]
    test = spark.createDataFrame([(*r, 1) for r in held + odd], "doc_id bigint, text string, lang string, source string, accepted int")
    got = {r.doc_id: r for r in langid.identify(test, model, F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert len(got) == len(held) + len(odd)
    assert all(got[i].predicted == lang and got[i].accepted for i, _, lang, _ in held)
    assert not got[900].accepted and not got[901].accepted and not got[902].accepted
    assert got[903].predicted == "en" and got[904].predicted == "en"
    none = langid.identify(test, langid.fit_text_model(df.filter("false")), F.col("text"), F.col("lang"), F.col("source")).collect()
    assert len(none) == len(got) and not any(r.accepted for r in none)


def test_rare_languages_are_modelled_at_any_size(spark):
    """A language of few texts among many of others, unlabelled ones too, stays a language, and its texts are kept."""
    rare = "вода дом человек который"
    rows = [(i, f"the water {i % 7} house people", "en" if i % 2 else None, "s") for i in range(6000)] + [(9000 + i, f"{rare} {i}", "ru", "s") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = langid.fit_text_model(df, sample=200)
    assert model.languages == ["en", "ru"]
    got = langid.identify(df.filter("lang = 'ru'"), model, F.col("text"), F.col("lang"), F.col("source")).collect()
    assert len(got) == 5 and all(r.predicted == "ru" and r.accepted for r in got)


def test_short_clean_texts_are_kept(spark):
    df = spark.createDataFrame(lang_rows(200, 1), "doc_id bigint, text string, lang string, source string")
    model = langid.fit_text_model(df)
    rng = random.Random(4)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    short = [(1, "Great house.", "en", "s"), (2, "Avec soin.", "fr", "s"), (3, "Eine Bitte.", "de", "s"), (4, "ÊTRE FRANÇAISE TRÈS ÉTÉ", "fr", "s"), (5, "être française très été", "fr", "s"), (6, noise, "en", "s"), (7, noise, "de", "s"), (8, noise, "fr", "s"), (9, noise, None, "s")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(short, df.schema), model, F.col("text"), F.col("lang"), F.col("source")).collect()}
    assert all(got[i].accepted and got[i].predicted == got[i].lang for i in range(1, 6))
    assert (got[4].posterior, got[4].n_bigrams) == (got[5].posterior, got[5].n_bigrams)
    assert not any(got[i].accepted for i in range(6, 10))


def test_more_languages_than_200(spark):
    rows = [(3 * k + i, " ".join(chr(0x4E00 + 40 * k + (7 * i + j) % 12) * 2 for j in range(12)), f"l{k:03}", "s") for k in range(210) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = langid.fit_text_model(df)
    assert len(model.languages) == 210
    got = langid.identify(df, model, F.col("text"), F.col("lang"), F.col("source")).collect()
    assert len(got) == len(rows) and all(r.predicted == r.lang for r in got)


def test_markup_evidence(spark):
    row = spark.range(1).select(
        langid.markup_language(F.lit('<!DOCTYPE html><html class="x" lang="FR-ca"><p>a')).alias("lang"), langid.markup_text(F.lit("<style>p{}</style><p>Bon <b>jour</b>")).alias("text"),
        langid.suffix_code(F.lit("https://a.example.org/de/12")).alias("path"), langid.suffix_code(F.lit("http://x.example.AT/q/1")).alias("domain"), langid.host_of(F.lit("http://A.b.c:80/x")).alias("host"),
    ).first()
    assert (row.lang, row.text.split(), row["path"], row.domain, row.host) == ("fr", ["Bon", "jour"], "de", ".at", "a.b.c")


def test_addresses_name_languages():
    """A country's suffix stands for its languages, a path segment for one; unknown ones say nothing."""
    own = ["de", "en", "fr", "sv"]
    shares = lambda code: langid.suffix_shares(code, own)
    one = [0.1, 0.1, 0.1, 0.7]
    assert shares("sv") == pytest.approx(one) and shares(".se") == pytest.approx(one)
    assert shares(".sv") is None and shares("ar") is None and shares(".io") is None and shares("") is None and shares(None) is None  # Spanish is not among them
    assert shares(".ca") == pytest.approx([0.15, 0.7 * 0.75, 0.7 * 0.25, 0.15]) and shares(".at") == pytest.approx([0.7, 0.1, 0.1, 0.1])
    assert shares(".ch") == pytest.approx([0.7 * 0.65 / 0.9, 0.15, 0.7 * 0.25 / 0.9, 0.15])
    assert langid.suffix_shares(".ca", ["en", "fr"]) == pytest.approx([0.525, 0.175]) and langid.suffix_shares(".de", ["de"]) is None


def test_pages_use_all_evidence(spark, tmp_path):
    """Pages are judged by text, markup, address suffix, host and parent domain; each decides where the rest is silent."""
    from pagetally.llm import entries

    spark.createDataFrame(lang_rows(200, 1), "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    text = {lang: words.replace("ü", "u").replace("ß", "ss") for lang, words in WORDS.items()}
    rows = [(i, f"http://h{i % 5}.deu.example.org/{i}", f"<html><p>{text['de']}") for i in range(40)]
    rows += [(k + i, f"http://h{i % 5}.{lang}x.example.com/{i}", f"<html><p>{text[lang]}") for k, lang in ((200, "en"), (300, "fr")) for i in range(40)]
    rows += [(100, "http://x.example.net/fr/12", "<html><p>zz"), (101, "http://x.example.net/12", '<html lang="fr"><p>zz'), (102, "http://new.deu.example.org/1", "<html><p>zz"), (103, "http://h0.deu.example.org/1", "<html><p>zz"), (104, "http://x.example.net/1", None), (105, None, f"<html lang='de'><p>{text['en']}")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in entries.queries()["op10_page_language"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == "de" and got[i].accepted for i in range(40))
    assert [got[i].predicted for i in (100, 101, 102, 103, 104, 105)] == ["fr", "fr", "de", "de", None, "en"]


def test_lookups_skip_row_groups(spark):
    """An id between those of a file, but not among them, reads no row thanks to the Bloom filters; one that is there reads its row group."""
    df = spark.range(0, 120_000, 2).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    path = scratch(spark, "t9p")
    tokenfile.write_token_files(df, tokenfile.load(spark, public_tokenizers.path("word_bpe_49k.json")), path)

    def read(ids):
        found = tokenfile.find_documents(spark, path, ids)
        n = len(found.collect())
        plan = found._jdf.queryExecution().executedPlan()
        while plan.children().nonEmpty():
            plan = plan.children().head()
        return n, plan.metrics().apply("numOutputRows").value()

    assert read([60_001]) == (0, 0) and read([10**7]) == (0, 0)
    n, rows = read([60_000])
    assert n == 1 and 0 < rows <= 10_000
