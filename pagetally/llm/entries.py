"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, jaccard, langid, mixing, negatives, phrases, tokenfile, topk, toxicity, warc, wordpiece
from .common import scratch, small_batches, staged


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.chat_digests(chat.format_chats(rows, chat.load(spark, public_tokenizers.path("byte_bpe_50k.json"))))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.round_trip_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), codec)
    rows = rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    with small_batches(spark):
        return staged(rows, "byte-bpe")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = wordpiece.load(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return wordpiece.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_words", "n_tokens")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.quality_weights(_read(spark, sf_dir, "labels"))
    return mixing.mix_documents(_read(spark, sf_dir, "documents"), quality).drop("text_hash")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    tokenfile.write_token_files(_read(spark, sf_dir, "documents"), tokenfile.load(spark, public_tokenizers.path("word_bpe_49k.json")), path)
    rows = tokenfile.read_token_files(spark, path).select("doc_id", "place", "n_tokens", tokenfile.crc_column().alias("ids_crc32"))
    return tokenfile.starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def identified(docs: DataFrame) -> DataFrame:
    """Documents with their language: `lang` is what is declared, `source` the host."""
    return langid.identify(docs, langid.fit_text_model(docs), F.col("text"), F.col("lang"), F.col("source"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identified(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    with small_batches(spark):
        return staged(found.select("doc_id", "predicted", F.round("posterior", 6).alias("posterior"), "n_bigrams", "accepted"), "languages")


def op10_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of web pages: their text, the language their markup declares, and their addresses' hosts and suffixes."""
    model = langid.fit_text_model(_read(spark, sf_dir, "documents"))
    found = langid.identify(_read(spark, sf_dir, "pages"), model, langid.markup_text(F.col("html")), langid.markup_language(F.col("html")), F.col("url"))
    return found.select("page_id", "predicted", F.round("posterior", 6).alias("posterior"), "n_bigrams", "accepted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = _read(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    rows = scored.select("doc_id", held_out.alias("held_out"), "score", F.col("toxic").cast("int").alias("predicted"), F.size("spans").cast("bigint").alias("n_spans"))
    with small_batches(spark):
        return staged(rows, "toxicity")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_formatting, op2_byte_bpe, op3_top_k, op4_token_counts, op5_ngram_jaccard, op6_fingerprints, op7_mix_sources, op8_warc, op9_token_files, op10_language_id, op10_page_language, op11_hard_negatives, op12_toxicity, op13_collocations)
    return {f.__name__: f for f in own}


_TOP_K = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
q AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, -ln(u) / coalesce(weight, 1.0::DOUBLE) AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * size AS cap, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, cap / w AS level, row_number() OVER (ORDER BY cap / w, turn) AS place FROM w),
h AS (SELECT *, ((sum(size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / ((sum(w) OVER ()) - coalesce(sum(w) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share FROM l),
t AS (SELECT source, CAST(size AS BIGINT) AS source_size, coalesce(least(cap, (SELECT arg_min(share, place) FROM h WHERE share <= level) * w), cap) AS target FROM h),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(floor(target - epochs * source_size + 0.5) AS BIGINT) AS rest FROM e),
p AS (SELECT k.*, source_size, target, epochs, rest, CAST(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start
      FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM p
"""

_WARC = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY digest, bytes) AS first FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 1000 AND first <> page_id THEN first END AS refers_to FROM f
"""


_NEGATIVES = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON p.place <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

_PHRASES = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM i, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
u AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM c),
s AS (SELECT u.lang, u.m, u.phrase, u.a, u.k, x.n AS l, y.n AS r, t.n,
        CAST((1000 * CAST(u.a AS HUGEINT) * t.n) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.head JOIN f y ON y.lang = u.lang AND y.phrase = u.tail JOIN t ON t.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s),
o AS (SELECT * FROM b WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM f z WHERE z.lang = b.lang AND z.m > b.m AND z.n >= b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' '))),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": _TOP_K, "op7_mix_sources": _MIX, "op8_warc": _WARC, "op11_hard_negatives": _NEGATIVES, "op13_collocations": _PHRASES}
