"""Language identification by Bayesian evidence fusion.

log P(language | all) = log prior of the host + text likelihood + declared language + address suffix.

* Text: byte-bigram likelihoods of lower-cased letters (bytes above 127 are letters, the rest are breaks),
  fitted on SAMPLE labelled rows or so (a documented bound; as many of each language, drawn by a hash of id
  and text, and LEAST_DRAWN or all it has at least). Every label in the whole input, in small letters, is a language;
  the model takes 8 bytes a language and bigram seen.
  Bigrams are not independent, so the likelihood is tempered to the power TEMPER.
* Declared language and address: right with probability TRUST and SUFFIX_TRUST, else any other. An address names a
  language by its first path segment of two letters (a language's code), or else by its domain's country, whose
  languages share what is said by COUNTRIES.
* Host prior: by grouped aggregation over all rows, counts of (host, language) by text alone, smoothed
  towards the host's parent domain, that towards all hosts (KAPPA pseudo-counts at each level).

A row is rejected if its text has no letter bigram, or is less likely by far than the texts of the sample, or no
language reaches MIN_POSTERIOR. Less likely by far is a mean log-likelihood per bigram under the sample's mean by
MARGIN and DEVIATIONS standard errors of a text of as many different bigrams, so short texts are not rejected by
chance. Where the declared language is the predicted one it is AGREED_MARGIN instead, which letters at random
exceed (by 6 to 8 on the test data) and natural texts do not (3.4 at most of those tried).

Null and empty texts are rejected (language null, posterior 0). A null host, suffix or declaration is no
evidence. Declared names outside the fitted languages are no evidence. Ties go to the first language by name.
An input without labelled texts rejects every row, an empty table gives an empty one, and rows that repeat get equal
answers. Texts are read a megabyte at a time, whole. Columns of the outputs' names are replaced, others pass, whatever
their names. Rows without a host are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, release, schema, small_batches, staged

SAMPLE = 4000
LEAST_DRAWN = 100
TEMPER = 0.3
TRUST = 0.9
SUFFIX_TRUST = 0.7
KAPPA = 20.0
MARGIN = 1.5
AGREED_MARGIN = 4.5
DEVIATIONS = 3.0
MIN_POSTERIOR = 0.5
#: The languages of countries' address suffixes, with their rough shares. Suffixes that are used all over
#: the world (io, co, tv, me, ai) and those of countries not named say nothing.
COUNTRIES = {
    "ar": {"es": 1.0}, "at": {"de": 1.0}, "au": {"en": 1.0}, "be": {"nl": 0.6, "fr": 0.4}, "bg": {"bg": 1.0}, "bo": {"es": 1.0}, "br": {"pt": 1.0}, "by": {"ru": 0.8, "be": 0.2}, "ca": {"en": 0.75, "fr": 0.25},
    "ch": {"de": 0.65, "fr": 0.25, "it": 0.1}, "ci": {"fr": 1.0}, "cl": {"es": 1.0}, "cm": {"fr": 0.8, "en": 0.2}, "cn": {"zh": 1.0}, "cr": {"es": 1.0}, "cu": {"es": 1.0}, "cz": {"cs": 1.0}, "de": {"de": 1.0}, "dk": {"da": 1.0},
    "do": {"es": 1.0}, "dz": {"ar": 0.6, "fr": 0.4}, "ec": {"es": 1.0}, "ee": {"et": 0.85, "ru": 0.15}, "eg": {"ar": 1.0}, "es": {"es": 0.85, "ca": 0.15}, "fi": {"fi": 0.95, "sv": 0.05}, "fr": {"fr": 1.0}, "gr": {"el": 1.0},
    "gt": {"es": 1.0}, "hk": {"zh": 0.8, "en": 0.2}, "hn": {"es": 1.0}, "hr": {"hr": 1.0}, "hu": {"hu": 1.0}, "id": {"id": 1.0}, "ie": {"en": 1.0}, "il": {"he": 1.0}, "in": {"en": 0.6, "hi": 0.4}, "ir": {"fa": 1.0}, "is": {"is": 1.0},
    "it": {"it": 1.0}, "jp": {"ja": 1.0}, "ke": {"en": 0.7, "sw": 0.3}, "kr": {"ko": 1.0}, "kz": {"ru": 0.6, "kk": 0.4}, "li": {"de": 1.0}, "lt": {"lt": 1.0}, "lu": {"fr": 0.6, "de": 0.4}, "lv": {"lv": 0.8, "ru": 0.2}, "ma": {"ar": 0.5, "fr": 0.5},
    "mx": {"es": 1.0}, "my": {"ms": 0.7, "en": 0.3}, "ng": {"en": 1.0}, "ni": {"es": 1.0}, "nl": {"nl": 1.0}, "no": {"no": 1.0}, "nz": {"en": 1.0}, "pa": {"es": 1.0}, "pe": {"es": 1.0}, "ph": {"en": 0.6, "tl": 0.4}, "pk": {"ur": 0.5, "en": 0.5},
    "pl": {"pl": 1.0}, "pt": {"pt": 1.0}, "py": {"es": 1.0}, "ro": {"ro": 1.0}, "rs": {"sr": 1.0}, "ru": {"ru": 1.0}, "sa": {"ar": 1.0}, "se": {"sv": 1.0}, "sg": {"en": 0.8, "zh": 0.2}, "si": {"sl": 1.0}, "sk": {"sk": 1.0}, "sn": {"fr": 1.0},
    "sv": {"es": 1.0}, "th": {"th": 1.0}, "tn": {"ar": 0.6, "fr": 0.4}, "tr": {"tr": 1.0}, "tw": {"zh": 1.0}, "ua": {"uk": 0.8, "ru": 0.2}, "uk": {"en": 1.0}, "us": {"en": 0.9, "es": 0.1}, "uy": {"es": 1.0}, "ve": {"es": 1.0}, "vn": {"vi": 1.0}, "za": {"en": 1.0},
}
_MAP = np.full(256, 32, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
COUNTS = schema("lang string, bigram int, n bigint, squares double")


def bigrams(text: bytes) -> np.ndarray:
    x = _MAP[np.frombuffer(text, np.uint8)]
    if len(x) < 2:
        return np.empty(0, np.int64)
    a, b = x[:-1], x[1:]
    keep = (a != 32) & (b != 32)
    return (a[keep].astype(np.int64) << 8) | b[keep]


class TextModel:
    def __init__(self, languages: list[str], seen: np.ndarray, counts: np.ndarray):
        """counts: of each language, the times it has each bigram of `seen`; other bigrams share a last column."""
        self.languages = languages
        self.place = np.full(65536, len(seen), np.int32)
        self.place[seen] = np.arange(len(seen))
        total = counts.sum(axis=1, keepdims=True)
        counts = np.hstack([counts, np.zeros((len(languages), 1))])
        self.logp = np.log((counts + 0.5) / (total + 0.5 * 65536))
        share = counts / np.maximum(1, total)
        self.usual = (share * self.logp).sum(axis=1)
        self.spread = np.sqrt((share * (self.logp - self.usual[:, None]) ** 2).sum(axis=1))

    def score(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """Log-likelihood of a text by language, its bigrams, and how many differ (those not seen count as one)."""
        times = np.zeros(self.logp.shape[1], np.int64)
        raw = (text or "").lower().encode()
        for at in range(0, len(raw), 1 << 20):
            times += np.bincount(self.place[bigrams(raw[at : at + (1 << 20) + 1])], minlength=len(times))
        had = np.flatnonzero(times)
        like = np.zeros(len(self.languages))
        for at in range(0, len(had), 4096):  # a bounded part of the model is copied at a time
            some = had[at : at + 4096]
            like += self.logp[:, some] @ times[some]
        return like, int(times.sum()), len(had)

    def usual_enough(self, at: int, like: float, n: int, differ: int, declared: int) -> bool:
        """Whether a text of n bigrams is as likely in the language as its texts are. Repeats say nothing new,
        so chance is measured by the bigrams that differ."""
        margin = AGREED_MARGIN if declared == at else MARGIN
        return bool(like / n >= self.usual[at] - margin - DEVIATIONS * self.spread[at] / np.sqrt(differ))


def fit_text_model(df: DataFrame, id: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> TextModel:
    """Bigram counts by language. The languages are all labels, counted over all rows; of each, about
    sample / languages rows are drawn (LEAST_DRAWN at least, or all it has)."""
    rows = df.filter(df[text].isNotNull() & df[label].isNotNull())
    rows = rows.select(F.lower(rows[label]).alias("lang"), rows[text].alias("text"), F.pmod(F.xxhash64(rows[id], rows[text]), F.lit(1 << 30)).alias("draw"))
    labels = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first"))
    labels = staged(labels, "labels")
    languages = sorted(r[0] for r in labels.select("lang").collect())
    each = max(LEAST_DRAWN, sample / max(1, len(languages)))
    shares = labels.select("lang", F.greatest("first", F.ceil(each / F.col("n") * (1 << 30)) - 1).alias("most"))  # one row at least
    rows = rows.join(F.broadcast(shares), "lang").filter("draw <= most").select("lang", "text")
    out = schema("lang string, bigram int, n bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, own in have.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], schema=arrow_schema(out))
            have.clear()

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang not in have and len(have) == 64:
                    yield from counted()
                own = have.setdefault(lang, np.zeros(65536, np.int64))
                own += np.bincount(bigrams(t.as_py().lower().encode()), minlength=65536)
        yield from counted()

    with small_batches(df.sparkSession):
        found = staged(rows.mapInArrow(count, out).groupBy("lang", "bigram").agg(F.sum("n").alias("n")), "bigrams")
    seen = np.array(sorted(r[0] for r in found.select("bigram").distinct().collect()), np.int64)
    counts = np.zeros((len(languages), len(seen)))
    row, column = ({x: i for i, x in enumerate(names)} for names in (languages, seen.tolist()))
    for lang, g, n in found.toLocalIterator():
        counts[row[lang], column[g]] = n
    return TextModel(languages, seen, counts)


def _at(names: Column, languages: list[str]) -> Column:
    known = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    return F.coalesce(F.nullif(F.array_position(known, names), F.lit(0)), F.lit(0)).cast("int") - 1


def suffix_code(address: Column) -> Column:
    """What an address says: its first path segment of two letters, or else a dot and its last domain label of two."""
    host = F.regexp_extract(address, r"^(?:[a-zA-Z]+://)?([^/?#:]*)", 1)
    path = F.regexp_extract(address, r"^(?:[a-zA-Z]+://)?[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1)
    return F.lower(F.when(F.length(path) > 0, path).otherwise(F.regexp_extract(host, r"(\.[a-zA-Z]{2})$", 1)))


def suffix_shares(code: str | None, languages: list[str]) -> np.ndarray | None:
    """How likely each language is by what an address says (see suffix_code); none if it says nothing about them."""
    said = {} if not code else COUNTRIES.get(code[1:], {}) if code.startswith(".") else {code: 1.0}
    own = np.array([said.get(x, 0.0) for x in languages])
    if not own.any() or len(languages) < 2:
        return None
    others = own == 0
    return SUFFIX_TRUST * own / own.sum() + np.where(others, (1 - SUFFIX_TRUST) / max(1, others.sum()), 0.0)


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z]+://)?([^/?#:]*)", 1))


def markup_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))


def markup_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")


def identify(df: DataFrame, model: TextModel, text: Column, declared: Column, address: Column) -> DataFrame:
    """Adds predicted (string), posterior (double), n_bigrams (bigint) and accepted (boolean).
    address: a web address or the name of a source; its host part names the host."""
    spark, L = df.sparkSession, len(model.languages)
    shared = spark.sparkContext.broadcast(model)
    evidence = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), text.alias("text"), host_of(address).alias("host"), _at(F.lower(declared), model.languages).alias("declared"), suffix_code(address).alias("suffix"))

    @F.arrow_udf("int")
    def by_text(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for a in arrays:
            got = [m.score(t.as_py()) for t in a]
            yield pa.array([int(s.argmax()) if n and L else -1 for s, n, _ in got], pa.int32())
        release()

    parent = F.expr("CASE WHEN instr(host, '.') > 0 THEN substring(host, instr(host, '.')) ELSE '' END").alias("parent")
    votes = evidence.select("host", parent, by_text("text").alias("lang")).filter("lang >= 0 and host is not null")
    if L:
        with small_batches(spark):
            counts = staged(votes.groupBy("host", "parent", "lang").agg(F.count("*").alias("n")), "host-counts")
        every = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
        base = F.array(*[F.lit((every.get(i, 0) + 1) / (sum(every.values()) + L)) for i in range(L)])
        by = (F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("all"))
        smooth = lambda above: F.transform(above, lambda a, i: (F.coalesce(F.try_element_at("by", i), F.lit(0)) + KAPPA * a) / (F.col("all") + KAPPA))
        parents = counts.groupBy("parent", "lang").agg(F.sum("n").alias("n")).groupBy("parent").agg(*by)
        parents = parents.select("parent", smooth(base).alias("above"))
        priors = counts.groupBy("host", "parent").agg(*by).join(parents, "parent").select(F.col("host").alias("at"), smooth(F.col("above")).alias("prior"))
        spread = F.coalesce("host", F.concat(F.lit("\n"), F.pmod(F.xxhash64("text"), F.lit(4096)).cast("string")))  # no host has a line end
        evidence = evidence.withColumn("at", spread).join(staged(priors, "host-priors"), "at", "left")
        evidence = evidence.withColumn("prior", F.coalesce("prior", base))
    else:
        evidence = evidence.withColumn("prior", F.array().cast("array<double>"))

    @F.arrow_udf("struct<predicted:string,posterior:double,n_bigrams:bigint,accepted:boolean>")
    def fuse(arrays: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        m = shared.value
        for texts, declared, suffix, prior in arrays:
            said, post, counts, ok = [], [], [], []
            shares = {code: suffix_shares(code, m.languages) for code in suffix.unique().to_pylist()}
            for t, d, s, p in zip(texts, declared.to_pylist(), suffix.to_pylist(), prior.to_pylist(), strict=True):
                like, n, differ = m.score(t.as_py())
                counts.append(n)
                if not n or not L:
                    said.append(None)
                    post.append(0.0)
                    ok.append(False)
                    continue
                log = np.log(np.array(p)) + TEMPER * like
                if d >= 0 and L > 1:
                    other = np.full(L, np.log((1 - TRUST) / (L - 1)))
                    other[d] = np.log(TRUST)
                    log += other
                if shares[s] is not None:
                    log += np.log(np.maximum(shares[s], 1e-300))
                best = int(log.argmax())
                top = float(1 / np.exp(log - log[best]).sum())
                said.append(m.languages[best])
                post.append(top)
                ok.append(top >= MIN_POSTERIOR and m.usual_enough(best, like[best], n, differ, d))
            yield pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(post, pa.float64()), pa.array(counts, pa.int64()), pa.array(ok, pa.bool_())], ["predicted", "posterior", "n_bigrams", "accepted"])
        release()

    names = ("predicted", "posterior", "n_bigrams", "accepted")
    out = evidence.select("row", fuse("text", "declared", "suffix", "prior").alias("found"))
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in names], *[F.col("found")[n].alias(n) for n in names])
