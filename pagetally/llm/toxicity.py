"""Toxic spans and documents by a linear-chain conditional random field.

The field has two tags, clean and toxic. What a word adds to its tag are weights of hashed features: the word, its
beginnings and ends, and the words before and after it. Forward and backward messages are 2 x 2 matrix products over the
texts of a batch laid end to end, in blocks, so the number of steps is about the square root of the words. Words whose
marginal is SURE or more make spans (code points, neighbours joined). A document's score is a logistic function of what
its marginals add up to, of the largest, of how many different words are behind them, and of its length.

Tokens are labelled from documents' labels: in toxic documents, words with a feature that marks toxic documents (a
likelihood ratio over all labelled documents of the sample, and odds of MARKED or more); in clean ones, none. The score's
function is fitted on marginals of documents that the field had not seen, FOLDS times, weighted to the labelled rows'
share of toxic ones. Sampled are about PER_CLASS documents of each class at most, those whose ids have the smallest
hashes, and of no more than LONGEST characters. Fitting runs on the driver, within these bounds. Scoring reads whole
texts; what is broadcast is BUCKETS weights.

Null and empty texts have no words: their score is the function's constant, and they have no spans. Words are lower-cased runs of
letters and digits. Rows that repeat an id or text get equal scores. A document is toxic in training if any of its labels
says so; null labels and ids say nothing. Of near copies in the sample one is fitted on. Where either class has no document in the sample, every score is the labelled
share of toxic ones (0 without labels). An empty table gives an empty one. Only id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound, pieces, release

PER_CLASS = 1500
LONGEST = 16_000
BUCKETS = 1 << 20
FOLDS = 3
KEPT, ALIKE = 16, 5
ROUNDS = 16
SURE = 0.5
THRESHOLD = 0.3
MARKED = 3.0
EVIDENCE = 8.0
#: Of code points, and words that are remembered.
AT_ONCE = 1 << 20
REMEMBERED = 300_000
WORD = re.compile(r"[^\W_]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
#: Lengths of beginnings and ends, in bytes, each hashed with its own seed.
_BEGINS, _ENDS = ((3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (9, 9)), ((13, 3), (15, 5))


def word_features(word: str) -> list[int]:
    """Buckets of a word: the word, its beginnings, its ends (those longer than the word are the word again)."""
    w, crc = word.lower().encode("utf-8", "surrogatepass"), zlib.crc32
    return [crc(w, 1) % BUCKETS, *[crc(w[:n], seed) % BUCKETS for seed, n in _BEGINS], *[crc(w[-n:], seed) % BUCKETS for seed, n in _ENDS]]


def near_features(word: str) -> tuple[int, int]:
    """Buckets of a word as the one before another, and after."""
    w = word.lower().encode("utf-8", "surrogatepass")
    return zlib.crc32(w, 40) % BUCKETS, zlib.crc32(w, 41) % BUCKETS


def messages(e: np.ndarray, starts: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages, (n, 2) each and of sum 1, of sequences laid end to end. e: what the toxic tag adds to
    a word; starts: where sequences start; steps, first: potentials of tag pairs and of first tags."""
    n = len(e)
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    m = np.zeros((2, 2, blocks * length))
    m[0, 0, n:] = m[1, 1, n:] = 1  # padding changes nothing
    psi = np.exp(np.clip(e, -30, 30))
    for i in (0, 1):
        m[i, 0, :n] = np.where(starts, first[0], steps[i, 0])
        m[i, 1, :n] = np.where(starts, first[1], steps[i, 1]) * psi
    m = np.ascontiguousarray(m.reshape(2, 2, blocks, length).transpose(3, 0, 1, 2))
    m /= m.sum(axis=(1, 2), keepdims=True)
    whole = np.zeros((2, 2, blocks))
    whole[0, 0] = whole[1, 1] = 1
    for x in m:
        whole = np.stack([[whole[i, 0] * x[0, j] + whole[i, 1] * x[1, j] for j in (0, 1)] for i in (0, 1)])
        whole /= whole.sum(axis=(0, 1))
    ahead, behind = np.empty((2, blocks)), np.empty((2, blocks))
    a = np.array([0.5, 0.5])
    for b in range(blocks):
        ahead[:, b] = a
        a = a @ whole[:, :, b]
        a /= a.sum()
    a = np.array([0.5, 0.5])
    for b in range(blocks - 1, -1, -1):
        behind[:, b] = a
        a = whole[:, :, b] @ a
        a /= a.sum()
    forward, backward = np.empty((length, 2, blocks)), np.empty((length, 2, blocks))
    for s in range(length):
        x = m[s]
        ahead = np.stack([ahead[0] * x[0, 0] + ahead[1] * x[1, 0], ahead[0] * x[0, 1] + ahead[1] * x[1, 1]])
        ahead /= ahead.sum(axis=0)
        forward[s] = ahead
    for s in range(length - 1, -1, -1):
        backward[s] = behind
        x = m[s]
        behind = np.stack([x[0, 0] * behind[0] + x[0, 1] * behind[1], x[1, 0] * behind[0] + x[1, 1] * behind[1]])
        behind /= behind.sum(axis=0)
    flat = lambda y: y.transpose(2, 0, 1).reshape(-1, 2)[:n]
    return flat(forward), flat(backward)


def marginals(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """How likely each word's tag is toxic."""
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def summary(p: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row for each document: what the clear marginals of its different words add up to (a word that is repeated says
    nothing new), the largest marginal, what all but the least add up to for its length, and its length as far as there
    is anything clear to weigh it against. words: a number for each word; sizes: words of each document."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), 5))
    out[:, 0] = 1
    np.maximum.at(out[:, 2], doc, p)
    at = np.flatnonzero(p > 0.001)
    if len(at):
        order = at[np.lexsort((-p[at], words[at], doc[at]))]
        first = order[np.append(True, (doc[order][1:] != doc[order][:-1]) | (words[order][1:] != words[order][:-1]))]
        clear = first[p[first] > 0.02]
        out[:, 1] = np.log1p(20 * np.bincount(doc[clear], p[clear], len(sizes)))
        out[:, 3] = 5 * np.bincount(doc[first], p[first], len(sizes)) / np.sqrt(1 + sizes)
    out[:, 4] = np.log1p(sizes) / 5 * np.minimum(1, out[:, 1])
    return out


class Field:
    def __init__(self):
        self.weights, self.steps, self.first = np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2)
        self.judge, self.share = np.zeros(5), 0.0

    def added(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What the toxic tag adds to each word: by itself, by the word before and the one after."""
        e = own.copy()
        inner = ~starts[1:]
        e[1:] += np.where(inner, before[:-1], 0)
        e[:-1] += np.where(inner, after[1:], 0)
        return e

    def judged(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows @ self.judge, -30, 30)))


class Corpus:
    """Labelled documents as numbers of words: texts are few and short enough for the driver."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        place: dict[str, int] = {}
        docs = [np.array([place.setdefault(w, len(place)) for w in WORD.findall(t.lower())], np.int64) for t in texts]
        self.docs, self.toxic = docs, toxic
        self.own = np.array([word_features(w) for w in place], np.int64).reshape(len(place), 1 + len(_BEGINS) + len(_ENDS))
        self.near = np.array([near_features(w) for w in place], np.int64).reshape(len(place), 2)

    def marked(self, docs: list[int]) -> np.ndarray:
        """Whether a word has a feature that marks toxic documents among these."""
        n = np.zeros((2, BUCKETS))
        for d in docs:
            n[int(self.toxic[d]), np.unique(self.own[np.unique(self.docs[d])])] += 1
        all1 = max(1, sum(bool(self.toxic[d]) for d in docs))
        all0 = max(1, len(docs) - all1)
        p1, p0 = (n[1] + 0.5) / (all1 + 1), (n[0] + 0.5) / (all0 + 1)
        q = all1 / (all1 + all0)
        share = n[1] / np.maximum(1, n[0] + n[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            g = n[1] * np.log(share / q) + np.where(n[0] > 0, n[0] * np.log((1 - share) / (1 - q)), 0)
        return ((p1 / p0 >= MARKED) & (np.nan_to_num(g) >= EVIDENCE) & (n[1] > 1))[self.own].any(axis=1)

    def flat(self, docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.concatenate([self.docs[d] for d in docs] or [np.empty(0, np.int64)])
        sizes = np.array([len(self.docs[d]) for d in docs], np.int64)
        starts = np.zeros(len(words), bool)
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return words, sizes, starts

    def batches(self, docs: list[int], most: int = 400_000) -> Iterator[list[int]]:
        some, n = [], 0
        for d in docs:
            some.append(d)
            n += len(self.docs[d])
            if n > most:
                yield some
                some, n = [], 0
        if some:
            yield some


def _trained(corpus: Corpus, docs: list[int]) -> Field:
    """The field of the greatest likelihood, by AdaGrad over all documents a round, a little held back by weights' size."""
    field, marked = Field(), corpus.marked(docs)
    field.steps[:] = [[0, -2], [0, 0]]
    field.first[:] = [0, -2]
    w, squares, tag_squares = field.weights, np.full(BUCKETS, 1e-6), np.full(6, 1e-6)
    tagged = []
    for some in corpus.batches(docs):
        words, sizes, starts = corpus.flat(some)
        if len(words):
            tagged.append((words, starts, marked[words] & np.repeat(corpus.toxic[some], sizes)))
    for _ in range(ROUNDS):
        own, before, after = w[corpus.own].sum(axis=1), w[corpus.near[:, 0]], w[corpus.near[:, 1]]
        slope, tags = np.zeros(BUCKETS), np.zeros(6)
        for words, starts, y in tagged:
            steps = np.exp(field.steps)
            e = field.added(own[words], before[words], after[words], starts)
            forward, backward = messages(e, starts, steps, np.exp(field.first))
            off = y - marginals(forward, backward)
            each = np.bincount(words, off, len(own))
            slope += np.bincount(corpus.own.ravel(), np.repeat(each, corpus.own.shape[1]), BUCKETS)
            inner = np.flatnonzero(~starts[1:])
            slope += np.bincount(corpus.near[words[inner], 0], off[inner + 1], BUCKETS) + np.bincount(corpus.near[words[inner + 1], 1], off[inner], BUCKETS)
            psi = np.exp(np.clip(e[inner + 1], -30, 30))
            pair = forward[inner][:, :, None] * steps[None] * (backward[inner + 1] * np.stack([np.ones(len(inner)), psi], axis=1))[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            seen = np.bincount(2 * y[inner] + y[inner + 1], minlength=4)
            head = off[starts].sum()
            tags += np.concatenate([seen - pair.sum(axis=0).ravel(), [-head, head]])
        slope -= 0.01 * w
        squares += slope**2
        w += 0.4 * slope / np.sqrt(squares)
        tag_squares += tags**2
        step = 0.2 * tags / np.sqrt(tag_squares)
        field.steps += step[:4].reshape(2, 2)
        field.first += step[4:]
    return field


def _summaries(corpus: Corpus, field: Field, docs: list[int]) -> np.ndarray:
    own, before, after = (field.weights[x] for x in (corpus.own, corpus.near[:, 0], corpus.near[:, 1]))
    own, out = own.sum(axis=1), [np.empty((0, 5))]
    for some in corpus.batches(docs):
        words, sizes, starts = corpus.flat(some)
        p = marginals(*messages(field.added(own[words], before[words], after[words], starts), starts, np.exp(field.steps), np.exp(field.first))) if len(words) else np.empty(0)
        out.append(summary(p, words, sizes))
    return np.concatenate(out)


def _judge(rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic function by Newton's method, held back a little (but for the constant)."""
    w, ridge = np.zeros(rows.shape[1]), np.diag([1e-3] + [0.02 * weight.sum() / len(y)] * (rows.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (weight * (y - p)) - ridge @ w
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + ridge
        step = np.linalg.solve(bend, slope)
        w += step * min(1, 4 / max(1e-9, float(np.abs(step).max())))
    return w


def different(texts: list[str]) -> list[int]:
    """Places of texts that are no near copies of an earlier one: of the KEPT smallest hashes of their five-word shingles,
    copies have ALIKE or more in common. (A group of copies would make all of its words look like marks.)"""
    first: defaultdict[int, list[int]] = defaultdict(list)
    out = []
    for i, text in enumerate(texts):
        words = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in WORD.findall(text.lower())]
        shingles = {hash(tuple(words[k : k + 5])) for k in range(max(1, len(words) - 4))}
        kept = sorted(shingles)[:KEPT]
        seen = Counter(j for h in kept for j in first[h])
        if not seen or max(seen.values()) < min(ALIKE, len(kept)):
            out.append(i)
            for h in kept:
                first[h].append(i)
    return out


def fitted(texts: list[str], toxic: list[bool], share: float) -> Field:
    """A field from labelled texts; share: of toxic ones among all labelled."""
    own = different(texts)
    texts, toxic = [texts[i] for i in own], [toxic[i] for i in own]
    y = np.array(toxic, bool)
    field = Field()
    field.share = share
    if not y.any() or y.all():
        field.judge = None
        return field
    corpus = Corpus(texts, y)
    folds = [[d for d in range(len(y)) if d % FOLDS == k] for k in range(FOLDS)]
    rows, order = [], []
    for k, out in enumerate(folds):
        rest = [d for d in range(len(y)) if d % FOLDS != k]
        rows.append(_summaries(corpus, _trained(corpus, rest), out))
        order += out
    weight = np.where(y, share / y.mean(), (1 - share) / (1 - y.mean()))
    field = _trained(corpus, list(range(len(y))))
    field.share, field.judge = share, _judge(np.concatenate(rows), y[order].astype(float), weight[order])
    return field


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Field:
    """A field fitted on a sample of the documents that `labels` (id, toxic: 0 or 1) covers."""
    known = labels.filter(labels[id].isNotNull() & labels[toxic].isNotNull()).groupBy(labels[id].alias("id")).agg((F.max(labels[toxic].cast("int")) > 0).alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    if not total:
        return fitted([], [], 0.0)
    drawn = [known.filter(F.col("toxic") == kind).withColumn("draw", F.xxhash64(F.lit("toxicity"), "id")).orderBy("draw", "id").limit(PER_CLASS) for kind in (False, True)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * PER_CLASS ids
    read = docs.select(docs[id].alias("id"), docs[text].alias("text")).filter(F.length("text") <= LONGEST).join(sample, "id")
    rows = read.orderBy("draw", "text").limit(2 * PER_CLASS).select("text", "toxic").collect()
    return fitted([r.text for r in rows], [r.toxic for r in rows], counts.get(True, 0) / total)


class _Weighed(dict):
    """What a word adds by itself, to the next and to the one before; remembered by word."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> tuple[float, float, float, int]:
        w, own, (before, after) = self.weights, word_features(word), near_features(word)
        found = sum([w[x] for x in own]), w[before], w[after], own[0]
        if len(word) <= 64:
            self[word] = found
        return found


def _sections(text: str) -> Iterator[str]:
    """A text in sections of about AT_ONCE that end where no word goes on."""
    start = 0
    while len(text) - start > AT_ONCE:
        end = start + AT_ONCE
        while end < len(text) and WORD.match(text, end):
            end = WORD.match(text, end).end()
        yield text[start:end]
        start = end
    yield text[start:]


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Neighbouring words of SURE or more, from the first's start to the last's end, with the largest marginal."""
    out, before = [], -2
    sure = set(np.flatnonzero(p >= SURE).tolist())
    for i, m in enumerate(WORD.finditer(text)):
        if i in sure:
            if before == i - 1:
                out[-1] |= {"end": m.end(), "score": max(out[-1]["score"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(p[i])})
            before = i
    return out


def scored(field: Field, texts: list[str], memory: _Weighed) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and toxic spans of texts."""
    if field.judge is None:
        return np.full(len(texts), field.share), [[] for _ in texts]
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for section in _sections(text):
            found = [memory[w] for w in WORD.findall(section)]
            if len(memory) > REMEMBERED:
                memory.clear()
            if found:
                parts.append(np.array(found))
                sizes[i] += len(found)
    x = np.concatenate(parts) if parts else np.empty((0, 4))
    ends = np.cumsum(sizes)
    starts = np.zeros(len(x), bool)
    starts[(ends - sizes)[sizes > 0]] = True
    p = np.empty(0)
    if len(x):
        p = marginals(*messages(field.added(x[:, 0], x[:, 1], x[:, 2], starts), starts, np.exp(field.steps), np.exp(field.first)))
    rows = summary(p, x[:, 3], sizes)
    own = lambda i: p[ends[i] - sizes[i] : ends[i]]
    return field.judged(rows), [_spans(t, own(i)) if rows[i, 2] >= SURE else [] for i, t in enumerate(texts)]


def score_documents(docs: DataFrame, field: Field, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score (0 to 1), toxic (score >= threshold), spans (start, end, score: toxic words, in code points)."""
    rows = docs.select(docs[id].alias(id), docs[text].cast("string").alias("text"))
    shape = T.StructType([rows.schema[0], T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType()), T.StructField("spans", SPANS)])
    model = bound(docs.sparkSession, field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        memory = _Weighed(model.value.weights)
        kind = to_arrow_type(SPANS)
        for b in pieces(batches, 1, 1_000_000):
            texts = [t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else "" for t in b.column(1)]
            score, spans = scored(model.value, texts, memory)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(score >= threshold), pa.array(spans, kind)], names=shape.names)
        release()

    return rows.mapInArrow(run, shape)
