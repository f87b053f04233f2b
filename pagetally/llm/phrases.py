"""Phrase collocations by Suffix-sigma.

Texts are lower-cased (A-Z only), cut into pieces at BREAKS and these into words at blanks and tabs. Every position of
a piece is a suffix, truncated to `longest` words. Suffixes are shuffled by language and first word and sorted in
reverse order, so that all that begin alike are neighbours, longer ones first: one stack of at most `longest` counts
then gives the count of every prefix, that is of every phrase. (Counts within a batch are sums over runs of neighbours;
the stack is what a batch leaves open to the next.) Counts of a phrase's parts are joined afterwards.

Four things keep the shuffle small and even, and none changes a count:

* Words are counted first. A word under the least count is in no candidate, so pieces are cut there. Frequent words are
  numbered, the most frequent first, as small numbers shuffle best; tasks know them by their 64-bit hashes, 12 bytes a
  frequent word. The salt of the hashes is one with which no other word of the table has the hash of a frequent one, so
  numbers are exact.
* Triples of frequent words, and pairs without a third one, are dealt by their pair as numbers, counted by ordinary
  aggregations (a pair by all that begins with it) and named by joins. Only
  suffixes of LEAST_SENT words and more travel as text, and only those all of whose triples are frequent. Tasks know the
  frequent triples by one bit each of a map of FILTER_BITS, so what is broadcast of them has a fixed size; triples that
  share a bit by chance only send more suffixes.
* Equal suffixes of a task travel once, with their number.
* A beginning of one to `longest` - 1 words that more suffixes have than a SLICE-th of a partition, judged by every
  SOME-th section of text, is hot; there are at most SLICE a partition of each length. Suffixes are dealt by their
  longest hot beginning and the word after it, so only hot beginnings are in more than one task; their counts are summed
  before the least count is asked for.

A candidate inside any longer candidate of the same count is also inside one that is one word longer and has that count,
since counts only fall as phrases grow: so it is enough to look at what each candidate leaves without its first or last
word. Scores are exact: 1000 * a * n has up to 38 digits.

Null texts are empty, a null language is `und`, repeated rows count each. Empty texts and tables have no phrases. Texts
of any length are read in pieces. Only lang and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_schema, bound, n_parts, release, schema, segments, staged

FILTER_BITS = 1 << 27
#: Words of the shortest suffixes that travel as text; shorter phrases are counted as numbers of words.
LEAST_SENT = 4
SLICE = 4
SOME = 32
#: Words are counted, and remembered, in a task's memory up to so many before they are passed on; suffixes likewise.
HELD = 200_000
HELD_SUFFIXES = 4_000_000
#: Of a text, cut at the next break.
AT_ONCE = 1 << 20
BREAKS = re.compile(rb"[.,;:!?\n-\r]")
_TO_BREAK = bytes(0 if BREAKS.match(bytes([i])) else i for i in range(256))
BREAK = b"\0"
#: n_words 0: a word, counted; 1 and more: a beginning, counted in some sections (the empty one: all words of these).
COUNTS = schema("lang string, n_words int, word binary, n bigint")
#: pair: the numbers of its first two words, 32 bits each; third: that of its third word, 0 for none.
GRAMS = schema("pair bigint, third int, n bigint")
NUMBERED = schema("lang string, word binary, n bigint, id int")
SUFFIXES = schema("lang string, dealt bigint, hot int, suffix binary, n bigint")
PHRASES = schema("lang string, phrase binary, n_words int, n bigint, whole boolean")


def _sections(text: bytes) -> Iterator[bytes]:
    """A text in sections of about AT_ONCE bytes that end at breaks, so no piece is cut."""
    start = 0
    while len(text) - start > AT_ONCE:
        end = BREAKS.search(text, start + AT_ONCE)
        if end is None:
            break
        yield text[start : end.start()]
        start = end.end()
    yield text[start:]


def _coded(text: bytes) -> bytes:
    """Bytes 0 and 1 are spelled otherwise, so that 0 separates words: it is less than any byte of a word, as sorting needs."""
    return text.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in text or b"\1" in text else text


def _plain(phrase: bytes) -> bytes:
    phrase = phrase.replace(b"\0", b" ")
    return re.sub(b"\1([\1\2])", lambda m: b"\0" if m[1] == b"\1" else b"\1", phrase) if b"\1" in phrase else phrase


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece; after the breaks, only blanks and tabs are left for split."""
    for section in _sections(text):
        for piece in BREAKS.split(_coded(section.lower())):
            if words := piece.split():
                yield words


def tokens(section: bytes) -> list[bytes]:
    """All words of a section, with a BREAK wherever a piece ends."""
    return _coded(section.lower()).translate(_TO_BREAK).replace(BREAK, b" \0 ").split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        lang, text = b.columns
        for i in range(len(b)):
            yield lang[i].as_py(), text[i].as_buffer().to_pybytes() if text[i].is_valid else b""


def _words(longest: int, slices: int):
    """Words with their numbers; and from every SOME-th section, beginnings that may be hot with theirs."""
    shape = arrow_schema(COUNTS)

    def counted(held: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, n_words), own in held.items():
            if not n_words:
                del own[BREAK]
            least = max(2, held[lang, 1][b""] / (4 * slices)) if n_words else 0
            items = [(w, n) for w, n in own.items() if n >= least or not w]
            for s in range(0, len(items), 10_000):
                some = items[s : s + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(some), f.type) if k < 2 else pa.array([i[k - 2] for i in some], f.type) for k, (x, f) in enumerate(zip((lang, n_words, 0, 0), shape, strict=True))], schema=shape)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[tuple[str, int], Counter] = defaultdict(Counter)
        sections = 0
        for lang, text in _texts(batches):
            for section in _sections(text):
                held[lang, 0].update(tokens(section))
                if sections % SOME == 0:
                    found = list(pieces(section))
                    held[lang, 1][b""] += sum(map(len, found))
                    for k in range(1, longest):
                        held[lang, k].update(b"\0".join(words[i : i + k]) for words in found for i in range(len(words) - k + 1))
                sections += 1
                if sum(map(len, held.values())) > HELD:
                    yield from counted(held)
        yield from counted(held)
        release()

    return run


def _hash(salt: int) -> Column:
    return F.xxhash64(F.lit(str(salt)), "lang", "word")


def _seed(salt: int, lang: str) -> int:
    """xxh64 of a word with this seed is what _hash gives."""
    return xxhash.xxh64_intdigest(lang, xxhash.xxh64_intdigest(str(salt), 42))


class _Numbers:
    """Frequent words of all languages, known by their hashes, in order: numbers from 1, the most frequent word's."""

    def __init__(self, salt: int, hashes: np.ndarray, n: np.ndarray):
        order = np.argsort(hashes)
        self.salt, self.hashes, self.ids = salt, hashes[order], np.empty(len(n), np.int32)
        self.ids[np.argsort(-n[order], kind="stable")] = np.arange(1, len(n) + 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of some hashes; 0 for those of no frequent word."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], 0)

    def bits(self) -> np.ndarray:
        """A map that spares most searches for other words."""
        own, at = np.zeros(FILTER_BITS // 64, np.uint64), self.hashes.view(np.uint64) % np.uint64(FILTER_BITS)
        np.bitwise_or.at(own, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return own


def _met(numbers):
    """Of words' hashes, those of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(numbers.value.of(b.column(0).to_numpy()) > 0))

    return run


def _numbers(words: DataFrame, common: DataFrame):
    """The broadcast numbers of common words, by the first salt with which no other word has the hash of one of them."""
    for salt in itertools.count():
        own = _hash(salt).alias("hash")
        hashes, n = (c.to_numpy() for c in common.select(own, "n").toArrow().columns)
        numbers = bound(common.sparkSession, _Numbers(salt, hashes, n))
        if words.select(own).mapInArrow(_met(numbers), "hash bigint").count() == len(n):
            return numbers


def _numbered(numbers):
    shape = arrow_schema(NUMBERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(numbers.value.of(b.column(3).to_numpy()))], schema=shape)

    return run


def _triple_bits(pair: np.ndarray, third: np.ndarray) -> np.ndarray:
    x = pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + third.astype(np.uint64)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.int64) % FILTER_BITS


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of triples (pair, third), as those 64-bit parts of the map that are not 0."""
    own = np.zeros(FILTER_BITS // 64, np.uint64)
    for b in batches:
        at = _triple_bits(b.column(0).to_numpy(), b.column(1).to_numpy())
        np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    at = np.flatnonzero(own)
    for s in range(0, len(at), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 65536], pa.int64()), pa.array(own[at[s : s + 65536]].view(np.int64))], names=["at", "bits"])


def _bit_map(triples: DataFrame) -> np.ndarray:
    """The map of all given triples (pair, third)."""
    own = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in triples.mapInArrow(_bits, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # at most FILTER_BITS / 64
        own[r.at] = r.bits & (1 << 64) - 1
    return own


class _Codes(dict):
    """A task's own numbers of its frequent words, from 1; 0 for all others."""

    def __init__(self, lang: str, numbers: _Numbers, bits: np.ndarray, hot: list[tuple[bytes, ...]]):
        """hot: hot beginnings, by length."""
        self.lang, self.seed, self.numbers, self.bits = lang, _seed(numbers.salt, lang), numbers, bits
        #: Of each own number: the word, its hash and its number among all frequent words.
        self.words, self.hashes, self.ids = [b""], [0], [0]
        self[BREAK] = 0
        #: Of each length of hot beginnings: the one without its last word (by its place, from 1) and that word, in order.
        self.levels: list[np.ndarray] = []
        places: dict[tuple[bytes, ...], int] = {(): 0}
        for k in range(1, max(map(len, hot), default=0) + 1):
            own = sorted((places[h[:-1]] << 32 | self[h[-1]], h) for h in hot if len(h) == k and h[:-1] in places and self[h[-1]])
            places |= {h: i + 1 for i, (_, h) in enumerate(own)}
            self.levels.append(np.array([x for x, _ in own], np.int64))

    def __missing__(self, word: bytes) -> int:
        own = xxhash.xxh64_intdigest(word, self.seed)
        at, self[word] = own % FILTER_BITS, 0
        if int(self.bits[at >> 6]) >> (at & 63) & 1:
            known, signed = self.numbers.hashes, own - (own >> 63 << 64)
            place = bisect_left(known, signed)
            if place < len(known) and known[place] == signed:
                self[word] = len(self.words)
                self.words.append(word)
                self.hashes.append(own)
                self.ids.append(int(self.numbers.ids[place]))
        return self[word]


def _together(codes: _Codes, sections: list[np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of some sections as the task's numbers; where two frequent words stand together, and these, the third word
    and the third word's presence, as numbers among all frequent words."""
    x = np.concatenate([*sections, np.zeros(longest, np.int32)])
    ids = np.array(codes.ids, np.int64)[x]
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    third = ids[at + 2]
    return x, at, ids[at] << 32 | ids[at + 1], third, third > 0


def _counted_grams(codes: _Codes, sections: list[np.ndarray], longest: int, shape: pa.Schema, triples: None) -> Iterator[pa.RecordBatch]:
    """The different triples of frequent words of some sections, and pairs without a third one, with their numbers."""
    _, _, pair, third, _ = _together(codes, sections, longest)
    pairs, place = np.unique(pair, return_inverse=True)
    found, n = np.unique(place << 32 | third, return_counts=True)
    for s in range(0, len(n), 65536):
        some = found[s : s + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[some >> 32]), pa.array(some.astype(np.int32)), pa.array(n[s : s + 65536], pa.int64())], schema=shape)


def _sent(codes: _Codes, sections: list[np.ndarray], longest: int, shape: pa.Schema, triples: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The different suffixes of LEAST_SENT words and more of some sections, all of whose words and triples are frequent:
    with their numbers, and where they go."""
    x, at, pair, third, has = _together(codes, sections, longest)
    words, hashes, linked = pa.array(codes.words, pa.binary()), np.array(codes.hashes, np.uint64), np.zeros(len(x), bool)
    linked[at[has]] = _is_set(triples, _triple_bits(pair[has], third[has]))
    at = np.flatnonzero(linked[:-1] & linked[1:])
    if not len(at):
        return
    columns = [x[at + k] for k in range(LEAST_SENT)]
    for k in range(LEAST_SENT, longest):
        columns.append(np.where((columns[-1] > 0) & linked[at + k - 2], x[at + k], 0))
    names = [f"w{k}" for k in range(longest)]
    grouped = pa.table(dict(zip(names, map(pa.array, columns), strict=True))).group_by(names, use_threads=False).aggregate([([], "count_all")])
    columns, n = [grouped[name].to_numpy() for name in names], grouped["count_all"].to_numpy()
    hot, place, key = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), hashes[columns[0]]
    for k, level in enumerate(codes.levels):
        asked = place << 32 | columns[k]
        found = np.searchsorted(level, asked)
        here = (hot == k) & (columns[k] > 0) & (level[np.minimum(found, max(0, len(level) - 1))] == asked if len(level) else False)
        hot, place = np.where(here, k + 1, hot), np.where(here, found + 1, 0)
        if k + 1 < longest:
            key = np.where(here, key * np.uint64(0x9E3779B97F4A7C15) + hashes[columns[k + 1]], key)
    for s in range(0, len(n), 10_000):
        taken = [words.take(pa.array(np.where(c[s : s + 10_000] > 0, c[s : s + 10_000], 0))) if k < LEAST_SENT else words.take(pa.array(c[s : s + 10_000], mask=c[s : s + 10_000] == 0)) for k, c in enumerate(columns)]
        suffix = pc.binary_join_element_wise(*taken, pa.scalar(b"\0", pa.binary()), null_handling="skip")
        end = s + len(suffix)
        yield pa.RecordBatch.from_arrays([pa.array([codes.lang] * len(suffix)), pa.array(key[s:end].view(np.int64)), pa.array(hot[s:end], pa.int32()), suffix, pa.array(n[s:end], pa.int64())], schema=shape)


def _from_sections(numbers, hot, longest: int, kind: T.StructType, made, triples=None):
    """made(codes, sections, longest, shape, triples) of many sections of a language at once."""
    shape = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Codes] = {}
        bits = numbers.value.bits()
        held: dict[str, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, sections in held.items():
                yield from made(known[lang], sections, longest, shape, triples and triples.value)
                if len(known[lang]) > HELD:
                    del known[lang]
            held.clear()

        size = 0
        for lang, text in _texts(batches):
            for section in _sections(text):
                if lang not in known:
                    known[lang] = _Codes(lang, numbers.value, bits, hot.value.get(lang, []))
                found = tokens(section)
                held.setdefault(lang, []).append(np.fromiter(map(known[lang].__getitem__, found), np.int32, len(found)))
                held[lang].append(np.zeros(1, np.int32))
                size += len(found)
                if size > HELD_SUFFIXES:
                    yield from out()
                    size = 0
        yield from out()
        release()

    return run


def _count(least: int, longest: int):
    """Counts of all prefixes of LEAST_SENT words or more, from suffixes in reverse order within a language."""
    shape = arrow_schema(PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        lang, stack, counts, hot = None, [], [], 0  # the words that the last suffix has left open, and their prefixes' counts

        def closed(words: list[bytes], k: int, n: int, hot: int) -> None:
            if n >= least or k <= hot:
                out.append((lang, b"\0".join(words[:k]), k, n, k > hot))

        def pop(to: int) -> None:
            while len(stack) > to:
                if len(stack) >= LEAST_SENT:
                    closed(stack, len(stack), counts[-1], hot)
                stack.pop()
                counts.pop()

        for whole in batches:
            for (now,), b in segments([whole], ["lang"]):
                if now != lang:
                    pop(0)
                    lang = now
                n, depth_hot = b.column(4).to_numpy(), b.column(2).to_numpy()
                split = pc.split_pattern(b.column(3), pattern=b"\0")
                ends, codes = split.offsets.to_numpy(), split.flatten().dictionary_encode()
                ends = ends - ends[0]
                words, codes = codes.dictionary, codes.indices.to_numpy()
                sizes = np.diff(ends)
                table = np.full((longest, len(n)), -1, np.int64)
                table[np.arange(len(codes)) - np.repeat(ends[:-1], sizes), np.repeat(np.arange(len(n)), sizes)] = codes
                spelled = lambda row: words.take(pa.array(table[: sizes[row], row])).to_pylist()  # noqa: E731, B023
                first, last = spelled(0), spelled(len(n) - 1)
                same = next((k for k, (x, y) in enumerate(zip(stack, first)) if x != y), min(len(stack), len(first)))
                pop(same)
                opened = []
                alike = np.ones(len(n), bool)  # to the row before, so far
                alike[0] = False
                for k in range(1, longest + 1):
                    there = table[k - 1] >= 0
                    alike[1:] &= table[k - 1, 1:] == table[k - 1, :-1]
                    starts = np.flatnonzero(there & ~alike)
                    if not len(starts):
                        break
                    sums = np.add.reduceat(np.where(there, n, 0), starts)
                    if k <= same:  # the first run goes on from the batch before
                        sums[0] += counts[k - 1]
                    if k <= len(last):
                        opened.append(int(sums[-1]))
                        starts, sums = starts[:-1], sums[:-1]
                    if k >= LEAST_SENT:
                        for i in np.flatnonzero((sums >= least) | (depth_hot[starts] >= k)).tolist():
                            closed(spelled(starts[i]), k, int(sums[i]), int(depth_hot[starts[i]]))
                stack, counts, hot = last, opened, int(depth_hot[-1])
            while len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[:10_000], strict=True), shape, strict=True)], schema=shape)
                del out[:10_000]
        pop(0)
        for s in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[s : s + 10_000], strict=True), shape, strict=True)], schema=shape)
        release()

    return run


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words that occur `least` times or more in a language (lang, phrase: words joined by a
    byte 0, n_words, n), and the number of words by language (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    slices = SLICE * n_parts(spark)
    found = staged(rows.mapInArrow(_words(longest, slices), COUNTS).groupBy("lang", "n_words", "word").agg(F.sum("n").alias("n")), "words")
    words, begun = found.filter("n_words = 0").drop("n_words"), found.filter("n_words > 0")
    sizes = staged(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    common = words.filter(F.col("n") >= least)

    total = begun.filter("length(word) = 0").agg(F.sum("n")).first()[0] or 0
    hot: dict[str, list[tuple[bytes, ...]]] = {}
    for r in begun.filter("length(word) > 0 and n >= 32").filter(F.col("n") * slices >= total).select("lang", "word").collect():  # at most `slices` of each length
        hot.setdefault(r.lang, []).append(tuple(bytes(r.word).split(b"\0")))
    numbers, hot = _numbers(words, common), bound(spark, hot)
    dealt = rows.mapInArrow(_from_sections(numbers, hot, longest, GRAMS, _counted_grams), GRAMS).repartition(n_parts(spark), "pair")
    # Both sums read all columns and filter afterwards, so that they share one exchange.
    pairs = dealt.groupBy("pair").agg(F.sum(F.when(F.col("third") >= 0, F.col("n"))).alias("n")).select("pair", F.lit(0).alias("third"), "n").filter(F.col("n") >= least)
    triples = dealt.groupBy("pair", "third").agg(F.sum("n").alias("n")).filter(F.when(F.col("third") > 0, F.col("n")) >= least)
    grams = staged(pairs.unionByName(triples) if longest > 2 else pairs, "grams")
    numbered = staged(common.select("lang", "word", "n", _hash(numbers.value.salt).alias("hash")).mapInArrow(_numbered(numbers), NUMBERED), "numbered")
    phrases = numbered.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), "n").unionByName(_named(grams, numbered))
    if longest >= LEAST_SENT:
        triples = bound(spark, _bit_map(grams.filter("third > 0").select("pair", "third")))
        suffixes = rows.mapInArrow(_from_sections(numbers, hot, longest, SUFFIXES, _sent, triples), SUFFIXES)
        dealt = suffixes.repartition(n_parts(spark), "dealt").sortWithinPartitions("lang", F.desc("suffix"))
        counted = staged(dealt.mapInArrow(_count(least, longest), PHRASES), "prefix-counts")
        summed = counted.filter("not whole").groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        phrases = phrases.unionByName(counted.filter("whole").drop("whole")).unionByName(summed)
    return staged(phrases, "phrases"), sizes


def _named(grams: DataFrame, numbered: DataFrame) -> DataFrame:
    """Pairs and triples by their words."""
    word = lambda k: numbered.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}"), *(["lang"] if k == 1 else []))
    own = grams.select(F.shiftright("pair", 32).cast("int").alias("id1"), F.col("pair").bitwiseAND((1 << 32) - 1).cast("int").alias("id2"), F.col("third").alias("id3"), "n")
    own = own.join(word(1), "id1").join(word(2), "id2").join(word(3), "id3", "left")
    apart, three = F.unhex(F.lit("00")), F.col("id3") > 0
    pair = F.concat("word1", apart, "word2")
    return own.select("lang", F.when(three, F.concat(pair, apart, "word3")).otherwise(pair).alias("phrase"), F.when(three, 3).otherwise(2).alias("n_words"), "n")


CUTS = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("first", T.BinaryType()), T.StructField("rest", T.BinaryType())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds every cut of a phrase: its first k words and the rest."""
    kind = pa.list_(pa.struct([("k", pa.int32()), ("first", pa.binary()), ("rest", pa.binary())]))

    def cuts(p: bytes) -> list[dict]:
        words = p.split(b"\0")
        return [{"k": k, "first": b"\0".join(words[:k]), "rest": b"\0".join(words[k:])} for k in range(1, len(words))]

    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([cuts(p) for p in b.column(1).to_pylist()], kind)], names=[*b.schema.names, "cuts"])


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases as text, words separated by blanks."""
    for b in batches:
        spelled = pa.array([_plain(p).decode("utf-8", "replace") for p in b.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), spelled, *b.columns[2:]], names=b.schema.names)


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    big = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (big(a) * big(n)).cast("decimal(34,0)"), big(left) * big(right))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` best phrases of each language, by their weakest cut."""
    phrases, sizes = phrase_counts(docs, least, longest, lang, text)
    many = phrases.filter("n_words > 1")
    candidates = staged(many.mapInArrow(_cut, T.StructType([*many.schema, T.StructField("cuts", CUTS)])), "candidates")
    cut = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode("cuts").alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    both = both.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("m"))
    last = F.element_at("cuts", -1)
    inner = candidates.filter("n_words > 2").select("lang", F.col("n").alias("a"), F.explode(F.array(last["first"], F.col("cuts")[0]["rest"])).alias("phrase")).distinct()
    kept = best.join(inner, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "m.l", "m.r", "m.n", "m.score")
    kept = kept.mapInArrow(_spell, T.StructType([T.StructField(f.name, T.StringType()) if f.name == "phrase" else f for f in kept.schema]))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for key in ([F.col("lang"), F.pmod(F.xxhash64("phrase"), F.lit(64))], [F.col("lang")]):  # first within 64 parts of each language
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= most)
    return kept.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
