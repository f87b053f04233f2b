"""Token counts by a linear longest-match automaton.

A trie of the vocabulary with failure links (after Song et al., "Fast WordPiece Tokenization", 2021). Each
node keeps only how many tokens its failure pops, so a word's greedy longest-match length is found in one
pass over its bytes, without building its pieces. Pieces that open a word and pieces that continue one are
two vocabularies with two roots, as with the "##" of word-piece files.

A word that cannot be cut into pieces counts as one unknown token. Words are [^\\x20\\x09-\\x0D]+. Null and
empty texts have no words; an empty table gives an empty one; repeated rows get equal counts. Columns of the outputs'
names are replaced; others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import bound, chunks, release

#: Bytes of words whose counts a worker keeps (each takes some 120 bytes besides); beyond it, it starts anew. It bounds
#: memory, not results.
MEMO = 4_000_000
#: Characters whose words are held at once; a longer text is cut into words alone.
CHUNK = 2_000_000


class Automaton:
    """opening: pieces that start a word, without any marker; going: pieces that continue one."""

    def __init__(self, opening: set[bytes], going: set[bytes]):
        self.step: dict[int, int] = {}
        parent, byte, ends = [-1, -1], [0, 0], [False, False]
        for root, words in ((0, opening), (1, going)):
            for w in words:
                u = root
                for c in w:
                    v = self.step.get(u << 8 | c)
                    if v is None:
                        v = self.step[u << 8 | c] = len(parent)
                        parent.append(u)
                        byte.append(c)
                        ends.append(False)
                    u = v
                ends[u] = ends[u] or bool(w)
        n = len(parent)
        self.fail, self.pops = [-1] * n, [0] * n
        depth, order = [0] * n, []
        for v in range(2, n):  # a parent is made before its children
            depth[v] = depth[parent[v]] + 1
        order = sorted(range(2, n), key=depth.__getitem__)
        for v in order:
            if ends[v]:
                self.fail[v], self.pops[v] = 1, 1
                continue
            z, popped, c = self.fail[parent[v]], self.pops[parent[v]], byte[v]
            while z >= 0 and (z << 8 | c) not in self.step:
                popped += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.step[z << 8 | c], popped
        self.memo: dict[bytes, int] = {}
        self.held = 0

    def count(self, word: bytes) -> int:
        """Greedy longest-match pieces of a word; 1 if it cannot be cut."""
        step, fail, pops = self.step, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := step.get(u << 8 | c)) is None:
                n += pops[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = v
        while u > 1:
            n += pops[u]
            u = fail[u]
            if u < 0:
                return 1
        return n

    def counts(self, words: list[bytes]) -> int:
        memo = self.memo
        for w in set(words):
            if w not in memo:
                memo[w] = self.count(w)
                self.held += len(w)
        return sum(map(memo.__getitem__, words))


def marked_vocabulary(tokens: list[bytes], marker: bytes = b" ") -> tuple[set[bytes], set[bytes]]:
    """Of a vocabulary whose word openers carry a leading marker: the openers without it, and the rest,
    which continue words. Single bytes may do either, so that every word can be cut."""
    opening = {t[len(marker) :] for t in tokens if t.startswith(marker) and len(t) > len(marker)}
    going = {t for t in tokens if t and not t.startswith(marker)}
    return opening | {t for t in going if len(t) == 1}, going


class Vocabulary:
    """Both sets of pieces; a worker builds the automaton once."""

    def __init__(self, opening: set[bytes], going: set[bytes]):
        self.sets, self._automaton = (opening, going), None

    def __getstate__(self):
        return {"sets": self.sets, "_automaton": None}

    def automaton(self) -> Automaton:
        if self._automaton is None:
            self._automaton = Automaton(*self.sets)
        return self._automaton


def load(spark: SparkSession, path: str):
    return bound(spark, Vocabulary(*marked_vocabulary(read_ranks(path))))


def count_tokens(df: DataFrame, vocabulary, text: str = "text", words: str = "n_words", tokens: str = "n_tokens") -> DataFrame:
    """Adds the number of words and of greedy word pieces of a text. vocabulary: what load() returned."""

    @F.arrow_udf("struct<words:bigint,tokens:bigint>")
    def count(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = vocabulary.value.automaton()
        for a in arrays:
            texts, n_words, n_tokens = a.to_pylist(), [], []
            for s, e in chunks([len(t or "") for t in texts], CHUNK):
                if auto.held > MEMO:
                    auto.memo.clear()
                    auto.held = 0
                for t in texts[s:e]:
                    w = t.encode().split() if t else []
                    n_words.append(len(w))
                    n_tokens.append(auto.counts(w))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["words", "tokens"])
        release()

    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), count(F.coalesce(df[text], F.lit(""))).alias("n"))
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in (words, tokens)], F.col("n.words").alias(words), F.col("n.tokens").alias(tokens))
