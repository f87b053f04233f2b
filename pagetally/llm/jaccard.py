"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

Rows are sets of word n-grams (64-bit hashes; equal sets are one node, so copies are one row). Two nodes
link when den * |a & b| >= num * |a | b|. All links are found; what is returned is each document's set size
and component, so no list of all pairs of a group is ever made.

Which rows can meet. By the sizes alone, linked sets differ in at most H = S * (den - num) // (den + num)
elements, S being the sum of their sizes. Elements are dealt to k > H parts by hash, so linked sets agree in
k - H parts at least. In one order of parts that all documents share (fuller parts first), the first H + 1
parts of two linked sets have one in common (prefix principle), and only those are emitted, as a 64-bit key.
k depends on the set's size class (a power of two); a set that can link upwards emits for every class in reach.
Keys of several shingles each make rows meet far less often by chance or by a passage that many share than
single shingles do.

Blocks. Rows that share a key are chained to the key's first row, which makes a star. The components of the
stars are the blocks of the product: rows of different components cannot link. A component over BLOCK rows is
multiplied star by star if that ships fewer rows (each row once a star and block) than all pairs of its blocks
do: rows of no common star share no key. Whatever is over BLOCK rows is cut up and its pieces are multiplied
pairwise, each pair in a task of its own. In a block, overlap counts are accumulated over an inverted index of
the columns, pairs below the bound are discarded, and a spanning forest of the links goes on to the components.

Keys that occur again within a piece of a batch are chained there and then, so a key that a third of all rows
share reaches the shuffle once a piece (PIECE bytes of text); a text that many rows repeat is fetched once a
partition. Memory is bounded by a batch, a piece and two blocks.

Null and empty texts have no n-grams: size 0, component the own id. A text of fewer than n words is one n-gram.
Repeated rows are copies of each other. Null ids are kept; a component's id is its smallest id that is not null.
Only id and text are read, so other columns cannot clash. Words are named by a 64-bit polynomial of random byte
values, words over LONG_WORD bytes (where such polynomials have regular collisions) and sets by XXH3. Two
different sets of one name would be taken for copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import arrow_schema, chunks, release, runs, schema, small_batches, staged
from .components import connected_components

U = np.uint64
#: Rows of a block that are multiplied in one task.
BLOCK = 512
#: Bytes of text hashed at once.
CHUNK = 1_000_000
#: Bytes of text whose keys are chained before they are written.
PIECE = 1_500_000
#: Bytes of a word beyond which it is hashed as a whole.
LONG_WORD = 128
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_held: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n - 1) modulo 2^64; those of usual lengths are kept."""
    if (out := _held.get(int(base))) is not None and len(out) >= n:
        return out[:n]
    full = max(n, CHUNK + 1)
    out = _held[int(base)] = np.empty(full, U)
    out[0] = 1
    have = 1
    while have < full:  # doubling: base^(have + i) = base^have * base^i
        more = min(have, full - have)
        np.multiply(out[:more], out[have - 1 : have] * base, out=out[have : have + more])
        have += more
    return out[:n]


def word_hashes(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of neighbouring texts (bytes raw, cut at edges), and words per text."""
    if len(raw) > 2 * CHUNK:  # one long text: cut at white space
        found, at = [], 0
        while at < len(raw):
            end = min(at + CHUNK, len(raw))
            while end < len(raw) and not _SPACE[raw[end]]:
                step = np.flatnonzero(_SPACE[raw[end : end + CHUNK]])
                end = end + int(step[0]) if len(step) else min(end + CHUNK, len(raw))
            cut = np.array([0, *(x - at for x in edges.tolist() if at < x < end), end - at])
            found.append((word_hashes(raw[at:end], cut), at, cut))
            at = end
        counts = np.zeros(len(edges) - 1, np.int64)
        for (_, per), start, cut in found:
            np.add.at(counts, np.searchsorted(edges, start + cut[:-1], "right") - 1, per)
        return np.concatenate([w for (w, _), _, _ in found]), counts
    raw = _LOWER[raw]
    letter = ~_SPACE[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = edges[(edges > 0) & (edges < len(raw))]
    first[inner] = letter[inner]
    starts = np.flatnonzero(first)
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[inner - 1] = letter[inner - 1]
    ends = np.flatnonzero(last) + 1
    per_text = np.diff(np.searchsorted(starts, edges))
    if not len(starts):
        return np.empty(0, U), per_text
    power = _powers(_BASE, len(raw) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[raw] * power[:-1])])
    back = _powers(_INVERSE, len(raw) + 1)
    words = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        words[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), LONG_WORD)
    return words, per_text


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and how many each has."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    words, per_text = word_hashes(raw, at - at[0])
    ends = np.cumsum(per_text)
    sets = []
    whole = np.zeros(max(0, len(words) - n + 1), U)
    for j in range(n if len(whole) else 0):
        whole = mix(whole * _BASE + words[j : j + len(whole)])
    for e, m in zip(ends.tolist(), per_text.tolist(), strict=True):
        if m >= n:
            own = np.sort(whole[e - m : e - n + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own if keep.all() else own[keep])
        elif m:
            short = np.full(1, m, U)
            for w in words[e - m : e]:
                short = mix(short * _BASE + w)
            sets.append(short)
        else:
            sets.append(np.empty(0, U))
    return np.concatenate(sets) if sets else np.empty(0, U), np.array([len(s) for s in sets], np.int64)


@dataclass(frozen=True)
class Bound:
    """Sets link when den * intersection >= num * union."""

    num: int
    den: int

    def differ(self, sizes: np.ndarray) -> np.ndarray:
        """Most elements in which two linked sets with this sum of sizes differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def largest(self, size: np.ndarray) -> np.ndarray:
        return size * self.den // self.num

    def reach(self, size: np.ndarray) -> np.ndarray:
        return self.differ(size + self.largest(size))

    def classes(self) -> int:
        """Size classes that a set's partners may be in, from its own upwards."""
        return 1 + int(np.ceil(np.log2(self.den / self.num)))

    def parts(self, level: np.ndarray) -> np.ndarray:
        h = self.reach((np.int64(2) << level) - 1)
        return h + 1 + (h * 7 + 19) // 20


def part_keys(sets: np.ndarray, sizes: np.ndarray, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """The keys that each set emits: (set's position, key)."""
    owner, keys = [], []
    level = np.zeros(len(sizes), np.int64)
    full = sizes > 0
    level[full] = np.frexp(sizes[full].astype(float))[1] - 1
    start = np.cumsum(sizes) - sizes
    for up in range(bound.classes()):
        own = np.flatnonzero(full if up == 0 else full & (bound.largest(sizes) >= (np.int64(1) << (level + up))))
        if not len(own):
            continue
        n, lev = sizes[own], level[own] + up
        k = bound.parts(lev)
        first = np.cumsum(k) - k
        element = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x = sets[element]
        part = ((x >> U(20)) % np.repeat(k, n).astype(U)).astype(np.int64) + np.repeat(first, n)
        total = np.zeros(int(k.sum()), U)
        np.add.at(total, part, mix(x))
        count = np.bincount(part, minlength=len(total))
        index = np.arange(len(total)) - np.repeat(first, k)
        key = mix(total + mix((np.repeat(lev, k).astype(U) << U(40)) + index.astype(U)))
        order = (np.maximum(0, 63 - count).astype(U) << U(58)) | (key >> U(6))  # fuller parts first, for all alike
        emit = bound.reach(n) + 1
        for i, (a, m, e) in enumerate(zip(first.tolist(), k.tolist(), emit.tolist(), strict=True)):
            at = np.argpartition(order[a : a + m], e - 1)[:e] + a if e < m else np.arange(a, a + m)
            owner.append(np.full(len(at), own[i]))
            keys.append(key[at])
    if not keys:
        return np.empty(0, np.int64), np.empty(0, U)
    return np.concatenate(owner), np.concatenate(keys)


def set_names(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes).tolist()
    view = memoryview(np.ascontiguousarray(sets)).cast("B") if len(sets) else b""
    return np.array([xxhash.xxh3_64_intdigest(view[8 * (e - n) : 8 * e]) for e, n in zip(ends, sizes.tolist(), strict=True)], U)


TOKENS = schema("id bigint, n bigint, text_hash bigint, node bigint, keys array<bigint>, firsts array<bigint>")


def _sets_of(texts: pa.Array, n: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    lengths = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_pylist()
    for s, e in chunks(lengths, most):
        parts = [shingle_sets(texts.slice(s + x, y - x), n) for x, y in chunks(lengths[s:e], CHUNK)]
        yield s, e, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """Values of each row; row need not be sorted."""
    order = np.argsort(row, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order]))


def _tokens(n: int, bound: Bound):
    """Of each row: id, set size, text hash, node, the keys no earlier row of the piece has, and the first rows (nodes) of its other keys."""
    out = arrow_schema(TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for s, e, sets, sizes in _sets_of(b.column(2), n, PIECE):
                names = set_names(sets, sizes).view(np.int64)
                fresh = np.zeros(e - s, bool)
                for i, (name, size) in enumerate(zip(names.tolist(), sizes.tolist(), strict=True)):
                    if size and name not in seen:
                        seen.add(name)
                        fresh[i] = True
                owner, key = part_keys(sets[np.repeat(fresh, sizes)], sizes[fresh], bound)
                owner = np.flatnonzero(fresh)[owner]
                key, first, back = np.unique(key, return_index=True, return_inverse=True)
                pairs = owner * (e - s) + owner[first][back] if len(key) else owner
                pairs = np.unique(pairs[pairs // (e - s) != pairs % (e - s)])
                own = b.slice(s, e - s)
                columns = [own.column(0), pa.array(sizes), own.column(1), pa.array(names, mask=sizes == 0), _lists(owner[first], key.view(np.int64), e - s), _lists(pairs // (e - s), names[pairs % (e - s)], e - s)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)
        release()

    return run


def _distinct_texts(schema: pa.Schema):
    """Rows of text_hash and text without those that an earlier row of the partition has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            pick = [i for i, x in enumerate(b.column(0).to_pylist()) if x not in seen and not seen.add(x)]
            yield pa.RecordBatch.from_arrays((b if len(pick) == len(b) else b.take(pa.array(pick, pa.int64()))).columns, schema=schema)
        release()

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], bound: Bound, same: bool) -> Iterator[tuple[int, int]]:
    """Linked pairs of rows of two blocks: the rows of a times the transposed b, column index over b."""
    size_b = np.array([len(x) for x in b])
    col, row = np.concatenate(b), np.repeat(np.arange(len(b)), size_b)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for i, x in enumerate(a):
        lo, hi = np.searchsorted(col, x, "left"), np.searchsorted(col, x, "right")
        n = hi - lo
        if not (total := int(n.sum())):
            continue
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
        common = np.bincount(row[at], minlength=len(b))
        hit = bound.den * common >= bound.num * (len(x) + size_b - common)
        if same:
            hit[i:] = False
        for j in np.flatnonzero(hit).tolist():
            yield i, j


def _product(bound: Bound, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, lo, hi), own in runs(batches, ["cluster", "star", "lo", "hi"]):
            rows = {}
            for b in own:
                for node, block, s in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("node", "block", "elements")), strict=True):
                    rows[node] = (block, np.frombuffer(s, U))
            a = [(k, s) for k, (block, s) in rows.items() if block == lo]
            b = a if lo == hi else [(k, s) for k, (block, s) in rows.items() if block == hi]
            if not a or not b or len(rows) < 2:
                continue
            names = [k for k, _ in a] + ([] if lo == hi else [k for k, _ in b])
            up, shift = list(range(len(names))), 0 if lo == hi else len(a)

            def root(x: int, up: list[int] = up) -> int:
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            made = []
            for i, j in overlaps([s for _, s in a], [s for _, s in b], bound, lo == hi):
                x, y = root(i), root(j + shift)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    made.append((names[i], names[j + shift]))
            if made:
                u, v = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=schema)
        release()

    return run


def _blocks(rows: str, elements: str, block: int) -> Column:
    return F.greatest(F.ceil(F.col(rows) / block), F.ceil(F.col(elements) / (block * 4096)), F.lit(1)).cast("int")


def _groups(member: DataFrame, keyed: DataFrame, chained: DataFrame, block: int) -> DataFrame:
    """node and groups (star, blocks, block): the blocks of the product that each row of `member` (node, cluster, n) is in.

    keyed: rows and the first rows of their keys over all pieces; chained: the same within a piece."""
    whole = member.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("elements"))
    whole = staged(whole.select("cluster", "rows", _blocks("rows", "elements", block).alias("blocks")), "jaccard-clusters")
    own = member.join(whole, "cluster").select("node", "cluster", F.col("cluster").alias("star"), "blocks")
    large = whole.filter("blocks > 1")
    if not large.isEmpty():
        inside = member.join(large, "cluster").select("node", "cluster", "n")
        through = chained.select("node", F.col("other").alias("via")).join(keyed.select(F.col("node").alias("via"), F.col("other").alias("star")), "via").select("node", "star")
        direct = keyed.unionByName(chained)
        stars = direct.select("node", F.col("other").alias("star")).unionByName(through).unionByName(direct.select(F.col("other").alias("node"), F.col("other").alias("star"))).distinct()
        stars = staged(stars.join(inside, "node"), "jaccard-stars")
        parts = stars.groupBy("cluster", "star").agg(F.count("*").alias("rows"), F.sum("n").alias("elements")).select("cluster", "star", "rows", _blocks("rows", "elements", block).alias("blocks"))
        cost = parts.groupBy("cluster").agg(F.sum(F.col("rows") * F.col("blocks")).alias("cost")).join(large, "cluster").filter("cost < rows * blocks").select("cluster")
        cost = staged(cost, "jaccard-by-star")
        by_star = stars.join(cost, "cluster", "left_semi").join(parts.filter("rows > 1"), ["cluster", "star"]).select("node", "cluster", "star", "blocks")
        own = own.join(cost, "cluster", "left_anti").unionByName(by_star)
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    return own.select("node", "cluster", F.struct("star", "blocks", place).alias("g")).groupBy("node", "cluster").agg(F.collect_list("g").alias("groups"))


def _labelled(df: DataFrame, id: str, text: str, n: int, num: int, den: int, block: int) -> DataFrame:
    """id, n, text_hash, component (a node; null for an empty set) and component_id of each row of df."""
    spark, bound = df.sparkSession, Bound(num, den)
    docs = df.select(df[id].cast("bigint").alias("id"), F.xxhash64(df[text]).alias("text_hash"), df[text].cast("string").alias("text"))
    with small_batches(spark):
        tokens = staged(docs.mapInArrow(_tokens(n, bound), TOKENS), "jaccard-tokens")
    rows = tokens.select("id", "n", "text_hash", "node")

    first = F.first("node").over(Window.partitionBy("key").orderBy("node"))
    keyed = tokens.select("node", F.explode("keys").alias("key")).select("node", first.alias("other")).filter("node <> other")
    edges = keyed.withColumn("far", F.lit(True)).unionByName(tokens.select("node", F.explode("firsts").alias("other"), F.lit(False).alias("far"))).distinct()
    edges = staged(edges, "jaccard-stars")
    clusters = connected_components(edges, "node", "other")

    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.max("n").alias("n"))
    member = staged(nodes.join(clusters, "node").select("node", "text_hash", "n", F.col("component").alias("cluster")), "jaccard-members")
    groups = _groups(member.drop("text_hash"), edges.filter("far").drop("far"), edges.filter("not far").drop("far"), block)
    member = staged(member.join(groups, ["node", "cluster"]).select("text_hash", "cluster", F.col("node").alias("expected"), "groups"), "jaccard-rows")

    made = T.StructType([member.schema["cluster"], T.StructField("node", T.LongType()), member.schema["groups"], T.StructField("elements", T.BinaryType())])
    out = arrow_schema(made)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for s, e, sets, sizes in _sets_of(b.column(3), n, CHUNK):
                part = b.slice(s, e - s)
                ends = np.cumsum(sizes).tolist()
                expected = part.column(1).to_pylist()
                pick = [i for i, (x, y) in enumerate(zip(set_names(sets, sizes).view(np.int64).tolist(), expected, strict=True)) if x == y and x not in seen and not seen.add(x)]
                if pick:
                    elements = pa.array([sets[ends[i] - sizes[i] : ends[i]].tobytes() for i in pick], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(pick)) for c in range(3)), elements], schema=out)
        release()

    texts = docs.select("text_hash", "text").filter("text is not null")
    texts = texts.mapInArrow(_distinct_texts(arrow_schema(texts.schema)), texts.schema)
    sets = texts.join(member.hint("merge"), "text_hash").select("cluster", "expected", "groups", "text").mapInArrow(fetch, made)
    sets = sets.select("cluster", "node", F.inline("groups"), "elements")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = sets.select("cluster", "star", "block", "node", "elements", other).select("cluster", "star", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "elements")
    link = schema("node bigint, other bigint")
    links = paired.repartition("cluster", "star", "lo", "hi").sortWithinPartitions("cluster", "star", "lo", "hi", "node").mapInArrow(_product(bound, arrow_schema(link)), link)
    with small_batches(spark):
        links = staged(links, "jaccard-links")
    component = connected_components(links, "node", "other")

    named = nodes.join(component, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    label = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component", "component_id")
    return rows.join(label, "node", "left").select("id", "n", "text_hash", "component", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, block: int = BLOCK) -> DataFrame:
    """id, n_shingles and component_id of each row of df."""
    return _labelled(df, id, text, n, num, den, block).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """The rows of df without near copies: of each component the row with the smallest id stays (a null id only if
    all are null; of rows that repeat that id, the one with the smallest text hash; of rows equal in both, one).
    Rows whose text has no word are linked with nothing and stay."""
    none, key = df[id].isNull(), F.coalesce(df[id].cast("bigint"), F.lit(0))
    found = _labelled(df, id, text, n, num, den, block).filter("component is not null")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("key"), "text_hash")).alias("best")
    keep = staged(found.groupBy("component").agg(best).select("best.*").distinct(), "jaccard-kept")
    words = F.coalesce(df[text].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = df.filter(words).select(F.struct(*[df[c] for c in df.columns]).alias("row"), none.alias("none"), key.alias("key"), F.xxhash64(df[text]).alias("text_hash"))
    rows = rows.join(keep.hint("merge"), ["none", "key", "text_hash"])
    order = Window.partitionBy("none", "key", "text_hash").orderBy("text_hash")
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").select("row.*").unionByName(df.filter(~words))
