"""Homomorphic multiset fingerprints, in SQL functions only.

A text is a multiset of paragraph pieces: paragraphs (lines), cut after clause marks of several scripts so that an
edit touches few of them, without surrounding blanks; empty pieces do not count. Each piece is hashed to a wide
vector, and the fingerprint is the sum of the vectors, each component modulo 2^60: the order of the pieces
does not matter, and adding or removing a piece adds or subtracts its vector. Components are

* the number of pieces,
* 60 components that each pack two 30-bit counters, one for each of 120 hash bits, and
* 2 components of 60 hash bits each, for equality.

A counter holds up to 2^30 - 1 pieces, more than a text can have: it takes two bytes a piece at least, and has
less than 2^31 in all. Multisets added together beyond that would carry from one counter into the next.

The counters, centred, are a random projection of the multiset, so the squared distance of two fingerprints
estimates how many pieces differ: `likeness` is 1 - |a - b|^2 / (|a|^2 + |b|^2), within 0 to 1; 1 for equal
fingerprints (two empty ones too).

The next document is found without one global window: documents are put into ranges of ids (boundaries from
approximate quantiles), and each range gets a copy of the next range's first document.

Null texts are empty. Null ids count as the largest id; rows that repeat an id are ordered by text. Only id
and text are read, so other columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_parts, staged

MASK = (1 << 60) - 1
LANE = (1 << 30) - 1
_SHIFTS = range(30)
_LANES = 1 | 1 << 30
#: Of each component: which hash it takes (0: all ones), shifted by, masked with.
PLAN = [(0, 0, 1), *((h, s, _LANES) for h in (1, 2) for s in _SHIFTS), *((h, 0, MASK) for h in (3, 4))]
WIDTH = len(PLAN)
COUNTERS = 2 * len(_SHIFTS)
#: Pieces are summed this many at a time with three 20-bit counters a component, which hold them, and then widened.
SOME = 1_000_000
_NARROW = [(0, 0, 1), *((h, s, 1 | 1 << 20 | 1 << 40) for h in (1, 2) for s in range(20)), *((h, 0, MASK) for h in (3, 4))]
_narrow = "array(" + ", ".join(f"named_struct('h', {h}, 's', {s}, 'm', {m}L)" for h, s, m in _NARROW) + ")"
_bit = lambda h, b: (1 + 20 * (h - 1) + b % 20, 20 * (b // 20))
_wide = "array(" + ", ".join("named_struct('a', {}, 'as', {}, 'b', {}, 'bs', {})".format(*_bit(h, s), *_bit(h, s + 30)) for h in (1, 2) for s in _SHIFTS) + ")"
_PIECES = r"filter(transform(split(%s, '(?<=[.!?;:,|。！？；：，、।؟؛،…])\\n?|\\n'), p -> trim(BOTH ' \t\r' FROM p)), p -> p <> '')"


def fingerprint_vector(text: str) -> Column:
    """SQL for the vector of a text column (or SQL expression): array<bigint>."""
    hashes = ", ".join(f"xxhash64({i}, p)" for i in range(1, 5))
    narrow = (
        f"aggregate(transform(slice(q, i * {SOME} + 1, {SOME}), p -> array(-1L, {hashes})), array_repeat(0L, {len(_NARROW)}), "
        f"(sum, h) -> zip_with(sum, {_narrow}, (x, c) -> (x + (shiftright(h[c.h], c.s) & c.m)) & {MASK}L))"
    )
    low = (1 << 20) - 1
    wide = f"transform(array({narrow}), n -> concat(array(n[0]), transform({_wide}, c -> (shiftright(n[c.a], c.as) & {low}L) | shiftleft(shiftright(n[c.b], c.bs) & {low}L, 30)), array(n[41], n[42])))[0]"
    return F.expr(f"transform(array({_PIECES % text}), q -> aggregate(sequence(0, cast((size(q) - 1) div {SOME} AS int)), array_repeat(0L, {WIDTH}), (t, i) -> zip_with(t, {wide}, (x, y) -> (x + y) & {MASK}L)))[0]")


def fingerprint_text(vector: str) -> Column:
    return F.expr(f"array_join(transform({vector}, x -> lpad(lower(hex(x)), 15, '0')), '')")


def added(a: str, b: str) -> Column:
    """Fingerprint of two multisets together: insertion."""
    return F.expr(f"zip_with({a}, {b}, (__p, __q) -> (__p + __q) & {MASK}L)")


def removed(a: str, b: str) -> Column:
    """Fingerprint of a multiset without another: deletion."""
    return F.expr(f"zip_with({a}, {b}, (__p, __q) -> (__p - __q) & {MASK}L)")


def _squares(lane: str) -> str:
    return " + ".join(f"pow({lane.format(s=s)}, 2)" for s in (0, 30))


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprint vectors (SQL expressions), 0 to 1."""
    of = "(2D * (shiftright({x}, {s}) & {lane}) - {v}[0])"
    one = lambda x, v: of.replace("{x}", x).replace("{v}", v).replace("{lane}", f"{LANE}L")
    take = lambda v: f"slice({v}, 2, {COUNTERS})"
    norm = lambda v: f"aggregate({take(v)}, 0D, (__t, __p) -> __t + {_squares(one('__p', v))})"
    apart = f"aggregate(zip_with({take(a)}, {take(b)}, (__p, __q) -> {_squares('(' + one('__p', a) + ' - ' + one('__q', b) + ')')}), 0D, (__t, __p) -> __t + __p)"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D WHEN {norm(a)} + {norm(b)} = 0D THEN 0D ELSE greatest(0D, 1D - {apart} / ({norm(a)} + {norm(b)})) END")


def _ranges(df: DataFrame, key: str) -> DataFrame:
    """df with a column bucket: ranges of key of about equal numbers of rows, a dozen a task so that tasks are even."""
    from pyspark.ml.feature import Bucketizer  # a large import, for the driver only

    many = 12 * n_parts(df.sparkSession)
    cuts = [i / many for i in range(1, many)]
    found = df.agg(F.percentile_approx(key, cuts, 8 * many)).first()[0] or []
    splits = [float("-inf"), *sorted({float(x) for x in found} or {0.0}), float("inf")]
    return Bucketizer(splits=splits, inputCol="__key", outputCol="bucket").transform(df.withColumn("__key", F.col(key).cast("double"))).drop("__key")


def with_next(df: DataFrame, id: str, text: str, carry: list[Column]) -> DataFrame:
    """id, text, carry..., and a struct `next` of text and carry of the next row by id (after the last: the first)."""
    rows = df.select(df[id].alias("id"), F.coalesce(df[id], F.lit((1 << 63) - 1)).alias("k"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = _ranges(rows, "k")
    firsts = rows.groupBy("bucket").agg(F.min("k").alias("k"))
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy(F.lit(1))))
    firsts = staged(firsts.select("k", before.alias("bucket")), "range-firsts")
    copies = rows.drop("bucket").join(firsts, "k").select("id", "k", "text", "bucket", F.lit(1).alias("copy"))
    both = rows.select("id", "k", "text", "bucket", F.lit(0).alias("copy")).unionByName(copies).select("*", *carry)
    names = both.columns[5:]
    place = Window.partitionBy("bucket").orderBy("copy", "k", "text")
    return both.withColumn("next", F.lead(F.struct("text", *names)).over(place)).filter("copy = 0").select("id", "text", *names, "next")


def fingerprint_documents(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts (the last quarter replaced by the next document's start)."""
    rows = with_next(df, id, text, [fingerprint_vector("text").alias("v")])
    rows = rows.select("id", F.length("text").cast("bigint").alias("n_chars"), "v", F.col("next.v").alias("next_v"), F.expr("concat(left(text, length(text) - div(length(text), 4)), left(next.text, div(length(text), 4)))".replace("div(length(text), 4)", "cast(length(text) div 4 as int)")).alias("edited"))
    rows = rows.select("id", "n_chars", "v", "next_v", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_vector("edited").alias("edited_v"))
    return rows.select(
        F.col("id").alias(id), "n_chars", "edited_sha256", fingerprint_text("v").alias("fingerprint"), fingerprint_text("edited_v").alias("edited_fingerprint"),
        likeness("v", "edited_v").alias("near_edited"), likeness("v", "next_v").alias("near_next"),
    )
