"""Hard negatives by a vector-approximation file.

Vectors become integers, floor(scale * x). Each dimension is quantised into CELLS cells, whose inner edges are quantiles
of a sample and whose outer edges are the dimension's least and largest component over all rows, so every vector is
approximated by a small number a dimension. Rows are dealt into blocks of one label each, a task holds one block and streams
anchors past it. A table of what each cell of each dimension adds to an anchor's score, at least and at most, turns
the approximations into a lower and an upper bound of every score by table lookup. Exact scores are computed only where

* for positives (rows of the anchor's own label), the upper bound is not under the k-th largest lower bound;
* for negatives (rows of other labels), the bounds meet the window that a positive's score opens, low * score / high to
  score, and the upper bound is not under the k-th largest lower bound among those certainly inside the window.

The sample that places the inner edges is SAMPLE rows for each length of vectors, with the smallest hashes: it makes
bounds tighter or wider and changes no result. What is broadcast are the edges: CELLS + 1 numbers a dimension.

Rows take no part if their id, label or vector is null or their vector holds a null or non-finite component. Vectors of
different lengths are not compared. Scores outside 64 bits saturate, as do integers. An anchor's own rows, those with its
id, are neither positives nor negatives; repeated rows are candidates each, repeated anchors count once, and rows that
share an anchor's id but not its vector or label are anchors of their own. Ties go to the smaller id. An empty table has
no anchors. Only id, label and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, bound, n_parts, release, schema, segments, staged

CELLS = 64
SAMPLE = 4096
BLOCK = 8192
POSITIVES = schema("anchor_key bigint, vec_id bigint, score bigint")
NEGATIVES = schema("anchor_key bigint, positive_score bigint, vec_id bigint, score bigint")
_TOP, _LOW = (1 << 63) - 1, -(1 << 63)


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0), np.int64)


def inner(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits they saturate."""
    reach = float(np.abs(rows.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, len(q))
    if reach < 1 << 52:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)  # sums of integers below 2^53 are exact
    if reach < 1 << 62:
        return rows @ q
    return np.array([min(_TOP, max(_LOW, sum(x * y for x, y in zip(r, q.tolist(), strict=True)))) for r in rows.tolist()], np.int64)


class Approximations:
    """A block of vectors with the number of a cell a dimension for each; edges: of each dimension, CELLS + 1 in ascending order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, edges: np.ndarray):
        self.ids, self.rows, self.edges = ids, rows, edges.astype(np.float64)
        dims = rows.shape[1]
        # A cell holds from its lower edge up to its upper one; both count as inside, for the last one's sake.
        cells = [np.clip(np.searchsorted(edges[d, 1:-1], rows[:, d], side="right"), 0, CELLS - 1) for d in range(dims)]
        self.cells = np.stack(cells) if dims else np.empty((0, len(rows)), np.int64)
        self.scored = 0

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every score, at least and at most: looked up by dimension and cell and summed."""
        x = q.astype(np.float64)[:, None]
        low, high = np.minimum(x * self.edges[:, :-1], x * self.edges[:, 1:]), np.maximum(x * self.edges[:, :-1], x * self.edges[:, 1:])
        slack = 1e-9 * float(np.maximum(np.abs(low), np.abs(high)).sum())  # of sums beyond 2^53
        table = low + 1j * high  # one lookup gives both
        total = np.zeros(len(self.rows), np.complex128)
        for d in range(len(q)):
            total += table[d].take(self.cells[d])
        return np.clip(total.real - slack, _LOW, _TOP), np.clip(total.imag + slack, _LOW, _TOP)

    def exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.scored += len(at)
        return inner(self.rows[at], q)

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in `at` of the k best: by score, then by id."""
        return np.lexsort((self.ids[at], ~scores))[:k]  # ~: descending, without overflow

    def best(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows whose id is not `own`."""
        low, high = self.bounds(q)
        others = np.flatnonzero(self.ids != own)
        if len(others) > k:
            others = others[high[others] >= np.partition(low[others], -k)[-k]]
        scores = self.exact(others, q)
        first = self.first(others, scores, k)
        return list(zip(self.ids[others[first]].tolist(), scores[first].tolist(), strict=True))

    def windows(self, own: int, q: np.ndarray, tops: list[int], k: int, share: tuple[int, int]) -> list[tuple[int, int, int]]:
        """(top, id, score) of the k best rows of each window: share[0] * top <= share[1] * score <= share[1] * top."""
        low, high = self.bounds(q)
        spans = [(top, -(-share[0] * top // share[1])) for top in tops]
        spans = [(top, least) for top, least in spans if least <= top]
        maybe: list[np.ndarray] = []
        for top, least in spans:
            at = np.flatnonzero((high >= least) & (low <= top) & (self.ids != own))
            inside = at[(low[at] >= least) & (high[at] <= top)]
            if len(inside) >= k:
                at = at[high[at] >= np.partition(low[inside], -k)[-k]]
            maybe.append(at)
        if not maybe:
            return []
        at = np.unique(np.concatenate(maybe))
        scores, found = self.exact(at, q), []
        for (top, least), own_at in zip(spans, maybe, strict=True):
            s = scores[np.searchsorted(at, own_at)]
            fits = (s >= least) & (s <= top)
            here, s = own_at[fits], s[fits]
            first = self.first(here, s, k)
            found += [(top, i, x) for i, x in zip(self.ids[here[first]].tolist(), s[first].tolist(), strict=True)]
        return found


def _scan(edges, out_schema, ask):
    """Streams anchors past the block they come behind; ask(block, anchor id, vector, key, windows) makes rows."""
    shape = arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, block = None, [], [], None
        for (dim, label, part, kind), b in segments(batches, ["dim", "label", "part", "kind"]):
            if (dim, label, part) != now:
                now, ids, rows, block = (dim, label, part), [], [], None
            own, v = b.column(4).to_numpy(zero_copy_only=False), matrix(b.column(5))
            if kind == 0:
                ids.append(own)
                rows.append(v)
                continue
            if not ids:
                continue
            if block is None:
                block = Approximations(np.concatenate(ids), np.concatenate(rows), edges.value[dim])
                ids, rows = [True], []
            made = [row for i, q, key, tops in zip(own.tolist(), v, b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True) for row in ask(block, i, q, key, tops)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], schema=shape)
        release()

    return run


LIMITS = schema("dim int, place int, least bigint, most bigint")


def _limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and largest component of each dimension of a task's vectors: dim, place, least, most."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for (dim,), b in segments(batches, ["dim"]):
        v = matrix(b.column(1))
        low, high = v.min(axis=0, initial=_TOP), v.max(axis=0, initial=_LOW)
        before = found.get(dim, (low, high))
        found[dim] = np.minimum(low, before[0]), np.maximum(high, before[1])
    for dim, (low, high) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)], schema=arrow_schema(LIMITS))


def _edges(rows: DataFrame) -> dict[int, np.ndarray]:
    """Of each length of vectors, the edges of every dimension's cells."""
    limits: dict[int, list] = {}
    for r in rows.select("dim", "v").mapInArrow(_limits, LIMITS).groupBy("dim", "place").agg(F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim", "place").collect():  # a row a dimension
        limits.setdefault(r.dim, []).append((r.least, r.most))
    out = {0: np.empty((0, CELLS + 1), np.int64)}
    for dim, own in limits.items():
        sample = matrix_of([r[0] for r in rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").collect()])
        inner_edges = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower").T
        low, high = np.array(own, np.int64).T
        out[dim] = np.hstack([low[:, None], np.clip(inner_edges, low[:, None], high[:, None]), high[:, None]])
    return out


def matrix_of(vectors: list[list[int]]) -> np.ndarray:
    return np.array(vectors, np.int64)


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """rows with the part of their label's: rows of one length and label are dealt by hash into parts of `size` or so.
    And the number of parts of each length and label."""
    many = staged(rows.groupBy("dim", "label").agg(F.ceil(F.count("*") / size).alias("parts")), "label-parts")
    part = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("parts"))
    return staged(rows.join(many, ["dim", "label"]).withColumn("part", part).drop("parts"), "labelled-blocks"), many


def hard_negatives(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, block: int = BLOCK, id: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where `anchors` (a condition
    on df's columns) holds and each of its `positives` best rows of its label, the `negatives` best rows of other labels
    with low * positive_score <= high * negative_score <= high * positive_score."""
    spark, v = df.sparkSession, df[vector]
    ok = v.isNotNull() & df[id].isNotNull() & df[label].isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = df.filter(ok).select(df[id].cast("bigint").alias("id"), df[label].cast("bigint").alias("label"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows, many = _blocks(staged(rows.withColumn("dim", F.size("v")), "labelled-vectors"), block)
    edges, spread = bound(spark, _edges(rows)), n_parts(spark)
    asked = staged(rows.filter("asks").select("dim", "id", "label", "v").distinct().withColumn("key", F.xxhash64("id", "label", "v")), "anchors")
    held = rows.select("dim", "label", "part", F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("array<bigint>").alias("tops"))

    def scan(asking: DataFrame, kind, ask) -> DataFrame:
        """asking: dim, label, id, v, key, tops, and in how many parts the label's rows are; each part is asked."""
        asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).withColumn("kind", F.lit(1))
        dealt = held.unionByName(asking.select(*held.columns)).repartition(spread, "dim", "label", "part").sortWithinPartitions("dim", "label", "part", "kind")
        return dealt.mapInArrow(_scan(edges, kind, ask), kind)

    same = asked.join(many, ["dim", "label"]).withColumn("tops", F.lit(None).cast("array<bigint>"))
    found = scan(same, POSITIVES, lambda block, i, q, key, tops: [(key, *x) for x in block.best(i, q, positives)])
    order = Window.partitionBy("anchor_key").orderBy(F.desc("score"), "vec_id")
    pairs = staged(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "positives")

    opened = pairs.groupBy("anchor_key").agg(F.collect_set("score").alias("tops"))  # at most `positives` each
    opened = asked.join(opened, asked["key"] == opened["anchor_key"]).select("dim", "label", "id", "v", "key", "tops")
    salted = opened.withColumn("salt", F.pmod("key", F.lit(spread)))  # all anchors of a length meet all labels: not in one task
    other = many.select("dim", F.col("label").alias("other"), "parts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))).alias("salt"))
    asking = salted.join(other, ["dim", "salt"]).filter("label <> other").drop("label").withColumnRenamed("other", "label")
    near = staged(scan(asking, NEGATIVES, lambda block, i, q, key, tops: [(key, *x) for x in block.windows(i, q, tops, negatives, (low, high))]), "negatives")
    order = Window.partitionBy("anchor_key", "positive_score").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    near = near.select("anchor_key", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = pairs.select("anchor_key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place")
    ids = asked.select(F.col("key").alias("anchor_key"), F.col("id").alias("anchor_id"))
    return pairs.join(near, ["anchor_key", "positive_score"]).join(ids, "anchor_key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
