"""Exact top-k by inner product: ball-tree branch and bound in shards.

Vectors become integers, floor(scale * x). A vector is put into the shard of the nearest of some centres (drawn by
hash, one per SHARD vectors and at most MOST_SHARDS); a shard that would hold much more than SHARD is split by hash, so
equal or crowded vectors do not make one large task. A task builds a ball tree of its shard and streams queries past
it: nodes are opened in the order of the upper bound q.c + |q| r of their inner products, and a node whose bound is
under the current kth score is not opened. Shards share that score: each query is first searched in its own shard, and
then goes, with the kth score found there, to those other shards whose root ball may still hold a better one.

What is broadcast are the centres and the shards' root balls: SHARD grows with the table so that they are at most
MOST_SHARDS and twice that.

Vectors that are null or hold null or non-finite components take no part. Vectors of different lengths are
not compared; integers and scores stay within 64 bits (beyond, they saturate). A query's own rows, those with
its id, are no candidates; repeated rows are candidates each, repeated queries count once. Ties go to the
smaller id. An empty table has no queries. Only id and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, bound, n_parts, release, runs, schema, segments, staged

SHARD = 8192
MOST_SHARDS = 4096
LEAF = 128
FOUND = schema("query_id bigint, query_key bigint, vec_id bigint, score bigint")
_TOP, _LOW = (1 << 63) - 1, -(1 << 63)


class BallTree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        n, dim = rows.shape
        order = np.arange(n)
        x = rows.astype(np.float64)
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, children (-1: a leaf)
        centers, radii = [], []

        def build(a: int, b: int) -> int:
            me, own = len(self.nodes), x[order[a:b]]
            c = own.mean(axis=0)
            self.nodes.append((a, b, -1, -1))
            centers.append(c)
            radii.append(float(np.sqrt(((own - c) ** 2).sum(axis=1).max())))
            if b - a > LEAF and dim and radii[-1] > 0:
                part = order[a:b]
                part = part[np.argsort(own[:, np.argmax(np.ptp(own, axis=0))], kind="stable")]
                order[a:b] = part
                m = (a + b) // 2
                self.nodes[me] = (a, b, build(a, m), build(m, b))
            return me

        build(0, n)
        self.ids, self.rows, self.x = ids[order], rows[order], x[order]
        self.centers, self.radii = np.array(centers).reshape(len(centers), dim), np.array(radii)
        self.most = float(np.abs(self.x).max(initial=0))

    def scores(self, a: int, b: int, q: np.ndarray, qf: np.ndarray) -> list[int]:
        reach = self.most * float(np.abs(qf).max(initial=0)) * max(1, len(q))
        if reach < 1 << 52:
            return (self.x[a:b] @ qf).astype(np.int64).tolist()  # sums of integers below 2^53 are exact
        if reach < 1 << 62:
            return (self.rows[a:b] @ q).tolist()
        exact = q.astype(object)
        return [min(_TOP, max(_LOW, int(s))) for s in self.rows[a:b].astype(object) @ exact] if len(q) else [0] * (b - a)

    def search(self, own: int, q: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, -id) of the k best that are not below `least`, as a heap."""
        qf = q.astype(np.float64)
        bounds = self.centers @ qf + np.sqrt(qf @ qf) * self.radii
        bounds += 1e-9 * (np.abs(bounds) + np.sqrt(qf @ qf) * (self.radii + self.most)) + 1
        best: list[tuple[int, int]] = []
        floor = _LOW if least is None else least
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if -bound < floor:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heapq.heappush(todo, (-bounds[child], child))
                continue
            for s, i in zip(self.scores(a, b, q, qf), self.ids[a:b].tolist(), strict=True):
                if s < floor or i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    floor = max(floor, best[0][0])
        return best


def _vectors(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0), np.int64)


def _search(k: int):
    out = arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, tree = None, [], [], None
        for (dim, shard, kind), b in segments(batches, ["dim", "shard", "kind"]):
            if (dim, shard) != now:
                now, ids, rows, tree = (dim, shard), [], [], None
            own, v = b.column(3).to_numpy(zero_copy_only=False), _vectors(b.column(4))
            if kind == 0:
                ids.append(own)
                rows.append(v)
                continue
            if not ids:
                continue
            if tree is None:
                tree = BallTree(np.concatenate(ids), np.concatenate(rows))
                ids, rows = [True], []
            made = [(q, key, -i, s) for q, x, key, least in zip(own.tolist(), v, b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True) for s, i in tree.search(q, x, k, least)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], schema=out)
        release()

    return run


def _nearest(centres):
    """Column function: the number of the centre nearest to a vector (0 if there is none of its length)."""

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        out = np.zeros(len(v), np.int32)
        sizes = np.diff(v.offsets.to_numpy())
        for dim in np.unique(sizes).tolist():
            own, at = centres.value.get(dim), np.flatnonzero(sizes == dim)
            if own is not None and dim:
                for s in range(0, len(at), 1024):
                    some = at[s : s + 1024]
                    x = _vectors(v.take(pa.array(some))).astype(np.float64)
                    out[some] = ((own**2).sum(axis=1)[None, :] - 2 * (x @ own.T)).argmin(axis=1)
        return pa.array(out)

    return nearest


BALLS = schema("dim int, shard bigint, centre array<double>, radius double")


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's root ball: the middle of its smallest box, and the distance of its farthest vector."""
    out = arrow_schema(BALLS)
    for (dim, shard), own in runs(batches, ["dim", "shard"]):
        x = np.concatenate([_vectors(b.column(2)) for b in own]).astype(np.float64)
        c = (x.min(axis=0) + x.max(axis=0)) / 2
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard]), pa.array([c]), pa.array([float(np.sqrt(((x - c) ** 2).sum(axis=1).max()))])], schema=out)


ASKING = schema("dim int, shard bigint, kind int, id bigint, v array<bigint>, key bigint, least bigint")


def _reached(balls):
    """Queries with the shards, other than their own, whose root ball reaches their kth score."""
    out = arrow_schema(ASKING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for dim, home, q, v, key, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shards, centres, radii = balls.value[dim]
                x = np.array(v, np.float64)
                size = np.sqrt(x @ x)
                bounds = centres @ x + size * radii
                bounds += 1e-9 * (np.abs(bounds) + size * (radii + np.abs(centres).max(initial=0, axis=1))) + 1
                reach = shards != home
                if least is not None:
                    reach &= bounds >= least
                rows += [(dim, shard, 1, q, v, key, least) for shard in shards[reach].tolist()]
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return run


def _placed(rows: DataFrame, shard: int) -> DataFrame:
    """rows with a shard: the nearest centre's, split where it would hold too many."""
    spark = rows.sparkSession
    sizes = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}  # one row per length of vectors
    shard = max(shard, -(-sum(sizes.values()) // MOST_SHARDS))
    some = lambda dim, n: rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("v"), "id").limit(-(-n // shard)).select("v").collect()
    centres = {dim: np.array([r[0] for r in some(dim, n)], np.float64) for dim, n in sizes.items() if dim and n > shard}
    rows = staged(rows.withColumn("centre", _nearest(bound(spark, centres))("v")), "near-vectors")
    crowd = rows.groupBy("dim", "centre").agg(F.ceil(F.count("*") / (2 * shard)).alias("parts"))
    part = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("parts"))
    return staged(rows.join(F.broadcast(crowd), ["dim", "centre"]).select("id", "v", "asks", "dim", (F.shiftleft(F.col("centre").cast("bigint"), 32) + part).alias("shard")), "vectors")


def top_k(df: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = 1024, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df where `queries` (a condition on its columns) holds, the k best others."""
    spark, v = df.sparkSession, df[vector]
    ok = v.isNotNull() & df[id].isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = df.filter(ok).select(df[id].cast("bigint").alias("id"), whole.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = _placed(staged(rows.withColumn("dim", F.size("v")), "whole-vectors"), shard)
    none = F.lit(None).cast("bigint")
    candidates = rows.select("dim", "shard", F.lit(0).alias("kind"), "id", "v", none.alias("key"), none.alias("least"))
    parts = n_parts(spark)

    def search(asking: DataFrame) -> DataFrame:
        both = candidates.unionByName(asking.select(*candidates.columns))
        return both.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "kind").mapInArrow(_search(k), FOUND)

    found: dict[int, tuple] = {}
    for r in rows.select("dim", "shard", "v").repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard").mapInArrow(_balls, BALLS).toLocalIterator():
        for own, x in zip(found.setdefault(r.dim, ([], [], [])), (r.shard, r.centre, r.radius), strict=True):
            own.append(x)
    balls = bound(spark, {dim: (np.array(s), np.array(c, np.float64).reshape(len(s), dim), np.array(x)) for dim, (s, c, x) in found.items()})

    asked = rows.filter("asks").groupBy("dim", "id", "v").agg(F.min("shard").alias("shard")).withColumn("key", F.xxhash64("id", "v"))
    home = staged(search(asked.select("dim", "shard", F.lit(1).alias("kind"), "id", "v", "key", none.alias("least"))), "home-found")
    least = home.groupBy("query_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asking = asked.join(least, asked["key"] == least["query_key"], "left").select("dim", "shard", "id", "v", "key", "least").mapInArrow(_reached(balls), ASKING)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(search(asking)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
