"""Byte-level BPE with a two-tier lookup.

A pre-token that is a vocabulary entry as a whole is found by a minimal perfect hash (hash and
displace, built once on the driver: its size is fixed by the vocabulary). Any other pre-token starts as
linked bytes; a heap of mergeable neighbours, keyed by (rank, position), yields the same merges as a
rescan for the lowest rank would, in n log n steps.

Nulls count as empty texts and give no ids. A column of the output's name is replaced; all other columns pass
through. Batches are cut into pieces of about CHUNK, and a very long text is read in pieces, so it costs memory
for its ids only. An empty table gives an empty table; repeated rows are encoded alike.
Null id lists decode to null, ids outside the vocabulary to U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bound, chunks, release

U = np.uint64
#: Bytes of pre-tokens and their ids that a worker keeps (each takes some 200 bytes besides); beyond it, new ones are
#: forgotten after their piece of a batch. It bounds memory, not results.
MEMO = 8_000_000
#: Characters whose pre-tokens are held at once.
CHUNK = 250_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in rows) + 1)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


def _slot(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (d.astype(U) * U(0x9E3779B97F4A7C15))) * U(0xD6E8FEB86659FD93)
    return ((x ^ (x >> U(32))) % U(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: key -> its index, in two array reads."""

    def __init__(self, keys: list[bytes]):
        n = max(1, len(keys))
        self.n, self.buckets = n, n // 2 + 1
        h = self.hashes(keys)
        self.shift = np.zeros(self.buckets, np.int64)
        self.at = np.full(n, -1, np.int64)
        members: dict[int, list[int]] = {}
        for i, b in enumerate((h % U(self.buckets)).tolist()):
            members.setdefault(b, []).append(i)
        free = np.ones(n, bool)
        single = []
        for b, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                single.append((b, own[0]))
                continue
            hs = h[own][:, None]
            for first in range(1, 1 << 24, 64):  # displacements are tried 64 at a time
                slots = _slot(hs, np.arange(first, first + 64), n)
                ok = free[slots].all(axis=0)
                ok &= np.diff(np.sort(slots, axis=0), axis=0).all(axis=0)
                if ok.any():
                    d = int(ok.argmax())
                    break
            else:
                raise ValueError("no displacement found: are all keys distinct?")
            self.shift[b], free[slots[:, d]], self.at[slots[:, d]] = first + d, False, own
        for (b, i), s in zip(single, np.flatnonzero(free).tolist(), strict=False):
            self.shift[b], self.at[s] = -1 - s, i

    @staticmethod
    def hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], U)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of the only entry that may equal each key (-1: none); the caller compares."""
        h = self.hashes(keys)
        d = self.shift[(h % U(self.buckets)).astype(np.int64)]
        return self.at[np.where(d < 0, -1 - d, _slot(h, np.maximum(d, 0), self.n))]


class Codec:
    """Vocabulary, perfect hash and pair table; pickled once as a broadcast, rebuilt lazily in workers."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.known = [i for i, t in enumerate(tokens) if t]
        self.table = PerfectHash([tokens[i] for i in self.known])
        self._ready = False

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("tokens", "pattern", "known", "table")} | {"_ready": False}

    def ready(self) -> Codec:
        if not self._ready:
            rank = {t: i for i, t in enumerate(self.tokens) if t}
            self.byte = [rank[bytes([b])] for b in range(256)]
            self.pair = {}
            for t, i in rank.items():
                for cut in range(1, len(t)):
                    if (a := rank.get(t[:cut])) is not None and (b := rank.get(t[cut:])) is not None:
                        self.pair[a << 32 | b] = i
            self.split = regex.compile(self.pattern)
            self.memo: dict[str, bytes] = {}
            self.held = 0
            self._ready = True
        return self

    def merge(self, piece: bytes) -> list[int]:
        """Merges of a pre-token: always the lowest rank, the leftmost of equals."""
        n, find, pop, push = len(piece), self.pair.get, heapq.heappop, heapq.heappush
        ids = [*map(self.byte.__getitem__, piece), -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        heap, a = [], ids[0]  # rank, then position: one integer
        for i in range(1, n):
            b = ids[i]
            if (r := find(a << 32 | b)) is not None:
                heap.append(r << 32 | (i - 1))
            a = b
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            j = after[i]
            if j > n or ids[i] < 0 or find(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            before[k] = i
            if k < n and (x := find(r << 32 | ids[k])) is not None:
                push(heap, x << 32 | i)
            if (p := before[i]) >= 0 and (x := find(ids[p] << 32 | r)) is not None:
                push(heap, x << 32 | p)
        return [x for x in ids if x >= 0]

    def learn(self, pieces: set[str]) -> list[str]:
        new = [p for p in pieces if p not in self.memo]
        if not new:
            return new
        raw = [p.encode() for p in new]
        for p, r, i in zip(new, raw, self.table.find(raw).tolist(), strict=True):
            whole = i >= 0 and self.tokens[self.known[i]] == r
            ids = self.memo[p] = array("i", [self.known[i]] if whole else self.merge(r)).tobytes()
            self.held += len(r) + len(ids)
        return new

    def forget(self, new: list[str]) -> None:
        if self.held > MEMO:
            for p in new:
                self.held -= len(p.encode()) + len(self.memo.pop(p))

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHUNK:
            yield self.split.findall(text)
            return
        found = (m[0] for m in self.split.finditer(text))
        while part := list(islice(found, CHUNK // 8)):
            yield part

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as 32-bit integers in the machine's order."""
        out = []
        for a, b in chunks([len(t or "") for t in texts], CHUNK):
            if b == a + 1 and len(texts[a] or "") > CHUNK:
                own = []
                for part in self._pieces(texts[a]):
                    new = self.learn(set(part))
                    own.append(b"".join(map(self.memo.__getitem__, part)))
                    self.forget(new)
                out.append(b"".join(own))
                continue
            parts = [self.split.findall(t) if t else [] for t in texts[a:b]]
            new = self.learn(set().union(*parts))
            out += [b"".join(map(self.memo.__getitem__, p)) for p in parts]
            self.forget(new)
        return out

    def decode(self, ids: list[int]) -> bytes:
        t, n = self.tokens, len(self.tokens)
        if ids and (min(ids) < 0 or max(ids) >= n):
            return b"".join(t[i] if 0 <= i < n else b"\xef\xbf\xbd" for i in ids)
        return b"".join(map(t.__getitem__, ids))


def id_lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    if ends[-1] >= 1 << 31:
        raise ValueError("one batch holds over 2^31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def load(spark: SparkSession, path: str, pattern: str):
    return bound(spark, Codec(read_ranks(path), pattern))


def _ids(codec: Codec, texts: pa.Array) -> pa.Array:
    return id_lists(codec.encode(texts.to_pylist()))


def _decoded(codec: Codec, ids: pa.Array) -> pa.Array:
    flat = pc.fill_null(ids.values, -1).to_numpy()
    at, ok = ids.offsets.to_pylist(), ids.is_valid().to_pylist()
    return pa.array([codec.decode(flat[s:e].tolist()) if v else None for s, e, v in zip(at, at[1:], ok, strict=False)], pa.binary())


def _added(df: DataFrame, codec, source: str, sizes: Callable[[pa.Array], pa.Array], columns: dict[str, tuple[T.DataType, Callable]]) -> DataFrame:
    """df with columns computed one from the other, the first from `source`, a piece of a batch of about CHUNK at a time."""
    kept = [c for c in df.columns if c not in columns or c == source]
    made = T.StructType([*(df.schema[c] for c in kept if c not in columns), *(T.StructField(c, t) for c, (t, _) in columns.items())])
    out, from_at = arrow_schema(made), kept.index(source)
    pass_at = [i for i, c in enumerate(kept) if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value.ready()
        for b in batches:
            for s, e in chunks(pc.fill_null(sizes(b.column(from_at)), 0).to_pylist(), CHUNK):
                part = b.slice(s, e - s)
                found = [part.column(from_at)]
                for _, f in columns.values():
                    found.append(f(c, found[-1]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in pass_at), *found[1:]], schema=out)
        release()

    return df.select(*[df[c] for c in kept]).mapInArrow(run, made)


_ENCODE, _DECODE = (T.ArrayType(T.IntegerType()), _ids), (T.BinaryType(), _decoded)


def encode_documents(df: DataFrame, codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of a text column."""
    return _added(df, codec, text, pc.binary_length, {ids: _ENCODE})


def decode_documents(df: DataFrame, codec, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of an ids column."""
    return _added(df, codec, ids, pc.list_value_length, {out: _DECODE})


def round_trip_documents(df: DataFrame, codec, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the ids of a text column and the bytes of those ids, in one pass."""
    return _added(df, codec, text, pc.binary_length, {ids: _ENCODE, out: _DECODE})


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
