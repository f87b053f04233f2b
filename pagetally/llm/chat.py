"""Chat formatting with offset-aligned loss masks.

Whole conversations are rendered, encoded once with offsets, and the sorted character spans of the turns
to learn from are intersected with the token spans by binary search. The template's marks are added to the
tokenizer as tokens of their own, so no token reaches across a mark. Inside roles and texts a backslash is
doubled and a mark gets a backslash after its first character; `unescape` undoes both.

Rows are ordered by turn (then role and text, for repeated turns; a null turn comes first). Null roles and
texts are empty; rows whose conv_id is null make one conversation; an empty table makes none. Only id, turn, role and
text are read, so other columns cannot clash. Rows are sorted by conversation within hash partitions and streamed:
memory holds one conversation and one batch to encode. A conversation is one text, so it is one task's, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bound, release, runs, schema

BATCH_CHARS = 1_000_000
FORMATTED = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


@dataclass(frozen=True)
class ChatTemplate:
    turn: str = "<turn>"
    says: str = "<says>"
    end: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.turn, self.says, self.end

    def escape(self, s: str) -> str:
        s = s.replace("\\", "\\\\")
        for m in self.marks:
            s = s.replace(m, m[0] + "\\" + m[1:])
        return s

    @staticmethod
    def unescape(s: str) -> str:
        return re.sub(r"\\(.)", r"\1", s, flags=re.S)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The conversation's text, and the spans of the texts to learn from."""
        out, spans, at = [], [], 0
        for role, text in turns:
            head, body = self.turn + self.escape(role) + self.says, self.escape(text)
            if role in self.loss_roles and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(out), spans

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        turns = []
        for part in formatted.split(self.end)[:-1]:
            role, text = part[len(self.turn) :].split(self.says)
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


def span_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that meet one of the sorted, disjoint spans."""
    if not spans or not len(starts):
        return np.zeros(len(starts), bool)
    s, e = np.array(spans, np.int64).T
    i = np.searchsorted(e, starts, "right")  # the first span that ends after the token's start
    return (i < len(s)) & (s[np.minimum(i, len(s) - 1)] < ends) & (ends > starts)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """Text under each run of masked tokens."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return [formatted[starts[r[0]] : ends[r].max()] for r in np.split(at, cut)]


def _tokenizer(raw: str, template: ChatTemplate):
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_str(raw)
    tok.add_tokens([AddedToken(m, normalized=False, special=False) for m in template.marks])
    tok.encode_special_tokens = True  # the vocabulary's own special strings are plain text here
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def load(spark: SparkSession, path: str):
    """A tokenizers file, as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return bound(spark, f.read())


def format_chats(df: DataFrame, tokenizer, template: ChatTemplate = ChatTemplate(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, formatted text, token ids, code point spans and loss mask."""
    columns = T.StructType([T.StructField(conv_id, df.schema[conv_id].dataType), *schema(FORMATTED).fields])
    rows = df.select(df[conv_id].alias("c"), df[turn].alias("t"), F.coalesce(df[role], F.lit("")).alias("r"), F.coalesce(df[text], F.lit("")).alias("x"))
    out = arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _tokenizer(tokenizer.value, template)

        def encoded(held: list[tuple]) -> pa.RecordBatch:
            found = tok.encode_batch([h[1][0] for h in held], add_special_tokens=False)
            offsets = [np.fromiter(chain.from_iterable(e.offsets), np.int32).reshape(-1, 2) for e in found]
            ends = pa.array(np.cumsum([0, *map(len, offsets)]), pa.int32())
            every = np.concatenate(offsets)
            mask = np.concatenate([span_mask(o[:, 0], o[:, 1], spans) for o, (_, (_, spans)) in zip(offsets, held, strict=True)])
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.concatenate([np.array(e.ids, np.int32) for e in found]), every[:, 0], every[:, 1], mask)]
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], out.field(0).type), pa.array([h[1][0] for h in held], pa.string()), *lists], schema=out)

        held, size = [], 0
        for (cid,), own in runs(batches, ["c"]):
            made = template.render([x for b in own for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])
            held.append((cid, made))
            size += len(made[0])
            if size >= BATCH_CHARS:
                yield encoded(held)
                held, size = [], 0
        if held:
            yield encoded(held)
        release()

    return rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").mapInArrow(run, columns)


def chat_digests(df: DataFrame, template: ChatTemplate = ChatTemplate(), conv_id: str = "conv_id") -> DataFrame:
    """What format_chats wrote, read back: turns from the formatted text, learnt text from mask and spans."""
    columns = T.StructType([df.schema[conv_id], *schema("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, loss_tokens bigint").fields])
    out = arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            at = b.column(2).offsets.to_numpy()
            starts, ends, masks = (c.values.to_numpy(zero_copy_only=False) for c in b.columns[2:])
            for i, (conv, formatted) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                turns, own = template.parse(formatted), slice(at[i], at[i + 1])
                loss = "".join(template.unescape(p) for p in masked_text(formatted, starts[own], ends[own], masks[own]))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), int(at[i + 1] - at[i]), int(masks[own].sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return df.select(conv_id, "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(run, columns)
