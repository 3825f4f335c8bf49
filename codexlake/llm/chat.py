"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of the assistant's texts are intersected with the sorted token
spans by binary search. Control strings are special tokens of their own, so
each text begins and ends at a token border; inside texts and roles they are
escaped: every ``<|`` gets a backslash between its characters, and one more
where backslashes stand there already, which is undone by removing one.

Long conversations are cut into segments by turn number, each a row. Control
tokens stand at the cut, so the ids of the segments, one after the other, are
those of the whole conversation; with_offsets() says where each segment begins
in it.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL).finditer
SEGMENT_TURNS = 256
SCHEMA = "conv_id long, segment long, n_turns long, formatted string, token_ids array<int>, loss_tokens array<struct<first:int,stop:int>>, loss_chars array<struct<start:int,stop:int>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the character spans of the texts to learn from."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in TURN(formatted)]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(path)
    found.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
    return found


def token_spans(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each character span the range of tokens that overlap it."""
    if not spans or not len(offsets):
        return [(0, 0)] * len(spans)
    begin, stop = np.array(spans).T
    first = np.searchsorted(offsets[:, 1], begin, side="right")
    last = np.searchsorted(offsets[:, 0], stop, side="left")
    return list(zip(first.tolist(), np.maximum(first, last).tolist()))


def _groups(batches, keys: int):
    """Runs of rows that agree in the first columns; rows come as tuples."""
    held, key = [], None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[:keys] != key:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


def _format(path: str):
    def run(batches):
        rows: list[tuple] = []

        def pack():
            made = dict(zip(("conv_id", "segment", "n_turns", "formatted", "token_ids"), map(list, zip(*[r[:5] for r in rows]))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
            spans = [
                pa.array([[dict(zip(names, s)) for s in r[i]] for r in rows], pa.list_(pa.struct([(n, pa.int32()) for n in names])))
                for i, names in ((5, ("first", "stop")), (6, ("start", "stop")))
            ]
            return pa.RecordBatch.from_arrays([*[pa.array(v, k) for v, k in zip(made.values(), kinds)], *spans], names=[*made, "loss_tokens", "loss_chars"])

        for (conv, segment), turns in _groups(batches, 2):
            formatted, spans = render([(role or "", text or "") for role, text in turns])
            found = tokenizer(path).encode(formatted, add_special_tokens=False)
            offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
            rows.append((conv, segment, len(turns), formatted, found.ids, token_spans(offsets, spans), spans))
            if len(rows) >= 500:
                yield pack()
                rows = []
        if rows:
            yield pack()

    return run


def format_conversations(conversations: DataFrame, path: str, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row per conversation segment: the formatted text, its token ids, and the loss mask as token and character spans.

    Rows are ordered by turn, ties by role and text; a null turn comes first, a
    null role or text is empty. Rows without conv_id form one conversation.
    Repeated rows are repeated turns. An empty table gives an empty result;
    other columns are ignored.
    """
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.floor(F.col("turn") / segment_turns).cast("long").alias("segment"),
        F.col("turn").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    c = c.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text")
    return c.select("conv_id", "segment", "role", "text").mapInArrow(_format(path), SCHEMA)


def with_offsets(segments: DataFrame) -> DataFrame:
    """The rows of format_conversations() with char_offset and token_offset: where a segment begins in its whole conversation."""
    ahead = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n: F.coalesce(F.sum(n).over(ahead), F.lit(0)).cast("long")
    return segments.select("*", before(F.length("formatted")).alias("char_offset"), before(F.size("token_ids")).alias("token_offset"))


def _parts(path: str):
    """Of each segment what a digest runs over: its turns read from the formatted text, its loss texts decoded from the ids."""

    def run(batches):
        for batch in batches:
            n_turns, turns, loss = [], [], []
            for formatted, token_ids, spans in zip(batch.column("formatted"), batch.column("token_ids"), batch.column("loss_tokens")):
                found = parse(formatted.as_py())
                n_turns.append(len(found))
                turns.append("".join(f"{role}\n{text}\n" for role, text in found))
                token_ids = token_ids.values.to_numpy(zero_copy_only=False)
                first, stop = (spans.values.field(x).to_numpy() for x in ("first", "stop"))
                texts = tokenizer(path).decode_batch([token_ids[a:b].tolist() for a, b in zip(first, stop) if b > a], skip_special_tokens=False)
                loss.append("".join(map(unescape, texts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("segment"), pa.array(n_turns, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pc.utf8_length(batch.column("formatted")).cast(pa.int64())],
                names=["conv_id", "segment", "n_turns", "turns", "loss", "formatted_chars"],
            )

    return run


def _digest(batches):
    rows, conv, state = [], None, None

    def pack():
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(map(list, zip(*rows)), kinds)], names=list(names))

    def close():
        n, turns, loss_n, loss, chars = state
        rows.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))

    for batch in batches:
        for key, n_turns, turns, loss, chars in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "n_turns", "turns", "loss", "formatted_chars")]):
            if state is None or key != conv:
                if state is not None:
                    close()
                    if len(rows) >= 5_000:
                        yield pack()
                        rows = []
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += n_turns
            state[1].update(turns.encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
    if state is not None:
        close()
    if rows:
        yield pack()


def read_back(segments: DataFrame, path: str) -> DataFrame:
    """Digests of each conversation, read from the formatted texts, ids and masks.

    Segments are parsed and decoded where they are. Only the digest runs over
    the whole conversation in order: its texts stream through one task, which
    holds nothing but the running digest.
    """
    parts = segments.select("conv_id", "segment", "formatted", "token_ids", "loss_tokens")
    parts = parts.mapInArrow(_parts(path), "conv_id long, segment long, n_turns long, turns string, loss string, formatted_chars long")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return parts.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
