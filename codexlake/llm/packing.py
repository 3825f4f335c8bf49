"""Hierarchical packing of documents into windows of several context sizes.

Each document is cut into full windows of the longest tier; what is left is
routed to the smallest tier that holds it. Tiers are packed from the longest
down: a piece opens a window of its tier, the gap is filled with whole pieces
of shorter tiers, the last of them cut to fit. Windows of every tier come out
full, so only the last one of a partition is padded.

A task packs the rows of its own input partition as they stream by; nothing is
shuffled, and a task holds the leftovers of a bounded number of documents. So
which documents share a window depends on how the input is split. Windows of a
context are then numbered over all partitions by prefix sums, and each
STEP_TOKENS tokens of them in a row form a step group, whose windows may come
from several partitions; only the last group of a context can be smaller.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codexlake.llm.common import ids, nullable
from codexlake.llm.tokens import encoder
from codexlake.sources.scratch import written

TIERS = (256, 512, 1024, 2048)
#: Documents whose leftovers are packed together, and the tokens of one step group.
ROUND_DOCS, STEP_TOKENS = 4_000, 65_536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, part int, nth long"


class Packer:
    """Packs pieces (document, start, ids, tokens of the document); ids are uint32 bytes."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.partition, self.base = sorted(tiers), partition, partition << 40
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.n_sequences = 0
        self.n_windows = dict.fromkeys(self.tiers, 0)
        self.rows: list[tuple] = []

    def add(self, doc: int, data: bytes) -> None:
        longest, n = self.tiers[-1], len(data) // 4
        whole = n - n % longest
        for start in range(0, whole, longest):
            self.emit([(doc, start, data[4 * start : 4 * (start + longest)], n)], longest)
        if n > whole:
            self.route((doc, whole, data[4 * whole :], n))

    def route(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.waiting[next(t for t in self.tiers if t >= n)].append(piece)

    def emit(self, window: list[tuple], context: int) -> None:
        nth = self.n_windows[context]
        self.n_windows[context] += 1
        offset, sequence = 0, self.base + self.n_sequences
        self.n_sequences += 1
        for doc, start, data, total in window:
            n = len(data) // 4
            self.rows.append((doc, start, n, zlib.crc32(data), total, sequence, offset, context, self.partition, nth, data))
            offset += n

    def _next_for(self, gap: int, tier: int):
        """A piece for the gap, cut if need be; None if no piece of this tier or a shorter one waits."""
        below = [t for t in self.tiers if t < tier and self.waiting[t]]
        fits = [t for t in below if t <= gap]
        if fits:
            return self.waiting[fits[-1]].pop()
        source = below[-1] if below else tier
        if not self.waiting[source]:
            return None
        doc, start, data, total = self.waiting[source].pop()
        if len(data) > 4 * gap:
            self.route((doc, start + gap, data[4 * gap :], total))
            data = data[: 4 * gap]
        return doc, start, data, total

    def pack(self, last: bool = False) -> None:
        """Pack what waits. What can't fill a window stays for the next round, or is padded if this is the last."""
        for tier in reversed(self.tiers):
            while self.waiting[tier]:
                window = [self.waiting[tier].pop()]
                gap = tier - len(window[0][2]) // 4
                while gap and (piece := self._next_for(gap, tier)):
                    window.append(piece)
                    gap -= len(piece[2]) // 4
                if gap and not last:
                    for piece in window:
                        self.route(piece)
                    return
                self.emit(window, self.tiers[-1] if gap else tier)

    def take(self, with_ids: bool) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) or [()] * 11
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
        arrays = [nullable(np.array(columns[0], dtype=np.int64)), *[pa.array(c, k) for c, k in zip(columns[1:10], kinds[1:])]]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in columns[10]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)


def _pack(tokenizer: str, end_id: int, tiers: tuple[int, ...], with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId(), tiers)
        encode, end, n = encoder(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes(), 0
        for batch in batches:
            for doc, text in zip(ids(batch.column("doc_id")).tolist(), batch.column("text")):
                packer.add(doc, encode(text.as_py() or "") + end)
                n += 1
                if n % ROUND_DOCS == 0 or len(packer.rows) > 50_000:
                    packer.pack()
                    yield packer.take(with_ids)
        packer.pack(last=True)
        yield packer.take(with_ids)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group (and ids).

    A document is the ids of its text and ``end_id``; each id lies in exactly
    one piece. ``context`` is the padded length of the sequence: its tier, and
    the longest tier for the one sequence of a partition that may not be full.
    ``step_group`` numbers groups of STEP_TOKENS tokens of sequences of one
    context, the last one of a context excepted. Tiers are powers of two. A
    null or empty text has only the end id. Repeated rows and rows without
    doc_id are packed like any others; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(slim.mapInArrow(_pack(tokenizer, end_id, tuple(tiers), with_ids), SCHEMA + ", ids array<int>" * with_ids), "pieces")
    # One row per partition and context; the sums go over the partitions.
    counts = pieces.groupBy("context", "part").agg((F.max("nth") + 1).alias("n"))
    ahead = Window.partitionBy("context").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("context", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    number = F.floor((F.col("base") + F.col("nth")) * F.col("context") / F.greatest(F.lit(STEP_TOKENS), F.col("context"))).cast("long")
    tier = F.array_position(F.array(*[F.lit(t) for t in sorted(tiers)]), F.col("context")) - 1
    joined = pieces.join(bases, ["context", "part"]).withColumn("step_group", number * len(tiers) + tier)
    return joined.select(*[x.split()[0] for x in SCHEMA.split(", ")[:8]], "step_group", *["ids"] * with_ids)
