"""Line dedup by range-partitioned line hashes.

Each eligible line becomes (128-bit hash, doc_id, position). The rows are
range-partitioned and sorted by hash, then doc_id from the largest down, then
position, and one streaming pass per partition keeps the first document of
each hash. Because the range bounds include doc_id and position, a line that
fills a third of the corpus is spread over many partitions: groups cut by a
partition border are settled by a table of at most six rows per partition.
The result per document is a compressed bitmap of the lines to keep; the texts
never take part in the sort.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codexlake.llm.common import NO_ID, SPACE, ids, nullable, raw_texts, with_text_key
from codexlake.sources.scratch import written

DROP, EDGE, TOP = 0, 1, 2


def _points_over(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least


def _line_rows(min_chars: int):
    def run(batches):
        for batch in batches:
            doc, th = ids(batch.column("doc_id")), batch.column("th").to_numpy(zero_copy_only=False)
            hashes, rows, places = [], [], []
            for i, text in enumerate(raw_texts(batch.column("text"))):
                for pos, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars:
                        key = line.strip(SPACE).lower()
                        if _points_over(key, min_chars):
                            hashes.append(xxhash.xxh3_128_digest(key))
                            rows.append(i)
                            places.append(pos)
            pair = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
            rows, places = np.array(rows, dtype=np.int64), np.array(places, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1]), nullable(doc[rows]), pa.array(th[rows]), pa.array(places)],
                names=["h1", "h2", "doc_id", "th", "place"],
            )

    return run


class _Stream:
    """State of one partition: the group that is open, and whether the partition's first group is over."""

    def __init__(self, min_docs: int):
        self.min_docs, self.first, self.key, self.seen = min_docs, True, None, []
        self.pending: list[np.ndarray] = []

    def edge_rows(self, kind: int, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.full(len(rows), kind), rows])

    def tops(self) -> np.ndarray:
        """The largest documents of the open group, as many as a verdict needs."""
        return np.array([[TOP, *self.key, d, 0, 0] for d in self.seen[: self.min_docs]], dtype=np.int64).reshape(-1, 6)

    def close(self, last: bool) -> list[np.ndarray]:
        out = [self.tops()] if self.key is not None and (self.first or last) else []
        if last and self.pending:
            out.append(self.edge_rows(EDGE, np.concatenate(self.pending)))
        self.pending, self.seen, self.first = [], [], False
        return out

    def extend(self, rows: np.ndarray) -> list[np.ndarray]:
        """More rows (h1, h2, doc, th, place) of the open group."""
        docs = rows[:, 2]
        new = docs[np.r_[True, docs[1:] != docs[:-1]]]
        if self.seen and new[0] == self.seen[-1]:
            new = new[1:]
        winner = self.seen[0] if self.seen else new[0]
        before = len(self.seen)
        self.seen = [*self.seen, *new[: self.min_docs].tolist()][: max(self.min_docs, before)]
        if self.first:
            return [self.edge_rows(EDGE, rows)]
        losing = rows[docs != winner]
        if len(self.seen) < self.min_docs:
            self.pending.append(losing)
            return []
        out = [self.edge_rows(DROP, x) for x in [*self.pending, losing]]
        self.pending = []
        return out


def _stream(min_docs: int):
    def run(batches):
        state = _Stream(min_docs)

        def packed(parts):
            rows = np.concatenate(parts) if parts else np.empty((0, 6), dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2]), nullable(rows[:, 3]), pa.array(rows[:, 4]), pa.array(rows[:, 5])],
                names=["kind", "h1", "h2", "doc_id", "th", "place"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), ids(batch.column(2)), batch.column(3).to_numpy(), batch.column(4).to_numpy()])
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            out, n = [], len(rows)
            bounds = np.r_[starts, n]
            begin = 0
            if state.key is not None and state.key == tuple(rows[0, :2].tolist()):
                out += state.extend(rows[: bounds[1]])
                begin = 1
            if begin < len(starts):
                out += state.close(False)
                if state.key is None:  # the partition's first group stays apart
                    state.first, state.key = True, tuple(rows[0, :2].tolist())
                    out += state.extend(rows[: bounds[1]])
                    begin = 1
                    if begin < len(starts):
                        out += state.close(False)
            if begin < len(starts):
                lo, hi = bounds[begin], bounds[-2]
                if hi > lo:  # whole groups inside the batch, all at once
                    part = rows[lo:hi]
                    group = np.cumsum(np.r_[True, (part[1:, :2] != part[:-1, :2]).any(axis=1)]) - 1
                    change = np.r_[True, (group[1:] != group[:-1]) | (part[1:, 2] != part[:-1, 2])]
                    n_docs = np.bincount(group, weights=change).astype(np.int64)
                    rank = np.cumsum(change)
                    first = rank[np.searchsorted(group, np.arange(len(n_docs)))]
                    out.append(state.edge_rows(DROP, part[(rank > first[group]) & (n_docs[group] >= min_docs)]))
                state.key = tuple(rows[hi, :2].tolist())
                out += state.extend(rows[hi:])
            yield packed(out)
        if state.key is not None:
            yield packed(state.close(True))

    return run


def _bitmaps(batches):
    for batch in batches:
        maps = []
        for places in batch.column("places"):
            at = np.asarray(places.values, dtype=np.int64)
            keep = np.ones((int(at.max()) // 8 + 1) * 8, dtype=bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(maps, pa.binary())], names=["doc_id", "th", "keep"])


def line_keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, th, keep) for the documents that lose lines.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased. A key of ``min_chars`` code points found in ``min_docs``
    documents or more stays only in the largest doc_id that holds it. ``keep``
    is a zlib-compressed bitmap, lowest bit first, 1 for a line to keep; lines
    past its end are kept. ``th`` is common.text_key of the row's text.

    Rows that share a doc_id are one document; rows without doc_id count
    together as one document below all others. A null text has one empty line.
    Ties cannot arise: all lines of the winning document stay. An empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    lines = with_text_key(docs).mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc_id long, th long, place long")
    lines = written(lines, "hashes")  # read twice: for the range bounds and for the sort
    order = ["h1", "h2", F.desc_nulls_last("doc_id"), "place"]
    streamed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(streamed.mapInArrow(_stream(min_docs), "kind int, h1 long, h2 long, doc_id long, th long, place long"), "lines")
    # At most 2 x min_docs rows from each partition of the stream, so this side is small by construction.
    verdict = found.where(F.col("kind") == TOP).select("h1", "h2", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("d")).groupBy("h1", "h2")
    verdict = verdict.agg(F.count_distinct("d").alias("n"), F.max("d").alias("winner")).where(F.col("n") >= min_docs)
    edge = found.where(F.col("kind") == EDGE).join(F.broadcast(verdict), ["h1", "h2"])
    edge = edge.where(F.coalesce("doc_id", F.lit(int(NO_ID))) != F.col("winner"))
    drops = found.where(F.col("kind") == DROP).select("doc_id", "th", "place").unionByName(edge.select("doc_id", "th", "place"))
    places = drops.groupBy("doc_id", "th").agg(F.collect_list("place").alias("places"))
    return places.mapInArrow(_bitmaps, "doc_id long, th long, keep binary")


def _apply(with_text: bool):
    def run(batches):
        for batch in batches:
            n_lines, n_dropped, digest, kept = [], [], [], []
            for text, keep in zip(raw_texts(batch.column("text")), batch.column("keep")):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if keep.is_valid:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), dtype=np.uint8), bitorder="little")[: len(lines)]
                    gone = set(np.flatnonzero(bits == 0).tolist())
                    text = b"\n".join([x for i, x in enumerate(lines) if i not in gone])
                    n_dropped.append(len(gone))
                else:
                    n_dropped.append(0)
                digest.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text)
            own = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                own.append(pa.array(kept, pa.binary()).cast(pa.string()))
            rest = [n for n in batch.schema.names if n not in ("text", "keep")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], *own], names=[*rest, "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * with_text])

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, n_lines, n_dropped, kept_sha256 (and kept_text) of every row of ``docs``.

    The bitmaps go to the documents by a shuffled hash join on (doc_id, th),
    null-safe; the build side is the bitmaps alone.
    """
    d, b = with_text_key(docs, *carry).alias("d"), bitmaps.hint("shuffle_hash").alias("b")
    joined = d.join(b, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.th") == F.col("b.th")), "left")
    joined = joined.select("d.doc_id", *[f"d.{c}" for c in carry], "d.text", "b.keep")
    carried = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return joined.mapInArrow(_apply(with_text), f"doc_id long, {carried}n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """line_keep_bitmaps() applied: one row per row of ``docs``; see there for nulls and repeated rows."""
    return apply_bitmaps(docs, line_keep_bitmaps(docs, min_chars, min_docs), with_text, carry)
