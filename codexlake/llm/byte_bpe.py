"""Byte-level BPE from a file of ranks: encoding in padded matrices, and decoding.

A text is cut by the pattern; each piece starts as a row of single-byte
tokens. Rows of similar length share a matrix padded on the right. In a round
every row merges its leftmost pair of the least rank: one column less for
each, so the matrix is compacted to its width less one, and only the two pairs
beside the merge are looked up again. Rows without a pair to merge leave the
matrix. The ranks of pairs lie in an open-addressing hash table that is probed
for all rows at once.

A piece of thousands of bytes without white space would cost its length in
each round. It is laid out alone in blocks of about the square root of its
length with the least rank of each, so that a round touches four blocks.

Pieces recur, so a worker keeps the ids of the short ones it has met; the
store is emptied when it is full. Memory is bounded by the store, a group of
texts of GROUP_BYTES, and the longest text.
"""

from __future__ import annotations

import base64
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from codexlake.sources.parallel import spread_small

#: Rank of a pair that isn't a token; padding behind the end of a row.
NONE, PAD = np.iinfo(np.int32).max, -1
_EMPTY = np.int64(-1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Elements of a matrix; length from which a piece is laid out alone.
MATRIX, LONG = 1 << 20, 1024
#: Pieces that a worker keeps, and the longest of them in bytes; bytes of text that are cut at once.
MAX_PIECES, MAX_KEPT, GROUP_BYTES = 150_000, 48, 1 << 20


class ByteBPE:
    """The ranks of a file: one line per token, base64 of its bytes and its rank, which is also its id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self._build(left << 32 | right, rank.astype(np.int32))
        self.kept: dict[str, bytes] = {}

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.full(1 << bits, NONE, dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == _EMPTY
            self.keys[slots[free]] = keys[free]
            mine = self.keys[slots] == keys
            self.values[slots[mine]] = ranks[mine]
            keys, ranks, slots = keys[~mine], ranks[~mine], (slots[~mine] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they are no token."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slots(keys)
        seen = self.keys[slots]
        found = np.where(seen == keys, self.values[slots], NONE)
        open_ = np.nonzero((seen != keys) & (seen != _EMPTY))
        keys, slots = keys[open_], slots[open_]
        while len(keys):
            slots = (slots + 1) & self.mask
            seen = self.keys[slots]
            hit = seen == keys
            found[tuple(x[hit] for x in open_)] = self.values[slots[hit]]
            more = ~hit & (seen != _EMPTY)
            keys, slots, open_ = keys[more], slots[more], tuple(x[more] for x in open_)
        return found

    def merge_rows(self, ids: np.ndarray):
        """(row numbers, ids padded with PAD) of rows that have no more pair to merge, for a matrix of ids."""
        rows, rank = np.arange(len(ids)), self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            every = np.arange(len(rows))
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
            least = rank[every, at] if width > 1 else np.full(len(rows), NONE)
            go = least < NONE
            if not go.all():
                yield rows[~go], ids[~go]
                rows, ids, rank, at, least = rows[go], ids[go], rank[go], at[go], least[go]
                every = every[: len(rows)]
            if not len(rows):
                return
            ids[every, at] = least
            stay = np.ones(ids.shape, dtype=bool)
            stay[every, at + 1] = False
            ids = ids[stay].reshape(len(rows), width - 1)
            stay = np.ones(rank.shape, dtype=bool)
            stay[every, at] = False
            rank = rank[stay].reshape(len(rows), width - 2)
            before, after = at > 0, at < width - 2
            r, c = every[before], at[before]
            rank[r, c - 1] = self.pairs(ids[r, c - 1], ids[r, c])
            r, c = every[after], at[after]
            rank[r, c] = self.pairs(ids[r, c], ids[r, c + 1])

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The ids of one long piece. Merged places are taken out when half of them are gone."""
        while True:
            n = len(ids)
            size = max(16, int(n**0.5))
            rank = np.full(-(-n // size) * size, NONE, dtype=np.int32)
            rank[: n - 1] = self.pairs(ids[:-1], ids[1:])
            blocks = rank.reshape(-1, size)
            least = blocks.min(axis=1)
            after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), 0
            while gone <= n // 2:
                b = int(least.argmin())
                if least[b] == NONE:
                    break
                i = b * size + int(blocks[b].argmin())
                j = after[i]
                k, h = after[j], before[i]
                ids[i], ids[j], rank[j], gone = rank[i], PAD, NONE, gone + 1
                after[i] = k
                rank[i] = NONE
                if k < n:
                    before[k] = i
                    rank[i] = self.rank_of(ids[i], ids[k])
                if h >= 0:
                    rank[h] = self.rank_of(ids[h], ids[i])
                for x in {b, j // size, max(h, 0) // size}:
                    least[x] = blocks[x].min()
            ids = ids[ids != PAD]
            if gone <= n // 2:
                return ids

    def rank_of(self, left: int, right: int) -> int:
        return self.ranks.get(self.tokens[int(left)] + self.tokens[int(right)], NONE)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """piece -> its ids as 32-bit integers. A piece that is a token itself is that token."""
        found, buckets = {}, {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                found[piece] = whole.to_bytes(4, sys.byteorder)
            elif len(raw) >= LONG:
                found[piece] = self.merge_long(self.single[np.frombuffer(raw, dtype=np.uint8)]).tobytes()
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, rows in buckets.items():
            step = MATRIX >> bits
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for at, ids in self.merge_rows(self.matrix([raw for _, raw in part])):
                    packed, width = ids.tobytes(), 4 * ids.shape[1]
                    ends = (4 * (ids != PAD).sum(axis=1)).tolist()
                    found.update((part[r][0], packed[i * width : i * width + n]) for i, (r, n) in enumerate(zip(at.tolist(), ends)))
        return found

    def matrix(self, rows: list[bytes]) -> np.ndarray:
        width = max(map(len, rows))
        lengths = np.array([len(r) for r in rows])
        flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), width)
        return np.where(np.arange(width) < lengths[:, None], self.single[flat], np.int32(PAD))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.kept) > MAX_PIECES:
            self.kept.clear()
        cut = [self.cut(t) for t in texts]
        found = [list(map(self.kept.get, pieces)) for pieces in cut]
        holes = [i for i, x in enumerate(found) if None in x]
        new = self.learn(list({p for i in holes for p, ids in zip(cut[i], found[i]) if ids is None}))
        for i in holes:
            found[i] = [new[p] if ids is None else ids for p, ids in zip(cut[i], found[i])]
        self.kept.update((p, ids) for p, ids in new.items() if len(p) <= MAX_KEPT)
        return [np.frombuffer(b"".join(x), dtype=np.int32) for x in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One per worker process and file."""
    return ByteBPE(path, pattern)


def _groups(lengths: list[int], most: int):
    begin = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of every whole text; null or empty: no ids.

    path is a file of ranks that the executors can read, pattern the regular
    expression that cuts texts into pieces. Special tokens are ordinary text.
    One row per row of docs; repeated and null keys stay; other columns are
    left out.
    """

    def run(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            for a, b in _groups(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), GROUP_BYTES):
                ids = bpe.encode([t or "" for t in batch.column(1)[a:b].to_pylist()])
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=["key", "ids"])

    rows = spread_small(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids, decoded binary: the bytes of each row's ids; null ids: null. An id outside the vocabulary is an error."""

    def run(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            column = batch.column(1)
            flat, offsets, gone = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())], column.is_null().to_pylist()
            for a, b in _groups(np.diff(offsets).tolist(), GROUP_BYTES):
                found = [None if gone[i] else bpe.decode(flat[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], column[a:b], pa.array(found, pa.binary())], names=["key", "ids", "decoded"])

    rows = tokens.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"key {tokens.schema[key].dataType.simpleString()}, ids array<int>, decoded binary").withColumnsRenamed({"key": key, "ids": ids})


def digests(decoded: DataFrame, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, n_tokens, ids_sha256 (decimal ids joined by one blank), decoded_sha256."""
    return decoded.select(
        key,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
