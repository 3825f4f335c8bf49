"""Substring dedup by relative Lempel-Ziv factors.

A passage counts as repeated if a window of ``window`` consecutive words starts
in two places. The corpus is indexed as reference blocks: every window is
assigned to the k-word anchor with the smallest hash inside it, which depends
on the window's words alone, and the block of an anchor gathers the stretches of
text around all its occurrences. A block is indexed by the sorted suffixes of
its stretches. Each stretch is then parsed greedily: at a window that the block
has elsewhere, the longest match with another suffix is the next factor, and
the parse goes on with the window behind the factor's last one, which straddles
the factor's border and so is checked as well. As every window lies in exactly
one stretch, windows that straddle two stretches are not missed either. The
factors, ``window`` words long or longer, are the duplicate spans.

Stretches travel as window hashes, six bytes each beside the 64-bit anchor, not
as words: two different windows would be taken for equal with a chance of 2^-48
for a pair inside one block. Before the shuffle each batch settles stretches
that repeat inside it and sends one copy, so a passage that a third of the
corpus holds reaches its block once per batch, not once per document. Anchors
found in very many stretches of a sample have their blocks split: there each
window is a stretch of its own, whose block is that of its anchor and hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codexlake.llm.common import NO_ID, ids, nullable, raw_texts, with_text_key

ANCHOR_WORDS = 8
#: An odd multiplier for prefix hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MAX_WORDS = 400_000
SETTLED, STRETCH, KNOWN = 1, 0, 2
#: One in SAMPLE documents tells which anchors are hot: those with more than HOT of its stretches, MAX_HOT at most.
#: This only decides how blocks are dealt out; the result is the same whatever it finds.
SAMPLE, HOT, MAX_HOT = 64, 48, 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _run_hashes(words: np.ndarray, k: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of each run of k words, from differences of prefix sums."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * down[: len(words) - k + 1])


def _stretches(words: list[bytes], window: int, up: np.ndarray, down: np.ndarray):
    """(first windows of the stretches, their anchors' hashes, all window hashes) of a document of at least ``window`` words."""
    h = np.array(list(map(_HASHES.__getitem__, words)), dtype=np.uint64)
    anchors = _run_hashes(h, ANCHOR_WORDS, up, down)
    span = window - ANCHOR_WORDS + 1
    view = np.lib.stride_tricks.sliding_window_view(anchors, span)
    at = np.concatenate([view[i : i + 100_000].argmin(axis=1) for i in range(0, len(view), 100_000)]) + np.arange(len(view))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, anchors[at[first]], _run_hashes(h, window, up, down)


def _held(batches, window: int):
    """Lists of (row, first windows of stretches, anchors, window hashes) of documents long enough, and the batch they are of."""
    up, down = _powers(BASE, 1024), _powers(INVERSE, 1024)
    for batch in batches:
        held, size = [], 0
        for i, text in enumerate(raw_texts(batch.column("text"))):
            words = text.split()
            if len(words) < window:
                continue
            while len(words) >= len(up):
                up, down = _powers(BASE, 2 * len(up)), _powers(INVERSE, 2 * len(down))
            held.append((i, *_stretches(words, window, up, down)))
            size += len(held[-1][3])
            if size > 2_000_000:
                yield batch, held
                held, size = [], 0
        if held:
            yield batch, held


def _cut(window: int, hot: np.ndarray):
    def run(batches):
        for batch, held in _held(batches, window):
            yield _settle(held, ids(batch.column("doc_id")), batch.column("th").to_numpy(zero_copy_only=False), hot)

    return run


def _anchor_counts(window: int):
    """anchor, n: the different stretches of each anchor in each batch."""

    def run(batches):
        for _, held in _held(batches, window):
            stretches = _Stretches(held, np.zeros(0, dtype=np.uint64))
            anchor, n = np.unique(stretches.anchor[stretches.sent].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    return run


class _Stretches:
    """The stretches of a batch: per stretch its row, first window, number of windows and block; which repeat and which are sent on."""

    def __init__(self, held, hot: np.ndarray):
        self.hashes = np.concatenate([h for _, _, _, h in held])
        count = np.concatenate([np.diff(np.r_[first, len(hashes)]) for _, first, _, hashes in held])
        row = np.concatenate([np.full(len(first), i) for i, first, _, _ in held])
        start = np.concatenate([first for _, first, _, _ in held]).astype(np.int64)
        anchor = np.concatenate([a for _, _, a, _ in held])
        if len(hot):  # split the blocks of hot anchors by window
            single = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
            times = np.where(single, count, 1)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, start, anchor, single, count = (np.repeat(x, times) for x in (row, start, anchor, single, count))
            start, count = start + nth, np.where(single, 1, count)
            at = np.cumsum(count) - count
            anchor = np.where(single, _mix(anchor ^ _mix(self.hashes[at])), anchor)
        self.row, self.start, self.anchor, self.count = row, start, anchor, count
        self.end = np.cumsum(count)
        # A stretch is told by its anchor, its length and a mix of its window hashes.
        total = np.r_[np.uint64(0), np.cumsum(_mix(self.hashes))]
        whole = _mix(total[self.end] - total[self.end - count]) + count.astype(np.uint64)
        order = np.lexsort((whole, anchor))
        head = np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (whole[order][1:] != whole[order][:-1])]
        group = np.cumsum(head) - 1
        self.repeated, self.sent = np.empty(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
        self.repeated[order] = np.bincount(group)[group] > 1
        self.sent[order[head]] = True


def _settle(held, doc: np.ndarray, th: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Rows of one batch. Stretches that occur in it more than once are settled here, and one of each is sent on."""
    x = _Stretches(held, hot)
    six = np.ascontiguousarray(x.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    offsets = np.r_[0, x.end] * 6
    at = np.flatnonzero(x.sent)
    data = pa.array([six[offsets[i] : offsets[i + 1]] for i in at], pa.binary())
    # Settled stretches that follow each other become one row.
    settled = np.flatnonzero(x.repeated)
    row, start, count = x.row[settled], x.start[settled], x.count[settled]
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1])][: len(settled)])
    n = np.add.reduceat(count, head) if len(head) else count
    row, start = row[head], start[head]
    key = np.r_[x.anchor[at].view(np.int64), _mix(x.anchor[settled[head]] + row.astype(np.uint64)).view(np.int64)]
    rows = np.r_[x.row[at], row]
    kind = np.r_[np.where(x.repeated[at], KNOWN, STRETCH), np.full(len(head), SETTLED)].astype(np.int8)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key),
            pa.array(kind),
            nullable(doc[rows]),
            pa.array(th[rows]),
            pa.array(np.r_[x.start[at], start].astype(np.int32)),
            pa.array(np.r_[x.count[at], n].astype(np.int32)),
            pa.concat_arrays([data, pa.nulls(len(head), pa.binary())]),
        ],
        names=["anchor", "kind", "doc_id", "th", "start", "n", "hashes"],
    )


def _longest_matches(h: np.ndarray, block: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the longest match of the windows from there on with those from another place of its block, and that place.

    ``left`` is the number of windows to the end of the stretch. Suffixes are
    sorted by doubling; the longest match of one is with a neighbour.
    """
    order = np.lexsort((h, block))
    head = np.r_[True, (block[order][1:] != block[order][:-1]) | (h[order][1:] != h[order][:-1])]
    group = np.cumsum(head) - 1
    size = np.bincount(group)
    rank = np.zeros(len(h), dtype=np.int64)  # 0 also stands for the end, and for windows that match none
    rank[order] = np.where(size[group] > 1, group + 1, 0)
    at = np.flatnonzero(rank)
    match, ref = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
    if not len(at):
        return match, ref
    step = 1
    while step < longest:
        behind = np.where(left[at] > step, rank[np.minimum(at + step, len(h) - 1)], 0)
        rank[at] = np.unique(rank[at] * (rank.max() + 1) + behind, return_inverse=True)[1] + 1
        step *= 2
    at = at[np.argsort(rank[at], kind="stable")]
    a, b = at[:-1], at[1:]
    n = np.zeros(len(a), dtype=np.int64)
    live = np.flatnonzero(block[a] == block[b])
    while len(live):
        x, y, k = a[live], b[live], n[live]
        more = (left[x] > k) & (left[y] > k)
        live, x, y, k = live[more], x[more], y[more], k[more]
        live = live[h[x + k] == h[y + k]]
        n[live] += 1
    before, after = np.r_[0, n], np.r_[n, 0]
    match[at] = np.maximum(before, after)
    ref[at] = np.where(before >= after, np.r_[at[:1], at[:-1]], np.r_[at[1:], at[-1:]])
    return match, ref


def _parse(match: np.ndarray, base: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the factors of all stretches: each begins at the first window behind the last factor that matches another."""
    out, stretch, cur = [], np.arange(len(n)), np.zeros(len(n), dtype=np.int64)
    while len(stretch):
        place = base[stretch] + cur
        out.append(place[match[place] > 0])
        cur = cur + np.maximum(match[place], 1)
        live = cur < n[stretch]
        stretch, cur = stretch[live], cur[live]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _factors(window: int):
    """Factors of whole blocks; rows come sorted by anchor."""

    def piece(anchor, kind, doc, th, start, n, data):
        done = kind != STRETCH  # repeated as a whole, so the whole is a factor
        out = [(doc[done], th[done], start[done].astype(np.int64), n[done].astype(np.int64) + window - 1, np.full(done.sum(), NO_ID), np.zeros(done.sum(), dtype=np.int64))]
        live = np.flatnonzero(kind != SETTLED)
        if len(live):
            anchor, kind, doc, th, start, n = anchor[live], kind[live], doc[live], th[live], start[live].astype(np.int64), n[live].astype(np.int64)
            raw = np.frombuffer(b"".join([data[i] for i in live.tolist()]), dtype=np.uint8).reshape(-1, 6)
            h = np.zeros((len(raw), 8), dtype=np.uint8)
            h[:, :6] = raw
            h = h.view("<u8").ravel()
            owner, base = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            inside = np.arange(len(h)) - base[owner]
            block = np.cumsum(np.r_[True, anchor[1:] != anchor[:-1]])[owner]
            match, ref = _longest_matches(h, block, n[owner] - inside, int(n.max()))
            open_ = np.flatnonzero(kind == STRETCH)
            at = _parse(match, base[open_], n[open_])
            who, of = owner[at], owner[ref[at]]
            out.append((doc[who], th[who], start[who] + inside[at], match[at] + window - 1, doc[of], start[of] + inside[ref[at]] + 1))
        doc, th, start, words, ref_doc, ref_start = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays(
            [nullable(doc), pa.array(th), pa.array(start), pa.array(words), nullable(ref_doc), pa.array(ref_start - 1, mask=ref_start == 0)],
            names=["doc_id", "th", "start", "n_words", "ref_doc_id", "ref_start"],
        )

    def run(batches):
        held: list[list] = []
        n_held = 0

        def joined():
            first = [np.concatenate([x[i] for x in held]) for i in range(6)]
            return [*first, [v for x in held for v in x[6]]]

        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.columns
            held.append([c[0].to_numpy(), c[1].to_numpy(), ids(c[2]), c[3].to_numpy(), c[4].to_numpy(), c[5].to_numpy(), c[6].to_pylist()])
            n_held += batch.num_rows
            if n_held >= 60_000:
                rows = joined()
                other = np.flatnonzero(rows[0] != rows[0][-1])
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    yield piece(*[x[:last] for x in rows])
                held, n_held = [[x[last:] for x in rows]], len(rows[0]) - last
        if n_held:
            yield piece(*joined())

    return run


def hot_anchors(docs: DataFrame, window: int = 35) -> np.ndarray:
    """The anchors whose blocks are split, sorted; MAX_HOT at most, the most frequent first."""
    sample = with_text_key(docs).where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(_anchor_counts(window), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > HOT).orderBy(F.desc("n"), "anchor").limit(MAX_HOT).collect()
    return np.sort(np.array([r["anchor"] for r in found], dtype=np.int64).view(np.uint64))


def factors(docs: DataFrame, window: int = 35) -> DataFrame:
    """Duplicate factors: doc_id, th, start (word), n_words, and where the reference has it (ref_doc_id, ref_start).

    ref_start is null for stretches that a batch settled before the shuffle;
    their reference is an equal stretch of the same batch. Words are what ASCII
    white space separates, unchanged. Factors of a document may overlap or
    touch. Null, empty and short texts have none. Rows that agree in doc_id and
    text repeat each other like any two documents. An empty table gives an
    empty result.
    """
    schema = "anchor long, kind byte, doc_id long, th long, start int, n int, hashes binary"
    rows = with_text_key(docs).mapInArrow(_cut(window, hot_anchors(docs, window)), schema)
    blocks = rows.repartition("anchor").sortWithinPartitions("anchor")
    return blocks.mapInArrow(_factors(window), "doc_id long, th long, start long, n_words long, ref_doc_id long, ref_start long")


def _remove(with_text: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, digest, kept_texts = [], [], [], []
            for text, spans in zip(raw_texts(batch.column("text")), batch.column("spans")):
                words = text.split()
                n_words.append(len(words))
                if spans.is_valid:
                    start, n = (spans.values.field(x).to_numpy() for x in ("start", "n_words"))
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept)
            own = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                own.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(own, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each row: the words outside all duplicate factors, joined by one space."""
    spans = factors(docs, window).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    d, s = with_text_key(docs).alias("d"), spans.hint("shuffle_hash").alias("s")
    joined = d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), "left").select("d.doc_id", "d.text", "s.spans")
    return joined.mapInArrow(_remove(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
