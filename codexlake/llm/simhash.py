"""SimHash near-dedup with anchor-point covering.

A fingerprint is cut into blocks. Two fingerprints that differ in few bits
differ in at most ``t`` bits in some block, so each block is searched alone.
In a block the anchors are the codewords of a covering code: the perfect
(15, 11) Hamming code on 15 bits (every value lies within 1 of exactly one
codeword) times all values of the remaining bits. A fingerprint *owns* the
anchor nearest to it and is replicated to each anchor within covering radius
plus ``t``; so for two values at most ``t`` apart, one owns an anchor the other
was replicated to. Fingerprints are compared per anchor, in full width.

Equal fingerprints are one class and are searched once. An anchor with very
many rows is cut into a grid of cells, each with a slice of the owners and a
slice of the replicas, so no task holds a whole large group. A cell does not
return all its pairs: it links each fingerprint to the first owner it meets
and those owners to each other, which has the same components.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codexlake.llm.common import raw_texts, text_key, with_text_key
from codexlake.operators.components import connected_components
from codexlake.sources.scratch import written

HAMMING = 15
#: Rows of an anchor beyond which it is cut into cells, and the number of such anchors that may be broadcast.
CELL_ROWS, MAX_HOT = 16_384, 200_000
#: Pairs compared at once.
STEP = 300_000
#: A shingle is ordered last if more than HOT_SETS of one in SAMPLE sets hold it; so many at most.
SAMPLE, HOT_SETS, MAX_COMMON = 16, 4, 200_000
#: Sets to verify whose numbers may be broadcast.
MAX_NEEDED = 500_000
#: Classes without any doc_id are numbered from here on.
NO_DOC = 1 << 62


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles in their order, repeated ones too."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(joined[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=np.uint64)


def _bits(h: np.ndarray, n_words: int) -> np.ndarray:
    """n_words uint64 values. The first is the plain 64-bit SimHash; the others use remixed shingle hashes."""
    out = np.zeros(n_words, dtype=np.uint64)
    if not len(h):
        return out
    for w in range(n_words):
        if w:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 65_536):
            part = h[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def _fingerprint(text: bytes, shingle: int, n_words: int) -> np.ndarray:
    return _bits(_shingles(text, shingle), n_words)


def _fingerprints(shingle: int, n_words: int):
    def run(batches):
        for batch in batches:
            found = np.array([_fingerprint(x, shingle, n_words) for x in raw_texts(batch.column("text"))], dtype=np.uint64).reshape(-1, n_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), *[pa.array(np.ascontiguousarray(found[:, w]).view(np.int64)) for w in range(n_words)]],
                names=["doc_id", "th", *[f"f{w}" for w in range(n_words)]],
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, n_words: int = 1) -> DataFrame:
    """doc_id, th (common.text_key) and the fingerprint words f0, f1, ... (signed 64-bit views) of each row of ``docs``.

    A-Z is lower-cased, words are what ASCII white space separates. A null or
    empty text has fingerprint zero; a text of fewer words than a shingle is
    one shingle. Other columns are ignored; repeated rows repeat.
    """
    schema = "doc_id long, th long, " + ", ".join(f"f{w} long" for w in range(n_words))
    return with_text_key(docs).mapInArrow(_fingerprints(shingle, n_words), schema)


@lru_cache
def _syndromes() -> np.ndarray:
    """Of all 15-bit values: 0 for codewords, else 1 + the bit to flip to reach the nearest one."""
    out = np.zeros(1 << HAMMING, dtype=np.uint8)
    values = np.arange(1 << HAMMING)
    for bit in range(HAMMING):
        out ^= (((values >> bit) & 1) * (bit + 1)).astype(np.uint8)
    return out


@lru_cache
def _patterns(width: int, t: int) -> list[np.ndarray]:
    """By syndrome: the masks that lead from a block value to each anchor within 1 + t bits, the own anchor's first."""
    reach = [0]
    by_weight = [[0]]
    for _ in range(1 + t):
        by_weight.append(sorted({m ^ (1 << b) for m in by_weight[-1] for b in range(width) if not m >> b & 1}))
        reach += by_weight[-1]
    out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    for mask in reach:  # by weight, so the first of a syndrome is the nearest within the code
        out[int(_syndromes()[mask & ((1 << HAMMING) - 1)])].append(mask)
    own = [0, *[1 << b for b in range(HAMMING)]]
    return [np.array([own[s], *[m for m in masks if m != own[s]]], dtype=np.int64) for s, masks in enumerate(out)]


def block_layout(n_words: int, widths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(word, shift, width) of each block; blocks fill each word from its lowest bit."""
    return [(w, sum(widths[:i]), width) for w in range(n_words) for i, width in enumerate(widths)]


def _block(words: list[np.ndarray], word: int, shift: int, width: int) -> np.ndarray:
    return ((words[word].view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _replicas(layout: list[tuple[int, int, int]], n_words: int, t: int, keys_only: bool):
    names = [f"f{w}" for w in range(n_words)]

    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            words = [batch.column(n).to_numpy() for n in names]
            for number, (word, shift, width) in enumerate(layout):
                value = _block(words, word, shift, width)
                kind = _syndromes()[value & ((1 << HAMMING) - 1)]
                keys, rows, owned = [], [], []
                for s, masks in enumerate(_patterns(width, t)):
                    at = np.flatnonzero(kind == s)
                    if len(at):
                        keys.append(((value[at, None] ^ masks[None, :]) | (number << 40)).ravel())
                        rows.append(np.repeat(at, len(masks)))
                        owned.append(np.tile(np.arange(len(masks)) == 0, len(at)))
                if not keys:
                    continue
                key, row = np.concatenate(keys), np.concatenate(rows)
                if keys_only:
                    unique, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n)], names=["key", "n"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.concatenate(owned)), pa.array(node[row]), *[pa.array(w[row]) for w in words]],
                        names=["key", "owned", "node", *names],
                    )

    return run


def _thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same components: each b keeps its first a, and its other a's are linked to that one."""
    if len(a) < 2:
        return a, b
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    head = np.r_[True, b[1:] != b[:-1]]
    first = a[np.flatnonzero(head)[np.cumsum(head) - 1]]
    rest = ~head & (first != a)
    pairs = np.unique(np.column_stack([first[rest], a[rest]]), axis=0)
    return np.r_[a[head], pairs[:, 0]], np.r_[b[head], pairs[:, 1]]


def _near(owner: np.ndarray, other: np.ndarray, words: list[np.ndarray], threshold: int) -> np.ndarray:
    apart = np.zeros(len(owner), dtype=np.int64)
    for w in words:  # unsigned: of a negative number bitwise_count() takes the absolute value
        apart += np.bitwise_count((w[owner] ^ w[other]).view(np.uint64))
    return apart <= threshold


def _links(layout: list[tuple[int, int, int]], n_words: int, t: int, threshold: int):
    """Links inside cells. Input rows are sorted by cell (key, cell), owners first."""

    def once(owner, other, words, number, node, owned):
        """Of the pairs found here, those to report here.

        A pair that meets in several blocks or at both anchors is reported in
        the first block that brings it within t bits, at the anchor of its
        smaller node. Pairs that no block brings within t bits were met by
        chance and are reported wherever they are met.
        """
        place = np.full(len(owner), -1)
        x = [w[owner] ^ w[other] for w in words]
        for k in range(len(layout) - 1, -1, -1):
            place[np.bitwise_count(_block(x, *layout[k])) <= t] = k
        return (place < 0) | (place == number[owner]) & (owned[other] | (node[owner] < node[other]))

    def piece(rows):
        key, cell, owned, node, *words = rows
        n = len(key)
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        size = np.diff(np.r_[head, n])
        end = np.repeat(head + size, size)
        owners = np.flatnonzero(owned)
        count = end[owners] - owners - 1
        out_a, out_b = [], []
        at = 0
        ahead = np.r_[0, np.cumsum(count)]
        while at < len(owners):
            stop = max(at + 1, int(np.searchsorted(ahead, ahead[at] + STEP, side="right")) - 1)
            c = count[at:stop]
            owner = np.repeat(owners[at:stop], c)
            other = owner + 1 + np.arange(len(owner)) - np.repeat(np.cumsum(c) - c, c)
            hit = np.flatnonzero(_near(owner, other, words, threshold))
            if len(hit):
                owner, other = owner[hit], other[hit]
                keep = once(owner, other, words, key >> 40, node, owned) & (node[owner] != node[other])
                a, b = _thin(node[owner[keep]], node[other[keep]])
                out_a.append(a)
                out_b.append(b)
            at = stop
        if out_a:
            return _thin(np.concatenate(out_a), np.concatenate(out_b))
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def run(batches):
        held: list[list[np.ndarray]] = []
        n_held = 0

        def columns(parts):
            return [np.concatenate(x) for x in zip(*parts)]

        def pack(found):
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(*found)), pa.array(np.maximum(*found))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            n_held += batch.num_rows
            if n_held >= 150_000:
                rows = columns(held)
                last = _last_start(rows[0], rows[1])
                if last:
                    yield pack(piece([x[:last] for x in rows]))
                held, n_held = [[x[last:] for x in rows]], len(rows[0]) - last
        if n_held:
            yield pack(piece(columns(held)))

    return run


def _last_start(key: np.ndarray, cell: np.ndarray) -> int:
    other = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
    return int(other[-1]) + 1 if len(other) else 0


def near_links(classes: DataFrame, n_words: int, widths: tuple[int, ...], t: int, threshold: int) -> DataFrame:
    """Links (a, b), a < b, with the components of all pairs of ``classes`` (node, f0, ...) found near each other.

    Complete for pairs that differ by at most ``t`` bits in some block, hence
    for all pairs within (t + 1) * blocks - 1 bits.
    """
    layout = block_layout(n_words, widths)
    counts = classes.mapInArrow(_replicas(layout, n_words, t, True), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") > CELL_ROWS), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(CELL_ROWS, total // MAX_HOT)  # so at most MAX_HOT anchors are beyond it
    hot = counts.where(F.col("n") > limit).select("key", F.ceil(F.col("n") / limit).cast("int").alias("k"))
    names = [f"f{w}" for w in range(n_words)]
    schema = "key long, owned boolean, node long, " + ", ".join(f"{n} long" for n in names)
    rows = classes.mapInArrow(_replicas(layout, n_words, t, False), schema).join(F.broadcast(hot), "key", "left")
    lane = F.expr("int(pmod(xxhash64(node), k))")
    as_any = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct((i * F.col("k") + lane).alias("cell"), F.lit(False).alias("owned")))
    as_owner = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct((lane * F.col("k") + j).alias("cell"), F.lit(True).alias("owned")))
    whole = F.array(F.struct(F.lit(0).alias("cell"), F.col("owned")))
    places = F.when(F.col("k").isNull(), whole).when(F.col("owned"), F.concat(as_any, as_owner)).otherwise(as_any)
    rows = rows.withColumn("at", F.explode(places)).select("key", "at.cell", "at.owned", "node", *names)
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", F.desc("owned"))
    return rows.mapInArrow(_links(layout, n_words, t, threshold), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, n_words: int = 1, widths: tuple[int, ...] = (21, 21, 22), t: int = 1, threshold: int = 4) -> DataFrame:
    """doc_id, th, the fingerprint words and component_id, one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``threshold`` differing bits, the row's own included; rows without doc_id
    take part, and have a null component_id if none they reach has one.
    Doc ids must lie below 2^62. Empty tables give an empty result.
    """
    names = [f"f{w}" for w in range(n_words)]
    prints = written(fingerprints(docs, shingle, n_words), "fingerprints")
    free = F.lit(NO_DOC) + F.xxhash64(*names).bitwiseAND(F.lit((1 << 61) - 1))
    classes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("least")).select(*names, F.coalesce("least", free).alias("node")), "classes")
    links = near_links(classes, n_words, widths, t, threshold)
    found = connected_components(links)
    labelled = classes.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("c"))
    labelled = written(labelled.select(*names, F.when(F.col("c") < NO_DOC, F.col("c")).alias("component_id")), "labelled")
    return prints.join(labelled, names).select("doc_id", "th", *names, "component_id")


def _node(h: np.ndarray) -> int:
    """Names a set of shingles, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64))


def _few(batches, rows: int = 1_000):
    """Batches of fewer rows, as sets take far more memory than their texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _set_prints(shingle: int, n_words: int):
    def run(batches):
        for batch in _few(batches):
            sets = [np.unique(_shingles(x, shingle)) for x in raw_texts(batch.column("text"))]
            prints = np.array([_bits(h, n_words) for h in sets], dtype=np.uint64).reshape(-1, n_words)
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(list(map(_node, sets)), pa.int64()), *[pa.array(np.ascontiguousarray(prints[:, w]).view(np.int64)) for w in range(n_words)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "node", *[f"f{w}" for w in range(n_words)]])

    return run


def _shingle_sets(shingle: int):
    def run(batches):
        for batch in _few(batches):
            sets = [np.unique(_shingles(x, shingle)) for x in raw_texts(batch.column("text"))]
            values = pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(h) for h in sets])].astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, sets)), pa.int64()), lists], names=["node", "shingles"])

    return run


class _Sets:
    """The shingle sets of texts. Only their names and fingerprints are stored; sets are made anew where a step needs some."""

    def __init__(self, docs: DataFrame, shingle: int, n_words: int):
        self.texts, self.shingle = with_text_key(docs), shingle
        schema = "doc_id long, th long, node long, " + ", ".join(f"f{w} long" for w in range(n_words))
        self.names = written(self.texts.mapInArrow(_set_prints(shingle, n_words), schema), "sets")

    def all(self, where=None) -> DataFrame:
        """node, shingles of every text, or of those that satisfy a condition on doc_id and th."""
        texts = self.texts if where is None else self.texts.where(where)
        return texts.mapInArrow(_shingle_sets(self.shingle), "node long, shingles array<long>")

    def prefixes(self, hot: np.ndarray) -> DataFrame:
        """h, node, n, i of every text; one worker of a task does both steps."""
        sets, rows = _shingle_sets(self.shingle), _prefixes(hot, False)
        return self.texts.mapInArrow(lambda batches: rows(sets(batches)), "h long, node long, n int, i int")

    def of_pairs(self, pairs: DataFrame) -> DataFrame:
        """node, shingles of the sets that pairs (a, b) name, once each."""
        need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        first = self.names.join(need, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("r"))
        first = written(first.select("r.doc_id", "r.th").distinct(), "first")
        n = F.broadcast(first).alias("n") if first.count() <= MAX_NEEDED else first.alias("n")
        t = self.texts.alias("t")
        texts = t.join(n, F.col("t.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("t.th") == F.col("n.th")), "left_semi")
        return texts.mapInArrow(_shingle_sets(self.shingle), "node long, shingles array<long>").dropDuplicates(["node"])


def _prefixes(hot: np.ndarray, as_lists: bool):
    """Of each set the first n - ceil(0.8 n) + 1 shingles, those in ``hot`` last: as one list, or a row each with its place.

    ``hot`` has two rows: shingles, sorted, and the place of each among them.
    A list comes with the size of its set and the place of its last shingle in
    the order of all shingles (``late``, ``least``).
    """
    hot, rank = hot

    def run(batches):
        for batch in batches:
            found = []
            for node, h in zip(batch.column("node").to_pylist(), batch.column("shingles")):
                h = h.values.to_numpy(zero_copy_only=False)
                n, early = len(h), len(h)
                places = (h.view(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                if len(hot) and n:
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    late = hot[at] == h
                    order = np.lexsort((np.where(late, rank[at], places), late))
                    h, places, early = h[order], np.where(late, rank[at], places)[order], n - int(late.sum())
                h = h[: n - (4 * n + 4) // 5 + 1]
                if as_lists and n:
                    found.append((node, h, n, len(h) > early, int(places[len(h) - 1])))
                elif n:
                    found.append((h, np.full(len(h), node), np.full(len(h), n, dtype=np.int32), np.arange(len(h), dtype=np.int32)))
            if found and as_lists:
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names=["node", "prefix", "n", "late", "least"])
            elif found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["h", "node", "n", "i"])

    return run


def _shared(batches):
    """Of rows sorted by h and node one of each, where another node has the same h."""
    last, joined = None, False

    def pack(columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "node", "n", "i"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if last is not None:
            columns = [np.concatenate(x) for x in zip(last, columns)]
        h, node = columns[:2]
        new = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])]
        columns = [c[new] for c in columns]
        same = columns[0][1:] == columns[0][:-1]
        after = np.r_[joined, same]
        met = np.flatnonzero(after[:-1] | same)
        if len(met):
            yield pack([c[met] for c in columns])
        last, joined = [c[-1:] for c in columns], bool(after[-1])
    if joined:
        yield pack(last)


def _common_shingles(sets: _Sets) -> np.ndarray:
    """The most frequent shingles of a sample of the texts, sorted, and their places by frequency, the rarest first.

    They only put the prefixes into a better order; any order is right.
    """
    sample = sets.all(F.pmod("th", F.lit(SAMPLE)) == 0).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    common = sample.where(F.col("c") > HOT_SETS).orderBy(F.desc("c"), "h").limit(MAX_COMMON).collect()
    rows = np.array([(r["h"], i) for i, r in enumerate(reversed(common))], dtype=np.int64).reshape(-1, 2)
    return rows[np.argsort(rows[:, 0], kind="stable")].T.copy()


def _prefix_rows(sets: _Sets, hot: np.ndarray) -> DataFrame:
    """h, node, n, i: two sets of Jaccard similarity 0.8 or more share an h; those of one set only are left out.

    That holds for any order of the shingles that all sets follow. They are
    sorted by hash, those in ``hot`` after all others and by frequency.
    """
    return sets.prefixes(hot).repartition("h").sortWithinPartitions("h", "node").mapInArrow(_shared, "h long, node long, n int, i int")


def _within_reach(pairs: DataFrame, sets: _Sets, hot: np.ndarray) -> DataFrame:
    """The pairs (a, b) that may still be similar by what their prefixes share.

    Of the prefix that ends first in the order of all shingles, those that the
    other prefix doesn't have are not in the other set at all. So no more can be
    shared than what both prefixes share and what lies behind that one.
    """
    lists = written(sets.of_pairs(pairs).mapInArrow(_prefixes(hot, True), "node long, prefix array<long>, n int, late boolean, least long"), "lists")
    side = lambda node: lists.select(F.col("node").alias(node), F.struct("prefix", "n", F.struct("late", "least").alias("end"), (F.col("n") - F.size("prefix")).alias("behind")).alias(f"_{node}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    behind = F.when(F.col("_a.end") <= F.col("_b.end"), F.col("_a.behind")).otherwise(F.col("_b.behind"))
    shared = F.size(F.array_intersect("_a.prefix", "_b.prefix"))
    return both.where(9 * (shared + behind) >= 4 * (F.col("_a.n") + F.col("_b.n"))).select("a", "b")


def _similar(pairs: DataFrame, sets: _Sets) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard similarity 0.8 or more, by exact counts."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    used = written(sets.of_pairs(pairs), "used")
    x, y = used.select(F.col("node").alias("a"), F.col("shingles").alias("x")), used.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    return written(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "similar")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, n_words: int = 3, widths: tuple[int, ...] = (16, 16, 16, 16), t: int = 1, threshold: int = 32) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their near-duplicate group, all columns as they are.

    Groups are the components of all pairs whose sets of 5-word shingles have
    Jaccard similarity 0.8 or more. Fingerprints (192 bits of the set by
    default) propose links, which are verified by exact counts and contract
    the large groups. What they miss, or link by one failing pair, is found by
    prefixes of the sets: sets that similar share a shingle of their prefixes.
    All such pairs that lie in different groups are verified as well. Rows that
    agree in doc_id and text stay or go together.
    """
    names = [f"f{w}" for w in range(n_words)]
    sets = _Sets(docs, shingle, n_words)
    classes = written(sets.names.select("node", *names).distinct(), "classes")
    tried = written(near_links(classes, n_words, widths, t, threshold).distinct(), "tried")
    sure = _similar(tried, sets)
    labels = connected_components(sure)
    hot = _common_shingles(sets)
    rows = written(_prefix_rows(sets, hot).join(labels, "node", "left").select("h", "node", "n", "i", F.coalesce("component", "node").alias("c")), "prefixes")
    shared = rows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    rows = written(rows.join(shared, "h", "left_semi"), "shared")
    x, y = rows.toDF("h", "a", "n", "i", "c"), rows.toDF("h", "b", "m", "j", "d")
    # what two sets share lies at or behind the first shared place of each, and must be 4 / 9 of their sizes
    pairs = x.join(y, "h").where("a < b AND c <> d AND 9 * least(n - i, m - j) >= 4 * (n + m)").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    pairs = _within_reach(written(pairs, "candidates"), sets, hot)
    found = connected_components(sure.union(_similar(pairs, sets)))
    members = sets.names.select("doc_id", "th", "node").join(found, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("c"))
    members = written(members, "members")
    least = members.groupBy("c").agg(F.min("doc_id").alias("least"))
    kept = members.join(least, "c").where(F.col("doc_id").eqNullSafe(F.col("least"))).select("doc_id", "th").distinct().hint("shuffle_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (text_key(docs["text"].cast("string")) == kept["th"])
    return docs.join(kept, same, "left_semi")


def fingerprint_hex(word: str = "f0"):
    return F.lower(F.lpad(F.hex(word), 16, "0"))
