"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run repeats its first q words at least ``times`` times over, so each of its
words occurs that often within any stretch that holds the run. A segment is
split at every word that occurs less often within it; the parts are counted
anew, until no segment changes. All texts of a batch are split together: a
round is one sort of (segment, word) pairs of the segments that changed last.

What survives is scanned lag by lag. A run of period q matches itself q words
on at ``(times - 1) * q`` places in a row or more, so ``times - 1`` neighbours
match among every q-th word alone: only these are looked at, and only where
they match the stretch is measured, so the scan takes m log m steps for m
words. A stretch found at a lag has a smaller period only if that period
divides the lag and the same stretch was found there; known runs are passed
over whole.

Memory is bounded by a group of texts of GROUP_BYTES and the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codexlake.llm.common import raw_texts
from codexlake.sources.parallel import spread_small

GROUP_BYTES = 4 << 20
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def segments(ids: np.ndarray, bounds: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Begin and end of the stable segments; bounds are the places where texts begin, and the end."""
    place, part = np.arange(len(ids)), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    width, stable = int(ids.max(initial=0)) + 1, []
    while len(place):
        key = part * width + ids[place]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        size = np.diff(np.r_[first, len(key)])
        n = np.empty(len(key), dtype=np.int64)
        n[order] = np.repeat(size, size)
        enough = n >= times
        changed = np.zeros(int(part[-1]) + 1, dtype=bool)
        changed[part[~enough]] = True
        for settled in (True, False):  # what stays as it is, then what is split
            here = (enough & changed[part]) if not settled else ~changed[part]
            at, of = place[here], part[here]
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(of) != 0)) + 1
            begin, end = np.r_[0, cut][: len(at)], np.r_[cut, len(at)][: len(at)]
            long = end - begin >= least
            begin, end = begin[long], end[long]
            if settled:
                stable += zip(at[begin].tolist(), (at[end - 1] + 1).tolist())
            else:
                size = end - begin
                part = np.repeat(np.arange(len(size)), size)
                place = np.repeat(at[begin], size) + np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
    return sorted(stable)


def _first_difference(w: np.ndarray, i: int, lag: int) -> int:
    """The first place from i on whose word differs from the one a lag on."""
    step, last = 64, len(w) - lag
    while i < last:
        end = min(i + step, last)
        differ = w[i:end] != w[i + lag : end + lag]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = end, 4 * step
    return last


def _last_difference(w: np.ndarray, i: int, lag: int) -> int:
    """The place after the last one before i whose word differs from the one a lag on."""
    step = 64
    while i > 0:
        begin = max(0, i - step)
        differ = (w[begin:i] != w[begin + lag : i + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, step = begin, 4 * step
    return 0


def scan(w: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of one segment, by start and period."""
    found: dict[tuple[int, int], int] = {}
    known = np.full(len(w), -1, dtype=np.int64)  # the longest run that holds a place
    runs: list[tuple[int, int, int]] = []
    need = times - 1
    for lag in range(1, len(w) // times + 1):
        sample = w[::lag]
        same = sample[1:] == sample[:-1]
        row = same[: len(same) - need + 1].copy()
        for k in range(1, need):
            row &= same[k : len(same) - need + 1 + k]
        if not row.any():
            continue
        hits, i = np.flatnonzero(row) * lag, 0
        while i < len(hits):
            x = int(hits[i])
            start, end, period = runs[known[x]] if known[x] >= 0 else (0, 0, 1)
            if lag % period or x + times * lag > end:
                start, end = _last_difference(w, x, lag), _first_difference(w, x, lag) + lag
                if end - start >= max(least, times * lag) and (start, end) not in found:
                    found[start, end] = lag
                    own = known[start:end]
                    shorter = np.array([-1] + [b - a for a, b, _ in runs])[own + 1] < end - start if (own >= 0).any() else slice(None)
                    own[shorter] = len(runs)
                    runs.append((start, end, lag))
            i = int(np.searchsorted(hits, max(end - times * lag, x), side="right"))
    return sorted((a, b - a, q) for a, b, q in runs)


def find_runs(texts: list[list[bytes]], least: int, times: int) -> dict[int, list[tuple[int, int, int]]]:
    """number of a text -> its runs (start, length, period) by start, then period; texts without any are left out."""
    numbers = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, (w for t in texts for w in t)), dtype=np.int64, count=sum(map(len, texts)))
    bounds = np.cumsum([0, *map(len, texts)])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in segments(ids, bounds, least, times):
        runs = scan(ids[begin:end], least, times)
        if runs:
            t = int(np.searchsorted(bounds, begin, side="right")) - 1
            found.setdefault(t, []).extend((int(a + begin - bounds[t]), n, q) for a, n, q in runs)
    return found


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs array<struct<start, length, period>>, collapsed: one row per row of docs.

    A run is a maximal stretch whose words are equal ``period`` words apart,
    with its smallest period, of at least max(least, times * period) words;
    runs are ordered by start, then period, and start counts words from 0.
    collapsed holds the words that no run covers after its first period, joined
    by one blank. Words lie between ASCII white space. Null and empty texts have
    no words, no runs and an empty rest; null and repeated keys stay; other
    columns are left out. times must be 2 or more.
    """
    if times < 2:
        raise ValueError("a run repeats its words twice or more")

    def run(batches):
        for batch in batches:
            for a, words in _grouped(raw_texts(batch.column(1))):
                found = find_runs(words, least, times)
                rest = [_collapsed(w, found[i]) if i in found else b" ".join(w) for i, w in enumerate(words)]
                runs = [[dict(zip(("start", "length", "period"), r)) for r in found.get(i, ())] for i in range(len(words))]
                columns = [batch.column(0)[a : a + len(words)], pa.array(list(map(len, words)), pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(rest, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "runs", "collapsed"])

    rows = spread_small(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _grouped(texts):
    """(number of the first, lists of words) of groups of GROUP_BYTES or one longer text."""
    first, words, size = 0, [], 0
    for text in texts:
        if words and size + len(text) > GROUP_BYTES:
            yield first, words
            first, words, size = first + len(words), [], 0
        words.append(text.split())
        size += len(text)
    if words:
        yield first, words


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text; one document in ten repeats a stretch of its words up to its end.

    With h the CRC-32 of the decimal doc_id and g = h / 10, documents of
    h % 10 = 0 go on from word a = g % n with their next
    p = 1 + (n - a) / (3 + g % 8) words over and over. A null doc_id has no
    decimal form and stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    drawn = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    chosen = F.col("h") % 10 == 0
    w, n, g = F.col("w"), F.size("w"), F.floor(F.col("h") / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    repeated = F.concat_ws(" ", F.concat(F.slice(w, 1, a), tail))
    words = F.when(chosen, words_of(F.col("text"))).otherwise(F.array().cast("array<string>"))
    return drawn.withColumn("w", words).select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, the longest run (ties: smallest start, then period; nulls without one), its exponent in thousandths, and digests of all runs and of the rest."""
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    return found.withColumn("best", best).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
