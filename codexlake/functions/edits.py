"""Edit distance of many pairs of texts at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Words of 64 rows that are advanced together, and words of the tables of places, for one group of pairs.
WORDS, TABLE = 8192, 1 << 21
ONE, TOP, FULL = np.uint64(1), np.uint64(63), np.uint64(2**64 - 1)


def edit_counts(first: list[str], second: list[str]) -> np.ndarray:
    """Edits (code points inserted, dropped or changed) between each text and its partner.

    Pairs of like length go through their tables side by side, a column a step,
    64 rows a word: a column is the steps up and down that it makes from row to
    row (Myers, Hyyrö).
    """
    longs, shorts = [], []
    for a, b in zip(first, second):
        longs.append(a if len(a) >= len(b) else b)
        shorts.append(b if len(a) >= len(b) else a)
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (longs, shorts))
    out = m.copy()  # what an empty text costs
    todo = np.flatnonzero((n > 0) & np.fromiter((a != b for a, b in zip(longs, shorts)), bool, len(longs)))
    out[[i for i, (a, b) in enumerate(zip(longs, shorts)) if a == b]] = 0
    words = (m + 63) // 64
    order = todo[np.lexsort((-n[todo], words[todo]))]
    letters = len(set().union(*(longs[i] for i in todo))) + 1 if len(todo) else 1
    at = 0
    while at < len(order):
        w = int(words[order[at]])
        size = max(1, min(WORDS // w, TABLE // (w * letters)))
        group = order[at : at + size]
        group = group[words[group] <= w + w // 8]  # few words that only pad; words rise
        group = group[np.argsort(-n[group], kind="stable")]
        out[group] = _group([longs[i] for i in group], [shorts[i] for i in group], m[group], n[group])
        at += len(group)
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length in turn."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _group(longs: list[str], shorts: list[str], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edits of pairs ordered by the falling length ``n`` of the shorter texts, which are its columns.

    Columns end together: a pair joins when its first one comes. Word w is one
    column behind word w - 1, so all words of all pairs make a step at once, in
    one row of numbers, where what goes over is wanted one place further on.
    Before their first column words stand still; after the last they run on, so
    they are copied there.
    """
    pairs, width, w = len(longs), int(n[0]), int((m.max() + 63) // 64)
    rows, columns = _codes(longs), _codes(shorts)
    letter = np.zeros(max(rows.max(), columns.max()) + 1, np.int64)
    letter[rows] = 1
    letter = np.cumsum(letter) * letter  # 0: in none of the longer texts
    letters = int(letter.max()) + 1
    places = np.zeros(pairs * letters * w, np.uint64)
    row = _within(m)
    np.add.at(places, (np.repeat(np.arange(pairs), m) * letters + letter[rows]) * w + row // 64, ONE << (row % 64).astype(np.uint64))
    # columns backwards, so that the words' columns of a step lie in their order; letter 0 before and after them
    own = np.repeat(np.arange(pairs), n)
    asked = np.tile((np.arange(pairs) * letters * w)[:, None], (1, width + 2 * w - 2))
    asked[own, w - 1 + np.repeat(n, n) - 1 - _within(n)] += letter[columns] * w
    begins = np.searchsorted(width - n, np.arange(width), side="right")
    word = np.arange(w)
    up, down, more, less, found, kept, crossed, low = (np.zeros(pairs * w + 1, np.uint64) for _ in range(8))
    up[:] = FULL
    last_up, last_down = np.empty((pairs, w), np.uint64), np.empty((pairs, w), np.uint64)
    cells = np.empty((pairs, w), np.int64)
    for t in range(width + w - 1):
        k = begins[min(t, width - 1)]
        u, d, carry, borrow, same, keep, cross, fall = (x[: k * w] for x in (up, down, more, less, found, kept, crossed, low))
        carry[::w] = 1
        borrow[::w] = 0
        begin = width + w - 2 - t
        np.add(asked[:k, begin : begin + w], word, out=cells[:k])
        places.take(cells[:k].ravel(), out=same, mode="wrap")  # all are inside; the mode that raises copies
        np.bitwise_or(same, d, out=keep)
        same |= borrow
        np.bitwise_and(same, u, out=cross)
        cross += u
        cross ^= u
        cross |= same
        np.bitwise_and(cross, u, out=fall)
        cross |= u
        rise = np.invert(cross, out=cross)
        rise |= d
        np.left_shift(rise, ONE, out=d)
        d |= carry
        np.left_shift(fall, ONE, out=u)
        u |= borrow
        np.right_shift(rise, TOP, out=more[1 : k * w + 1])
        np.right_shift(fall, TOP, out=less[1 : k * w + 1])
        np.bitwise_or(keep, d, out=same)
        np.invert(same, out=same)
        u |= same
        d &= keep
        if t >= width - 1:
            at = t - width + 1
            last_up[:, at], last_down[:, at] = u[at::w], d[at::w]
    left = np.clip(m[:, None] - word * 64, 0, 64)
    mask = np.where(left == 0, np.uint64(0), FULL >> (64 - np.maximum(left, 1)).astype(np.uint64))
    count = lambda bits: np.bitwise_count(bits & mask).sum(axis=1, dtype=np.int64)
    return n + count(last_up) - count(last_down)


@F.pandas_udf(IntegerType())
def edits(first: pd.Series, second: pd.Series) -> pd.Series:
    """Edit distance in code points, as levenshtein(); null if a text is."""
    known = first.notna() & second.notna()
    out = pd.Series(pd.array([None] * len(first), dtype="Int32"), index=first.index)
    out[known] = edit_counts(first[known].tolist(), second[known].tolist())
    return out
