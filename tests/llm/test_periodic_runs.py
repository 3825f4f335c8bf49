import hashlib
import random
import zlib

import numpy as np
from brute import DOCS, docs_frame, rows_of, words
from hypothesis import given, settings, strategies as st

from codexlake.llm import periodic_runs as pr


def plain_runs(w, least=6, times=4):
    """Every maximal stretch at every lag, kept at its smallest period only."""
    found = {}
    for q in range(1, len(w) + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(doc_id, text):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60) | st.lists(st.sampled_from([b"a", b"b"]), max_size=120), max_size=4), st.sampled_from([(6, 4), (6, 2), (1, 2), (5, 3), (9, 5)]))
def test_runs_of_random_words(texts, limits):
    found = pr.find_runs(texts, *limits)
    assert [found.get(i, []) for i in range(len(texts))] == [plain_runs(t, *limits) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=7), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_pieces(pieces):
    text = [w for piece, n in pieces for w in piece * n]
    assert pr.find_runs([text], 6, 4).get(0, []) == plain_runs(text)


def test_rare_words_split_until_nothing_changes():
    # x occurs often in the whole, but not within the parts that y leaves
    text = [b"y" if i % 9 == 8 and i < 27 else b"x" if i % 3 == 0 else b"z" for i in range(40)]
    ids = np.array([{b"x": 0, b"y": 1, b"z": 2}[w] for w in text])
    parts = pr.segments(ids, np.array([0, 40]), 6, 4)
    for begin, end in parts:
        assert end - begin >= 6 and np.unique(ids[begin:end], return_counts=True)[1].min() >= 4
    assert pr.find_runs([text], 6, 4).get(0, []) == plain_runs(text)


def test_long_texts():
    draw = random.Random(4)
    noise = [draw.choice([b"a", b"b", b"c"]) for _ in range(60_000)]
    period = [b"%d" % draw.randrange(500) for _ in range(7_000)]
    assert pr.find_runs([[b"a"] * 200_000], 6, 4) == {0: [(0, 200_000, 1)]}
    assert (0, 35_000, 7_000) in pr.find_runs([period * 5], 6, 4)[0]
    found = pr.find_runs([noise], 6, 4)[0]
    for start, length, q in found:
        stretch = noise[start : start + length]
        assert stretch[q:] == stretch[:-q] and length >= max(6, 4 * q)
    short = [r for at in range(0, 60_000, 1000) for r in plain_runs(noise[at : at + 1100]) if r[0] + r[1] < 1100 and (r[0] or not at)]
    assert len(short) >= len(found)


def test_table(spark):
    draw = random.Random(9)
    rows = [*DOCS, *((100 + i, " ".join(draw.choice("abcdefgh") * draw.randrange(1, 3) for _ in range(draw.randrange(200))), "en", "a") for i in range(300)), (9, "é\x1cè\x85é  " * 40, "fr", "b")]
    got = pr.digests(pr.periodic_runs(pr.with_repeats(docs_frame(spark, rows))))
    assert rows_of(got, *COLUMNS) == sorted([plain_row(d, t) for d, t, *_ in rows], key=repr)
    assert sum(r.n_runs > 0 and r.period > 3 for r in got.collect()) > 5


def test_empty(spark):
    assert pr.digests(pr.periodic_runs(pr.with_repeats(docs_frame(spark, [])))).collect() == []
