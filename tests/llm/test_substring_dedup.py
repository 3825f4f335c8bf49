import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from brute import DOCS, docs_frame, rows_of, words

from codexlake.llm import substring_dedup as op

COLS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def expected(rows, window):
    count = Counter()
    for _, t, *_ in rows:
        w = words(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_hostile_rows(spark):
    assert rows_of(op.remove_repeats(docs_frame(spark)), *COLS) == expected(DOCS, 35)
    assert op.remove_repeats(docs_frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_shared_passages(spark, seed):
    rng = random.Random(seed)
    pool = [[f"p{k}w{rng.randrange(60)}" for _ in range(rng.choice([34, 35, 36, 50, 90]))] for k in range(8)]
    rows = []
    for d in range(150):
        text = []
        for _ in range(rng.randrange(5)):
            text += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
            p = rng.choice(pool)
            a = rng.randrange(3)
            text += p[a:] if rng.random() < 0.5 else p
        if rng.random() < 0.1:
            text += ["same"] * rng.randrange(100)
        rows.append((d, " ".join(text), "en", "a"))
    rows += [(1000 + i, rows[i % 30][1], "en", "a") for i in range(60)]
    rng.shuffle(rows)
    got = rows_of(op.remove_repeats(docs_frame(spark, rows).repartition(5)), *COLS)
    assert got == expected(rows, 35)


def test_factors_point_at_equal_words(spark):
    rows = [(i, " ".join([*(f"x{i}{j}" for j in range(20)), *(f"s{j}" for j in range(80)), *(f"y{i}{j}" for j in range(9 * i))]), "en", "a") for i in range(6)]
    text = {d: t.split() for d, t, *_ in rows}
    n = 0
    for r in op.factors(docs_frame(spark, rows).repartition(6)).collect():
        if r.ref_start is not None:
            n += 1
            assert text[r.doc_id][r.start : r.start + r.n_words] == text[r.ref_doc_id][r.ref_start : r.ref_start + r.n_words]
            assert (r.doc_id, r.start) != (r.ref_doc_id, r.ref_start) and r.n_words >= 35
    assert n


def test_longest_matches():
    """Against all pairs of places of a block."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 9, size=rng.integers(1, 25))
        block = np.repeat(np.sort(rng.integers(0, 3, size=len(n))), n)
        h = rng.integers(0, 4, size=n.sum()).astype(np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        left = np.concatenate([np.arange(k, 0, -1) for k in n])
        match, ref = op._longest_matches(h, block, left, int(n.max()))

        def common(p, q):
            k = 0
            while k < min(left[p], left[q]) and h[p + k] == h[q + k]:
                k += 1
            return k

        for p in range(len(h)):
            best = max((common(p, q) for q in range(len(h)) if q != p and block[q] == block[p]), default=0)
            assert match[p] == best and (not best or common(p, ref[p]) == best and ref[p] != p)
        base = np.cumsum(n) - n
        covered = np.zeros(len(h), dtype=bool)
        for p in op._parse(match, base, n):
            assert not covered[p] and owner[p + match[p] - 1] == owner[p]
            covered[p : p + match[p]] = True
        assert (covered == (match > 0)).all()


def test_hot_anchors_are_split(spark, monkeypatch):
    """An eight-word phrase in varied contexts, and passages around it that some documents share."""
    rng = random.Random(8)
    phrase = "the one phrase that all of them hold".split()
    rows = []
    for d in range(400):
        side = [[f"{x}{rng.randrange(3) if rng.random() < 0.7 else rng.randrange(10**6)}" for x in "abcdefghijklmnopqrstuvwxyzABCDEF"] for _ in range(2)]
        same = d % 5 == 0
        rows.append((d, " ".join([*(side[0] if not same else [f"s{i}" for i in range(40)]), *phrase, *(side[1] if d % 7 else [f"t{i}" for i in range(40)])]), "en", "a"))
    docs = docs_frame(spark, rows).repartition(5)
    want = expected(rows, 35)
    assert rows_of(op.remove_repeats(docs), *COLS) == want
    monkeypatch.setattr(op, "SAMPLE", 1)
    monkeypatch.setattr(op, "HOT", 3)
    assert len(op.hot_anchors(docs)) > 0
    assert rows_of(op.remove_repeats(docs), *COLS) == want
    assert rows_of(op.remove_repeats(docs_frame(spark)), *COLS) == expected(DOCS, 35)
