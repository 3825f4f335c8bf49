import random

import numpy as np
import pytest
from brute import DOCS, components, docs_frame, simhash

from codexlake.llm import simhash as op


def expected(rows):
    prints = [simhash(t) for _, t, *_ in rows]
    root = components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, *_), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted([(d, f"{p:016x}", least.get(r)) for (d, *_), p, r in zip(rows, prints, root)], key=repr)


def found(df):
    return sorted([(r.doc_id, r.fp, r.component_id) for r in op.near_duplicates(df).withColumn("fp", op.fingerprint_hex()).collect()], key=repr)


def test_hostile_rows(spark):
    assert found(docs_frame(spark)) == expected(DOCS)


def test_empty(spark):
    assert found(docs_frame(spark, [])) == []


def test_near_copies(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for d in range(120):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for k in range(rng.choice([1, 1, 3, 6])):
            text = list(base)
            for _ in range(k):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((d * 10 + k, " ".join(text), "en", "a"))
    rng.shuffle(rows)
    assert len({c for _, _, c in expected(rows)}) < len(rows) - 20
    assert found(docs_frame(spark, rows)) == expected(rows)


@pytest.mark.parametrize("cell", [8, 16_384])
def test_links_against_all_pairs(spark, cell, monkeypatch):
    """Fingerprints strewn around few centres; small cells cut the anchors into grids."""
    monkeypatch.setattr(op, "CELL_ROWS", cell)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(14):
            x = c
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    classes = spark.createDataFrame(list(enumerate(signed)), "node long, f0 long")
    links = [(r.a, r.b) for r in op.near_links(classes, 1, (21, 21, 22), 1, 4).collect()]
    assert all(a < b for a, b in links)
    linked = {frozenset(x) for x in links}
    got = components(list(range(len(prints))), lambda i, j: frozenset((i, j)) in linked)
    assert got == components(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_every_value_is_near_one_codeword():
    s = op._syndromes()
    assert np.bincount(s).tolist() == [1 << 11] * 16
