import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from codexlake.llm import hadamard_clusters as hc


def floors(v):
    return [int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v]


def plain(rows, k=8, rounds=10):
    """Lloyd's iteration in Python's integers over (key, vector)."""
    kept = [(i, floors(v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def label(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return min((x, i) for i, x in enumerate(d))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(label(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else old for c, old in enumerate(centroids)]
    found = [(i, *label(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == n) for n in range(len(centroids))]
    long = lambda v: v if v < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, long(d), long(inertia[c]), long(sum(inertia)), sha[c]) for i, c, d in found], key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def got(spark, rows, **more):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{more.pop('kind', 'double')}>").withColumn("key", F.lit("x")).withColumn("cluster", F.lit(-1)).withColumn("digit", F.lit(0))
    return sorted([tuple(r[c] for c in COLUMNS) for r in hc.cluster_vectors(df, **more).collect()], key=repr)


def vectors(n, seed, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(64)] for _ in range(5)]
    return [[x + draw.gauss(0, 0.3) for x in draw.choice(centres)] for _ in range(n)]


def test_transform_is_exact_and_keeps_distances():
    x = np.random.default_rng(1).integers(-(2**20), 2**20, (50, 64))
    w = hc.transform(x)
    assert (hc.transform(w) == 64 * x).all()
    assert (((w[:25] - w[25:]) ** 2).sum(axis=1) == 64 * ((x[:25] - x[25:]) ** 2).sum(axis=1)).all()
    order = hc.coarse_first(64)
    assert sorted(order.tolist()) == list(range(64)) and order[0] == 0
    h = hc.transform(np.eye(64, dtype=np.int64))
    assert (np.diff(h[order], axis=1) != 0).sum(axis=1).tolist() == list(range(64))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 50, 10**5, 2**40]), st.integers(1, 9))
def test_nearest_with_ties(seed, size, k):
    draw = np.random.default_rng(seed)
    x = draw.integers(-size, size + 1, (40, 64))
    x[::3] = x[0] + draw.integers(-1, 2, (14, 64))
    c = [x[i].tolist() for i in draw.integers(0, 40, k)]
    x = x if size < 2**20 else x.astype(object)
    label, far = hc.nearest(x, c)
    for row, n, d in zip(x.tolist(), label.tolist(), far.tolist()):
        want = [sum((a - b) ** 2 for a, b in zip(row, m)) for m in c]
        assert (d, n) == (min(want), want.index(min(want)))


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_table(spark, spread):
    found = vectors(400, 3, spread)
    rows = [*enumerate(found), (7, found[7]), (7, found[8]), (None, found[3]), *((1000 + i, found[0]) for i in range(200))]
    rows += [(2000, None), (2001, []), (2002, found[0][:63]), (2003, found[0] + [0.0]), (2004, [None] + found[0][1:]), (2005, [math.nan] + found[0][1:]), (2006, [math.inf] + found[0][1:])]
    assert got(spark, rows) == plain(rows)


def test_large_components(spark):
    found = vectors(60, 5)
    rows = [*enumerate(found), *((100 + i, [x * 10.0 ** (i - 2) for x in found[i]]) for i in range(20)), (200, [1e308] * 64), (201, [-1e300] * 64)]
    assert got(spark, rows) == plain(rows)


def test_few_and_none(spark):
    found = vectors(3, 2)
    assert got(spark, list(enumerate(found))) == plain(list(enumerate(found)))
    assert got(spark, [(1, [1.0])]) == got(spark, []) == []
    same = [(i, [0.5] * 64) for i in range(20)]
    assert got(spark, same) == plain(same)


def test_sums_over_partitions(spark):
    rows = [(i, [float((i * 37 + j) % 11) - 5 for j in range(64)]) for i in range(300)]
    assert got(spark, rows, kind="float") == plain(rows)
