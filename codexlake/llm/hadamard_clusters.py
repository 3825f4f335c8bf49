"""Centroid clustering in exact integers, with a progressive Walsh-Hadamard search.

The transform keeps squared distances up to the factor ``width`` and needs only
additions, so all arithmetic is exact. Coefficients are ordered by their number
of sign changes, coarse ones first, which carry most of the difference between
vectors that are apart. Per vector, the centroid that is nearest by the coarsest
block is finished first and bounds the distance; the differences of the others
add up block by block, and one whose sum exceeds the bound can't be nearest any
more. Those that are left finish all coefficients, so ties are seen as such.

A round reads the vectors once; a task sends one row of sums per centroid, which
Spark adds up, and only the k sums reach the driver. Vectors with large
components are computed in Python's unbounded integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codexlake.sources.parallel import spread_small
from codexlake.sources.scratch import written

#: Sums travel as digits of so many bits.
DIGIT = 40
_LONG = 1 << 63


def small_limit(width: int) -> int:
    """Components below leave room in 64 bits for the sum of the squared differences of all coefficients."""
    return int(2**31 / (2 * width**1.5))


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in Hadamard's order, without scaling. The width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x


def coarse_first(width: int) -> np.ndarray:
    """The coefficients by number of sign changes."""
    return np.argsort((np.diff(transform(np.eye(width, dtype=np.int64)), axis=1) != 0).sum(axis=1), kind="stable")


def integers(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) as int64 of the rows that are small, which rows those are, and the others as Python's integers."""
    values = values.astype(np.float64)
    small = (np.abs(values) * scale < small_limit(values.shape[1])).all(axis=1)
    whole = [[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in row] for row in values[~small].tolist()]
    return np.floor(values[small] * scale).astype(np.int64), small, np.array(whole, dtype=object).reshape(-1, values.shape[1])


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smaller of equals) and the squared distance."""
    n, width = x.shape
    big = x.dtype == object or max(abs(v) for c in centroids for v in c) >= small_limit(width)
    kind = object if big else np.int64
    order = coarse_first(width)
    w, c = transform(x.astype(kind))[:, order], transform(np.array(centroids, dtype=kind))[:, order]
    far = np.zeros((n, len(c)), dtype=kind)
    begin, end = 0, min(4, width)
    row, of = (a.ravel() for a in np.indices(far.shape))
    bound = None
    while begin < width:
        apart = w[row, begin:end] - c[of, begin:end]
        far[row, of] += (apart * apart).sum(axis=1)
        if bound is None:
            rest = w[:, end:] - c[far.argmin(axis=1), end:]
            bound = far.min(axis=1) + (rest * rest).sum(axis=1)
        stay = (far[row, of] <= bound[row]).astype(bool)
        row, of, begin, end = row[stay], of[stay], end, min(2 * end, width)
    done = np.zeros(far.shape, dtype=bool)
    done[row, of] = True
    far = np.where(done, far, far.max(initial=0) + 1)
    return far.argmin(axis=1), far.min(axis=1) // width


def _rows(batches, scale: int):
    """Keys and integers of each batch: a part in 64 bits, a part in Python's integers if there is any."""
    for batch in batches:
        if batch.num_rows:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            few, small, many = integers(values, scale)
            for x, here in ((few, small), (many, ~small)):
                if len(x):
                    yield batch.column(0).filter(pa.array(here)), x


def _sums(centroids: list[list[int]], scale: int):
    width = len(centroids[0])

    def run(batches):
        n, total = [0] * len(centroids), [[0] * width for _ in centroids]
        for _, x in _rows(batches, scale):
            label, _ = nearest(x, centroids)
            for k in np.unique(label).tolist():
                own = x[label == k]
                n[k] += len(own)
                total[k] = [a + b for a, b in zip(total[k], own.sum(axis=0).tolist())]
        for k, count in enumerate(n):
            digits = max(v.bit_length() for v in total[k]) // DIGIT + 1 if count else 0
            for d in range(digits):
                part = [v >> DIGIT * d if d == digits - 1 else v >> DIGIT * d & (1 << DIGIT) - 1 for v in total[k]]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([d], pa.int32()), pa.array([count if d == 0 else 0], pa.int64()), pa.array([part], pa.list_(pa.int64()))], names=["cluster", "digit", "n", "s"])

    return run


def usable(vectors: DataFrame, width: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, vector of the vectors with exactly ``width`` components, none of them null or not finite."""
    finite = F.forall("vector", lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where((F.size("vector") == width) & finite)


def first_centroids(kept: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """Integers of the k vectors with the smallest SHA-256 of ``seed:key``; ties by components; without a key last."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    rows = kept.orderBy(drawn.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return [(x if len(x) else many)[0].tolist() for x, _, many in (integers(np.array([r.vector]), scale) for r in rows)]


def next_centroids(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Componentwise floor of the mean of each centroid's vectors; a centroid without any stays."""
    width = len(centroids[0])
    parts = kept.mapInArrow(_sums(centroids, scale), "cluster int, digit int, n long, s array<long>")
    sums = parts.groupBy("cluster", "digit").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    count, total = {}, {}
    for r in sums.collect():  # k rows, times the digits of the sums
        count[r.cluster] = count.get(r.cluster, 0) + r.n
        total[r.cluster] = [a + (b << DIGIT * r.digit) for a, b in zip(total.get(r.cluster, [0] * width), r[3:])]
    return [[v // count[c] for v in total[c]] if c in count else old for c, old in enumerate(centroids)]


def assign(kept: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """key, cluster, distance (squared; null beyond 64 bits)."""

    def run(batches):
        for keys, x in _rows(batches, scale):
            label, far = nearest(x, centroids)
            distance = pa.array([d if d < _LONG else None for d in far.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(label.astype(np.int32)), distance], names=["key", "cluster", "distance"])

    return kept.mapInArrow(run, f"key {kept.schema['key'].dataType.simpleString()}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, width: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid array<string>, centroid_sha256, one row per usable vector.

    Components become floor(scale * x). The vectors with the k smallest digests
    of their keys start; each round assigns all vectors (squared distance, ties
    to the smaller number) and takes floored means; centroids that don't change
    end the rounds. Vectors of another length, or with null or not finite
    components, are left out; with fewer than k vectors there are fewer
    centroids; without any the result is empty. Repeated keys stay as they are.
    Distances and their sums beyond 64 bits are null. The centroid is written as
    decimal integers.
    """
    kept = written(spread_small(usable(vectors, width, key, vector)), "vectors")
    centroids = first_centroids(kept, k, scale, seed)
    if not centroids:
        shape = f"{key} {vectors.schema[key].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], shape)
    for _ in range(rounds):
        new = next_centroids(kept, centroids, scale)
        if new == centroids:
            break
        centroids = new
    assigned = written(assign(kept, centroids, scale), "assigned")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) if r.known else None for r in assigned.groupBy("cluster").agg(whole.alias("s"), F.every(F.col("distance").isNotNull()).alias("known")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    fits = lambda v: v if v is not None and v < _LONG else None
    names = [[str(v) for v in c] for c in centroids]
    rows = [(c, fits(s), fits(total), names[c], hashlib.sha256(",".join(names[c]).encode()).hexdigest()) for c, s in sums.items()]
    model = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string")
    return assigned.join(F.broadcast(model), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
