"""Vector search and k-means."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codexlake.sources.scratch import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero or null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to one query vector; ties by key. Each task keeps k rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


#: Query vectors that every task holds at once, and similarities of them that it works out at once.
QUERY_BLOCK, CELLS = 4096, 1 << 20


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """query, key, similarity, rank: the k rows most similar to each query vector (key, vector), itself included.

    Similarities are rounded to ``digits`` and ties follow the key. Queries go
    in blocks of QUERY_BLOCK against one scan of all rows each; a task keeps k
    rows per query and batch, and what is left meets per query. A null or zero
    vector has similarity 0; queries without a key are left out.
    """
    names = queries.select(F.col(key).alias("query"), F.col(vector).alias("q")).where("query IS NOT NULL")
    n = max(1, -(-names.count() // QUERY_BLOCK))
    kind = vectors.schema[key].dataType.simpleString()
    found = None
    for block in range(n):
        rows = names.where(F.pmod(F.xxhash64("query"), F.lit(n)) == block).orderBy("query").collect()
        if rows:
            part = vectors.select(key, vector).mapInPandas(_scored(rows, k, key, vector, digits), f"query {kind}, {key} {kind}, similarity double")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select(F.col(key).alias("query"), key, F.lit(0.0).alias("similarity"), F.lit(1).alias("rank")).limit(0)
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col(key).alias("v")))), 1, k).alias("x"))
    return best.select("query", F.posexplode("x").alias("rank", "x")).select("query", F.col("x.v").alias(key), (-F.col("x.s")).alias("similarity"), (F.col("rank") + 1).cast("int").alias("rank"))


def _unit(vectors, width: int) -> np.ndarray:
    m = np.array([np.zeros(width) if v is None else np.asarray(v, dtype=np.float64) for v in vectors]).reshape(-1, width)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _scored(rows, k: int, key: str, vector: str, digits: int):
    ids = np.array([r["query"] for r in rows])
    width = max((len(r["q"]) for r in rows if r["q"] is not None), default=1)
    q = _unit([r["q"] for r in rows], width)

    def run(batches):
        for b in batches:
            own = b[key].to_numpy()
            order = np.argsort(own, kind="stable")
            rows = _unit(b[vector].to_numpy()[order], width).T
            step = max(1, CELLS // max(1, len(own)))  # queries at a time
            for i in range(0, len(q), step):
                similar = np.round(q[i : i + step] @ rows, digits)
                best = np.argsort(-similar, axis=1, kind="stable")[:, :k]  # of equals the smallest key
                yield pd.DataFrame({"query": np.repeat(ids[i : i + step], best.shape[1]), key: own[order][best].ravel(), "similarity": np.take_along_axis(similar, best, axis=1).ravel()})

    return run


def _labels(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the first of equals."""
    apart = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    return apart.argmin(axis=1)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def kmeans(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 0, iterations: int = 100, draw: Column | None = None) -> DataFrame:
    """key, cluster by Lloyd's iteration.

    Starts from the first k rows by ``draw`` (a seeded hash of the key if none
    is given), then by key. A round is
    one scan: a task labels its Arrow batches against the matrix of centroids
    and sends one row of sums per centroid, which Spark adds up, so k rows reach
    the driver. An empty cluster keeps its centroid. Stops when no centroid
    moves, as then no row changes its cluster. Vectors that are null, shorter or
    longer than the first centroid, or hold nulls, are left out.
    """
    drawn = F.xxhash64(F.lit(seed), key) if draw is None else draw
    whole = vectors.select(key, vector).where(F.forall(vector, lambda x: x.isNotNull()))
    start = whole.orderBy(drawn.asc_nulls_last(), key).limit(k).select(vector).collect()
    kind = vectors.schema[key].dataType.simpleString()
    if not start:
        return vectors.select(key, F.lit(0).alias("cluster")).limit(0)
    width = len(start[0][0])
    usable = whole.where(F.size(vector) == width)
    centroids = np.array([r[0] for r in start if len(r[0]) == width], dtype=np.float64)

    def sums(now: np.ndarray):
        def run(batches):
            n, total = np.zeros(len(now), dtype=np.int64), np.zeros((2, *now.shape), dtype=np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), width)
                label = _labels(x, now)
                n += np.bincount(label, minlength=len(now))
                high = np.floor(x * 2.0**8)
                digits = np.stack([high, np.floor((x * 2.0**8 - high) * 2.0**32)]).astype(np.int64)  # two digits, so that no sum overflows
                for c in range(len(now)):
                    total[:, c] += digits[:, label == c].sum(axis=1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *[pa.array(t[at].tolist(), pa.list_(pa.int64())) for t in total]], names=["cluster", "n", "high", "low"])

        return run

    def assign(now: np.ndarray):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_labels(_matrix(batch.column(1), width), now).astype(np.int32))], names=[key, "cluster"])

        return run

    for _ in range(iterations):
        parts = usable.select(vector).mapInArrow(sums(centroids), "cluster int, n long, high array<long>, low array<long>")
        new, places = centroids.copy(), parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "t"))
        for r in places.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("t.high").alias("high"), F.sum("t.low").alias("low")).collect():
            new[r.cluster, r.i] = float((r.high << 32) + r.low) / r.n / 2.0**40
        if (new == centroids).all():
            break
        centroids = new
    return usable.mapInArrow(assign(centroids), f"{key} {kind}, cluster int")


def embed(docs: DataFrame, provider, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, embedding of non-blank texts by a provider: list of texts -> list of vectors, called per Arrow batch."""

    def run(batches):
        for b in batches:
            b = b[b["text"].notna() & (b["text"].str.strip() != "")]
            if len(b):
                out = b[["key"]].copy()
                out["embedding"] = [np.asarray(v, dtype=np.float32).tolist() for v in provider(b["text"].tolist())]
                yield out

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def cluster_members(assigned: DataFrame, key: str = "vec_id") -> DataFrame:
    return written(assigned.groupBy("cluster").agg(F.count("*").alias("members"), F.min(key).alias("first")), "clusters")
