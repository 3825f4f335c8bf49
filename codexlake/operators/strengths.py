"""Bradley-Terry strengths per bucket, from aggregated pair counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codexlake.sources.scratch import written

MIN_COMPARISONS, MAX_ITERATIONS, TOLERANCE, EPSILON = 10.0, 200, 1e-9, 1e-9
#: Models of a bucket up to which its matrix is held by one task (two matrices of 8 MB).
DENSE_MODELS = 1000


def _estimate(pairs: pd.DataFrame, iterations: int, tolerance: float) -> pd.DataFrame:
    """Strengths of one bucket by minorisation-maximisation on the matrix of weighted wins."""
    names = sorted({*pairs["winner"], *pairs["loser"]})
    at = {m: i for i, m in enumerate(names)}
    won = np.zeros((len(names), len(names)))
    np.add.at(won, (pairs["winner"].map(at).to_numpy(), pairs["loser"].map(at).to_numpy()), pairs["weight"].to_numpy())
    met, wins = won + won.T, won.sum(axis=1)
    p = np.ones(len(names))
    for _ in range(iterations):
        need = (met / np.maximum(p[:, None] + p[None, :], EPSILON)).sum(axis=1)
        new = np.divide(wins, need, out=np.full(len(p), EPSILON), where=need > 0)
        new = np.maximum(new / new.mean(), EPSILON) if new.mean() > 0 else new
        moved, p = np.abs(new - p).max(), new
        if moved < tolerance:
            break
    field = (p.sum() - p) / max(len(p) - 1, 1) if len(p) > 1 else np.ones(1)
    return pd.DataFrame({"model": names, "strength": p, "wins": wins, "comparisons": met.sum(axis=1), "win_prob_vs_field": p / np.maximum(p + field, EPSILON)})


def bradley_terry(comparisons: DataFrame, bucket: list[str], least: float = MIN_COMPARISONS, dense_models: int = DENSE_MODELS, iterations: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """bucket, total, sufficient, model, strength, wins, comparisons, win_prob_vs_field.

    Comparisons are summed per (bucket, winner, loser) first, so later steps see
    one row per pair of models however many events there were. Buckets below
    ``least`` comparisons have one row without a model. A bucket of at most
    ``dense_models`` models is one group with a dense matrix; larger ones are
    estimated over the table of pairs, with the same steps and limits
    (``iterations`` at most, or until no strength moves by ``tolerance``).
    """
    pairs = written(comparisons.groupBy(*bucket, "winner", "loser").agg(F.sum("weight").alias("weight")), "pairs")
    sides = pairs.select(*bucket, F.col("winner").alias("model")).union(pairs.select(*bucket, "loser")).distinct()
    large = written(sides.groupBy(*bucket).agg(F.count("*").alias("_n")).where(F.col("_n") > dense_models).select(*bucket), "large")
    if large.isEmpty():
        return _dense(pairs, bucket, least, iterations, tolerance)
    same = _same(pairs, large, bucket)
    few = _dense(pairs.join(large, same, "left_anti"), bucket, least, iterations, tolerance)
    return few.unionByName(_sparse(pairs.join(large, same, "left_semi"), bucket, least, iterations, tolerance).select(*few.columns))


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def _dense(pairs: DataFrame, bucket: list[str], least: float, iterations: int, tolerance: float) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = "".join(f"{b} {kinds[b]}, " for b in bucket) + "total double, sufficient boolean, model string, strength double, wins double, comparisons double, win_prob_vs_field double"
    columns = [*bucket, "total", "sufficient", "model", "strength", "wins", "comparisons", "win_prob_vs_field"]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        total = group["weight"].sum()
        out = _estimate(group, iterations, tolerance) if total >= least else pd.DataFrame({"model": [None], "strength": [np.nan], "wins": [np.nan], "comparisons": [np.nan], "win_prob_vs_field": [np.nan]})
        for b in bucket:
            out[b] = group[b].iloc[0]
        out["total"], out["sufficient"] = total, total >= least
        return out[columns]

    return pairs.groupBy(*bucket).applyInPandas(one, schema)


def _sparse(pairs: DataFrame, bucket: list[str], least: float, iterations: int, tolerance: float) -> DataFrame:
    """The same over rows: a pair of models that met is a row in each direction, a strength is a row per bucket and model.

    A round is two joins and a sum per model, whose partial sums combine before
    the shuffle; strengths are written each round. Buckets that have settled
    leave the rounds.
    """
    key = F.struct(*bucket).alias("b")  # nulls of a bucket's columns compare as equal inside a struct's hash
    p0 = pairs.select(F.to_json(F.struct(*bucket), {"ignoreNullFields": "false"}).alias("k"), key, "winner", "loser", "weight")
    totals = written(p0.groupBy("k").agg(F.first("b").alias("b"), F.sum("weight").alias("total")), "totals")
    enough = totals.where(F.col("total") >= least)
    rows = p0.join(enough.select("k"), "k", "left_semi")
    met = rows.select("k", F.col("winner").alias("a"), F.col("loser").alias("c"), "weight", F.col("weight").alias("won"))
    met = met.unionByName(rows.select("k", F.col("loser").alias("a"), F.col("winner").alias("c"), "weight", F.lit(0.0).alias("won")))
    met = written(met.groupBy("k", "a", "c").agg(F.sum("weight").alias("met"), F.sum("won").alias("won")), "met")
    models = written(met.groupBy("k", "a").agg(F.sum("won").alias("wins"), F.sum("met").alias("comparisons")), "models")
    p, settled = models.select("k", "a", F.lit(1.0).alias("p")), None
    for _ in range(iterations):
        other = p.select("k", F.col("a").alias("c"), F.col("p").alias("q"))
        need = met.join(p, ["k", "a"]).join(other, ["k", "c"]).groupBy("k", "a").agg(F.sum(F.col("met") / F.greatest(F.col("p") + F.col("q"), F.lit(EPSILON))).alias("need"))
        raw = p.join(models, ["k", "a"]).join(need, ["k", "a"]).select("k", "a", "p", F.when(F.col("need") > 0, F.col("wins") / F.col("need")).otherwise(EPSILON).alias("raw"))
        mean = raw.groupBy("k").agg(F.avg("raw").alias("mean"))
        new = raw.join(mean, "k").select("k", "a", "p", F.when(F.col("mean") > 0, F.greatest(F.col("raw") / F.col("mean"), F.lit(EPSILON))).otherwise(F.col("raw")).alias("new"))
        moved = new.withColumn("moved", F.abs(F.col("new") - F.col("p")))
        step = written(moved, "strengths")
        open_ = step.groupBy("k").agg(F.max("moved").alias("moved")).where(F.col("moved") >= tolerance).select("k")
        open_ = written(open_, "open")
        values = step.select("k", "a", F.col("new").alias("p"))
        done = values.join(open_, "k", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        p = values.join(open_, "k", "left_semi")
        if open_.isEmpty():
            break
    found = written(settled.unionByName(p), "strengths")
    sums = found.groupBy("k").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    field = F.when(F.col("n") > 1, (F.col("s") - F.col("p")) / (F.col("n") - 1)).otherwise(1.0)
    out = found.join(models, ["k", "a"]).join(sums, "k").select("k", F.col("a").alias("model"), F.col("p").alias("strength"), "wins", "comparisons", (F.col("p") / F.greatest(F.col("p") + field, F.lit(EPSILON))).alias("win_prob_vs_field"))
    return totals.join(out, "k", "left").select("b.*", "total", (F.col("total") >= least).alias("sufficient"), "model", "strength", "wins", "comparisons", "win_prob_vs_field")


def prior_scores(strengths: DataFrame, bucket: list[str], cap: float = 0.15) -> DataFrame:
    """Nudges for models that beat the field: P - 0.5, between 0 and the cap."""
    nudge = F.round(F.least(F.greatest(F.col("win_prob_vs_field") - 0.5, F.lit(0.0)), F.lit(cap)), 4)
    return strengths.where("sufficient").select(*bucket, F.col("model"), nudge.alias("prior_score")).where("prior_score > 0")
