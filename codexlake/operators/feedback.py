"""Votes, preference events, overrides and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codexlake.functions import rules as R
from codexlake.sources.scratch import written


def latest(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key. Each map task keeps one row a key before anything is shuffled."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def tally(votes: DataFrame, key: list[str], candidate: str = "candidate") -> DataFrame:
    return votes.groupBy(*key, candidate).agg(F.count("*").alias("votes"))


def winners(counts: DataFrame, key: list[str], candidate: str = "candidate", min_votes: int = 1) -> DataFrame:
    """key, cast_votes, winner, winner_votes; no winner below the quorum or when the lead is shared."""
    top = F.struct(F.col("votes").alias("v"), F.col(candidate).alias("c"))
    g = counts.groupBy(*key).agg(F.sum("votes").alias("cast_votes"), F.max(top).alias("hi"), F.max_by("votes", "votes").alias("lead"), F.collect_list("votes").alias("all"))
    single = F.size(F.filter("all", lambda v: v == F.col("lead"))) == 1
    decided = (F.col("cast_votes") >= max(1, min_votes)) & single
    return g.select(*key, "cast_votes", F.when(decided, F.col("hi.c")).alias("winner"), F.when(decided, F.col("hi.v")).alias("winner_votes"))


def override_rates(log: DataFrame, field: str = "field", inferred: str = "inferred_value", chosen: str = "chosen_value") -> DataFrame:
    rows = log.where(F.col(field).isNotNull() & (F.col(field) != "path_preference"))
    changed = F.count_if(~F.col(chosen).eqNullSafe(F.col(inferred)))
    return rows.groupBy(field).agg(F.count("*").alias("total"), changed.alias("overrides"), (changed / F.count("*")).alias("override_rate"))


def model_winrates(log: DataFrame, bucket: list[str], model: str, chosen: str, decided_by: str) -> DataFrame:
    """Wins per bucket and model: a person decided, or the choice kept the model."""
    rows = log
    for c in [*bucket, model]:
        rows = rows.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    wins = F.count_if((F.col(decided_by) == "human") | F.col(chosen).eqNullSafe(F.col(model)))
    return rows.groupBy(*bucket, model).agg(wins.alias("wins"), F.count("*").alias("total"), (wins / F.count("*")).alias("win_rate"))


def path_preferences(log: DataFrame, chosen: str = "chosen_value", path: str = "path") -> DataFrame:
    name = F.coalesce(F.nullif(F.col(chosen), F.lit("")), F.col(path)).alias("path")
    return log.where(F.col("field") == "path_preference").select(name).where("path <> ''").groupBy("path").agg(F.count("*").alias("n"))


def grouped_rates(rows: DataFrame, hit: Column, sets: dict[str, list[str]], total: str, hits: str) -> DataFrame:
    """Counts and rate at several grouping levels in one pass: level, the grouping columns (null where not grouped), total, hits, rate."""
    columns = list(dict.fromkeys(c for s in sets.values() for c in s))
    marked = rows.withColumn("_hit", hit.cast("long"))
    grouped = marked.groupingSets(list(sets.values()), *columns).agg(F.grouping_id().alias("_g"), F.count("*").alias(total), F.sum("_hit").alias(hits))
    level = F.when(F.lit(False), "")
    for name, s in sets.items():
        mask = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        level = level.when(F.col("_g") == mask, name)
    return grouped.select(level.alias("level"), *columns, total, hits, F.try_divide(F.col(hits).cast("double"), F.col(total)).alias("rate"))


def selection_agreement(events: DataFrame, sets: dict[str, list[str]], auto: str = "auto_pick", chosen: str = "chosen") -> DataFrame:
    """How often the automatic pick is among the chosen ones; rejections and events without a pick don't count."""
    rows = events.where((F.size(chosen) > 0) & (F.coalesce(F.col(auto), F.lit("")) != ""))
    return grouped_rates(rows, F.array_contains(chosen, F.col(auto)), sets, "decided", "agreed")


def coverage(events: DataFrame, sets: dict[str, list[str]], chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Share of decided pages with an acceptable reading; undecided pages are left out."""
    accepted = (F.size(chosen) > 0) & ~F.col(rejected)
    return grouped_rates(events.where(accepted | F.col(rejected)), accepted, sets, "decided", "accepted")


def ranks(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``rows`` with r, the rank from 0 of the value in its group, and n, the group's size.

    The rows are range-partitioned by group, value and a row number, so that a
    large group, even one of equal values, spreads over many tasks; a rank is
    the rows of the group in earlier partitions plus the rank in the own one.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = written(tie.repartitionByRange(*by, value, "_tie").withColumn("_part", F.spark_partition_id()), "ranks")
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy("_part")  # as many rows as partitions hold the group
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("n", F.sum("_c").over(Window.partitionBy(*by))).drop("_c")
    inside = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(value, "_tie")) - 1)
    return inside.join(before, [*by, "_part"]).withColumn("r", F.col("_before") + F.col("_r")).drop("_part", "_before", "_r", "_tie")


def regret(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distribution of the distances: measured, unmeasurable (null), median, p90 by nearest rank, max."""
    numbered = ranks(rows.where(F.col(value).isNotNull()).select(*by, value), value, by)
    p90 = F.least(F.col("n") - 1, F.bround(0.9 * (F.col("n") - 1)).cast("long"))
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    at = lambda k: F.max(F.when(F.col("r") == k, F.col(value)))
    found = numbered.groupBy(*by).agg(F.max("n").alias("measured"), ((at(lo) + at(hi)) / 2).alias("median_regret"), at(p90).alias("p90_regret"), F.max(value).alias("max_regret"))
    missing = rows.groupBy(*by).agg(F.count_if(F.col(value).isNull()).alias("unmeasurable"))
    return missing.join(found, by, "left").select(*by, F.coalesce("measured", F.lit(0)).alias("measured"), "unmeasurable", "median_regret", "p90_regret", "max_regret")


def text_regret(events: DataFrame, texts: DataFrame, key: list[str], kept: DataFrame | None = None) -> DataFrame:
    """key, regret: distance of the automatic pick's text from the text that the person kept, null if either is gone.

    ``events`` (key, auto_pick, chosen) are selections; those without a choice
    or a pick, and those that chose the pick, have no regret. ``texts`` (key,
    candidate, text) are the candidates, ``kept`` (key, text) confirmed texts;
    without one the text of a single choice counts. Feeds regret().
    """
    from codexlake.operators.metrics import RAW, cer

    differ = events.where((F.size("chosen") > 0) & F.col("auto_pick").isNotNull() & (F.col("auto_pick") != "") & ~F.array_contains("chosen", F.col("auto_pick")))
    only = F.when(F.size("chosen") == 1, F.get("chosen", F.lit(0)))
    text = lambda side, name: texts.select(*key, F.col("candidate").alias(side), F.col("text").alias(name))
    j = differ.withColumn("_only", only).join(text("auto_pick", "_auto"), [*key, "auto_pick"], "left").join(text("_only", "_single"), [*key, "_only"], "left")
    if kept is not None:
        j = j.join(kept.select(*key, F.nullif(F.col("text"), F.lit("")).alias("_kept")), key, "left").withColumn("_single", F.coalesce("_kept", "_single"))
    there = (F.trim(F.coalesce("_auto", F.lit(""))) != "") & (F.trim(F.coalesce("_single", F.lit(""))) != "")
    rest = [c for c in events.columns if c not in (*key, "auto_pick", "chosen")]
    return j.select(*key, *rest, F.when(there, cer(F.col("_auto"), F.col("_single"), **RAW)).alias("regret"))


def routing_prior(log: DataFrame, bucket: list[str], model: str, least: int = 10, cap: float = 0.15) -> DataFrame:
    """Per bucket of ``least`` rows or more: models whose share exceeds one half, and their nudge."""
    rows = log.dropna(subset=[*bucket, model])
    counts = rows.groupBy(*bucket, model).agg(F.count("*").alias("wins"))
    share = F.col("wins") / F.col("total")
    totals = counts.groupBy(*bucket).agg(F.sum("wins").alias("total")).where(F.col("total") >= least)
    nudge = F.least(share - 0.5, F.lit(cap))
    return counts.join(totals, bucket).withColumn("prior_score", F.round(nudge, 4)).where(nudge > 0)


def combine_priors(models: DataFrame, preferred: DataFrame, legacy: DataFrame, key: list[str]) -> DataFrame:
    """Each model's prior: from preferences, else the older win shares, else 0."""
    p = preferred.select(*key, F.col("prior_score").alias("_p"))
    q = legacy.select(*key, F.col("prior_score").alias("_q"))
    return models.join(p, key, "left").join(q, key, "left").withColumn("prior", F.coalesce("_p", "_q", F.lit(0.0))).drop("_p", "_q")


def offered_key(x: Column) -> Column:
    """engine/model of an offered entry."""
    model = F.coalesce(x["model_id"], F.lit(""))
    return F.when(model != "", F.concat_ws("/", x["engine"], model)).otherwise(x["engine"])


def comparisons(events: DataFrame, bucket: list[str], combine_weight: float = 0.5) -> DataFrame:
    """bucket, winner, loser, weight: each chosen reading beats each offered one that was not chosen. Rejections say nothing."""
    keys = F.transform("offered", offered_key)
    pairs = events.where(~F.coalesce(F.col("rejected"), F.lit(False)) & (F.size("chosen") > 0))
    pairs = pairs.withColumn("loser", F.explode(F.array_except(keys, F.col("chosen")))).withColumn("winner", F.explode("chosen"))
    weight = F.when(F.col("combined"), combine_weight).otherwise(1.0)
    return pairs.where("winner <> loser").select(*bucket, "winner", "loser", weight.alias("weight"))


def record_selection(choices: DataFrame, offered: DataFrame, context: DataFrame, rejected: bool = False) -> DataFrame:
    """Preference events from clicks: one per page touched (all pages of the document for a rejection).

    choices (doc_id, label, voter, ts), offered (doc_id, label, auto_rank),
    context (doc_id, script, century, lang in order of precedence). Labels that
    were not offered are dropped, as are rows without doc_id.
    """
    o = offered.where("doc_id IS NOT NULL").withColumn("page", R.page_of(F.col("label")))
    pages = o.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("auto_rank", R.engine_model_of(F.col("label")).alias("key")))).alias("offered"))
    if rejected:
        picked = choices.select("doc_id", "voter", "ts").join(pages.select("doc_id", "page"), "doc_id").withColumn("chosen", F.array().cast("array<string>"))
    else:
        valid = choices.join(o.select("doc_id", "label", "page"), ["doc_id", "label"])
        picked = valid.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set(R.engine_model_of(F.col("label")))).alias("chosen"), F.max("voter").alias("voter"), F.max("ts").alias("ts"))
    joined = picked.join(pages, ["doc_id", "page"]).join(context, "doc_id", "left")
    return joined.withColumn("rejected", F.lit(rejected)).withColumn("combined", F.size("chosen") > 1).withColumn("auto_pick", F.get("offered", F.lit(0))["key"])


def pin_overrides(values: DataFrame, overrides: DataFrame, key: list[str], order: str) -> DataFrame:
    """Human values over inferred ones; the last override of a field wins."""
    last = overrides.groupBy(*key).agg(F.max_by("value", order).alias("_pin"))
    return values.join(last, key, "left").withColumn("value", F.coalesce("_pin", "value")).drop("_pin")
