"""Rule-based ranking of recognition models against document criteria, gates and rank windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codexlake.functions import rules as R, text as T
from codexlake.sources.parallel import spread
from codexlake.sources.scratch import written

SCRIPT_EXACT, SCRIPT_FUZZY, SCRIPT_MISMATCH = 0.6, 0.3, -0.35
SCORE_BLOCK, TOP2_GAP = 0.4, 0.15


def _within(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def model_score(script: Column, lang: Column, century: Column, doc_type: Column, m_script: Column, m_lang: Column, m_centuries: Column, m_notes: Column, m_id: Column) -> Column:
    """Score in 0..1. Scripts and languages come normalised; null or empty criteria don't count."""
    some = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    notes, wanted = F.lower(F.coalesce(m_notes, F.lit(""))), F.lower(F.coalesce(doc_type, F.lit("")))
    script_part = F.when(some(script) & some(m_script), F.when(script == m_script, SCRIPT_EXACT).when(_within(script, m_script), SCRIPT_FUZZY).otherwise(SCRIPT_MISMATCH)).otherwise(0.0)
    lang_part = F.when(some(lang) & some(m_lang), F.when(lang == m_lang, 0.3).when(_within(lang, m_lang), 0.15).otherwise(0.0)).otherwise(0.0)
    known = (F.coalesce(century, F.lit(0)) != 0) & (F.size(m_centuries) > 0)
    century_part = F.when(known, F.when(R.centuries_overlap(century, m_centuries), 0.2).when(R.centuries_overlap(century, m_centuries, 2), 0.1).otherwise(0.0)).otherwise(0.0)
    book = F.contains(wanted, F.lit("book")) & F.contains(notes, F.lit("catmus")) & F.contains(m_id, F.lit("catmus"))
    register = wanted.rlike("register|charter|ledger|urbar") & F.contains(notes, F.lit("register"))
    raw = script_part + lang_part + century_part + F.when(book, 0.1).otherwise(0.0) + F.when(register, 0.1).otherwise(0.0)
    raw = F.when((raw == 0.0) & notes.rlike("medieval|middle ages"), 0.05).otherwise(raw)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def line_model_score(lang: Column, century: Column, m_lang: Column, m_task: Column, m_name: Column, m_notes: Column) -> Column:
    """Score of line-level models: language, task, century named in the notes."""
    about = F.lower(F.concat_ws(" ", m_name, m_notes))
    named = F.contains(about, century.cast("string")) | F.contains(about, F.concat(F.lit("xvi"), R.roman(century)))
    lang_part = F.when(F.lower(lang) == F.lower(m_lang), 0.6).when((F.coalesce(lang, F.lit("")) != "") & (m_lang == "mul"), 0.3).otherwise(0.0)
    return lang_part + F.when(m_task.isin("line-ocr", "htr"), 0.2).otherwise(0.0) + F.when(named, 0.2).otherwise(0.0)


def _with_all(criteria: DataFrame, facets: list[str], registry: DataFrame) -> DataFrame:
    """Each distinct combination of the facets with each model; written first, so that its size is known and the smaller side is sent to the other."""
    return spread(registry).crossJoin(written(criteria.select(*facets).distinct(), "criteria"))


def rank_models(criteria: DataFrame, models: DataFrame, key: list[str], top_k: int = 3, require_above: float = 0.0, priors: DataFrame | None = None) -> DataFrame:
    """The ``top_k`` models per row of criteria, best first, ties in registry order.

    criteria: key, script, lang, century, document_type. models (a registry of
    any size): model_id, script, lang, centuries, notes, ordinal. Scores are
    worked out once per distinct combination of criteria, however many
    documents share it, and a task keeps ``top_k`` models for each.
    """
    c = criteria.select(*key, R.normalise_script(F.col("script")).alias("script"), R.normalise_lang(F.col("lang")).alias("lang"), F.col("century").cast("int").alias("century"), F.col("document_type"))
    facets = ["script", "lang", "century", "document_type"]
    registry = models.select("model_id", "ordinal", R.normalise_script(F.col("script")).alias("m_script"), F.col("lang").alias("m_lang"), "centuries", "notes")
    pairs = _with_all(c, facets, registry)
    score = model_score(*map(F.col, facets), F.col("m_script"), F.col("m_lang"), F.col("centuries"), F.col("notes"), F.col("model_id"))
    scored = pairs.withColumn("score", F.round(score, 9)).where(F.col("score") >= require_above)  # binary fractions must not decide ties
    if priors is not None:
        scored = scored.join(priors.select("model_id", "prior"), "model_id", "left").withColumn("score", F.col("score") + F.coalesce("prior", F.lit(0.0))).drop("prior")
    w = Window.partitionBy(*facets).orderBy(F.desc("score"), "ordinal")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select(*facets, "rank", "model_id", "score")
    same = [F.col(f"c.{f}").eqNullSafe(F.col(f"b.{f}")) for f in facets]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return c.alias("c").join(best.alias("b"), on).select(*[f"c.{k}" for k in key], "b.rank", "b.model_id", "b.score")


def rank_line_models(criteria: DataFrame, models: DataFrame, key: list[str], top_k: int = 3, require_above: float = 0.0) -> DataFrame:
    """The same for line-level models (model_id, lang, task, name, notes, ordinal): those for lines, by language and century."""
    c = criteria.select(*key, R.normalise_lang(F.col("lang")).alias("lang"), F.col("century").cast("int").alias("century"))
    lines = models.where(F.col("task").isin("line-ocr", "htr")).select("model_id", "ordinal", F.col("lang").alias("m_lang"), "task", "name", F.coalesce("notes", F.lit("")).alias("notes"))
    pairs = _with_all(c, ["lang", "century"], lines)
    score = F.round(line_model_score(*map(F.col, ("lang", "century", "m_lang", "task", "name", "notes"))), 9)
    w = Window.partitionBy("lang", "century").orderBy(F.desc("score"), "ordinal")
    best = pairs.withColumn("score", score).where(F.col("score") >= require_above).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    b = best.select("lang", "century", "rank", "model_id", "score").alias("b")
    on = F.col("c.lang").eqNullSafe(F.col("b.lang")) & F.col("c.century").eqNullSafe(F.col("b.century"))
    return c.alias("c").join(b, on).select(*[f"c.{k}" for k in key], "b.rank", "b.model_id", "b.score")


#: How many models a request to an engine gets.
TOP_K = {"kraken": 3, "trocr": 3, "party": 1}


def select_best(requests: DataFrame, key: list[str], models: DataFrame, line_models: DataFrame, party: str, top_k: dict[str, int] = TOP_K, require_above: float = 0.0) -> DataFrame:
    """key, rank, model_id, score of the models for each request (key, engine, script, lang, century, document_type).

    ``kraken`` takes from the page models, ``trocr`` from the line models,
    ``party`` the first page model whose id holds that number; other engines
    have no models.
    """
    single = models.where(F.contains("model_id", F.lit(party))).orderBy("ordinal").limit(1)
    of = lambda engine: requests.where(F.col("engine") == engine)
    out = rank_models(of("kraken"), models, key, top_k["kraken"], require_above)
    out = out.unionByName(rank_models(of("party"), single, key, top_k["party"], require_above))
    return out.unionByName(rank_line_models(of("trocr"), line_models, key, top_k["trocr"], require_above))


def eligible_pairs(pages: DataFrame, key: list[str], readings: str, picks: str) -> DataFrame:
    """key, pos, reading, pick: readings (array of structs with text and error) with the pick at the same place, as far as both go; blank and failed ones are left out."""
    n = F.least(F.size(readings), F.size(picks))
    zipped = F.slice(F.arrays_zip(F.col(readings).alias("reading"), F.col(picks).alias("pick")), 1, n)
    rows = pages.where(n > 0).select(*key, F.posexplode(zipped).alias("pos", "z")).select(*key, "pos", "z.reading", "z.pick")
    return rows.where((T.collapse(F.coalesce(F.col("reading.text"), F.lit(""))) != "") & (F.coalesce(F.col("reading.error"), F.lit("")) == ""))


def top2_gap(ranked: DataFrame, key: list[str]) -> DataFrame:
    """key, top, gap: the best score and its lead (1 if nothing follows)."""
    w = Window.partitionBy(*key).orderBy("rank")
    gap = ranked.withColumn("next", F.lead("score").over(w)).where(F.col("rank") == 1)
    return gap.select(*key, F.col("score").alias("top"), F.coalesce(F.col("score") - F.col("next"), F.lit(1.0)).alias("gap"))


def assess_routing(gaps: DataFrame, uncertain: Column) -> DataFrame:
    """block, decided_by and reason of the first rule that applies: marked uncertain, score too low, lead too small."""
    reason = F.when(uncertain, "marked uncertain").when(F.col("top") < SCORE_BLOCK, "score too low").when(F.col("gap") < TOP2_GAP, "lead too small")
    out = gaps.withColumn("reason", reason)
    return out.withColumn("block", F.col("reason").isNotNull()).withColumn("decided_by", F.when(F.col("block"), "human").otherwise("model"))


def expired(posted: Column, now: Column, minutes: int = 30) -> Column:
    """Whether a gate posted at an ISO time (UTC if it names no zone) has run out; false for bad times."""
    return F.coalesce(F.try_to_timestamp(posted) + F.make_dt_interval(mins=F.lit(minutes)) < now, F.lit(False))


def plan_engines(models: DataFrame, key: list[str], engine: str, rank: str) -> DataFrame:
    """Order in which to run engines: the general one, the best of each line engine, then the second of each in turn, and so on."""
    nth = F.row_number().over(Window.partitionBy(*key, engine).orderBy(rank))
    front = F.when(F.col(engine) == "vlm", 0).otherwise(F.col("nth"))
    w = Window.partitionBy(*key).orderBy("front", engine, rank)
    return models.withColumn("nth", nth).withColumn("front", front).withColumn("step", F.row_number().over(w)).drop("front", "nth")


def rank_candidates(readings: DataFrame, key: list[str], implausible: Column, match: Column, confidence: Column, order: str) -> DataFrame:
    """Readings by plausibility, then match, then confidence; the general engine's match counts 0."""
    own = F.when(F.col("engine") == "vlm", 0.0).otherwise(match)
    w = Window.partitionBy(*key).orderBy(F.asc("_bad"), F.desc("_match"), F.desc("_conf"), order)
    out = readings.withColumn("_bad", implausible.cast("int")).withColumn("_match", own).withColumn("_conf", confidence)
    return out.withColumn("auto_rank", F.row_number().over(w)).drop("_bad", "_match", "_conf")


def resolve_model_ids(picks: DataFrame, registry: DataFrame, pick: str = "model_id") -> DataFrame:
    """Gateway ids of picks by id, repository or archive number; the first registry row wins, a pick without one keeps its own id."""
    keys = registry.select(F.explode(F.array_compact(F.array("gateway_id", "hf_repo", "zenodo_id"))).alias("k"), "gateway_id", "ordinal")
    first = keys.groupBy("k").agg(F.min_by("gateway_id", "ordinal").alias("gateway_id"))
    return picks.join(first, picks[pick] == first["k"], "left").withColumn("gateway_id", F.coalesce("gateway_id", pick)).drop("k")


def worst_buckets(rates: DataFrame, n: int = 3) -> DataFrame:
    return rates.where("rate IS NOT NULL").orderBy("rate", *[c for c in rates.columns if c != "rate"]).limit(n)
