"""Operators of the library on the driver's tables.

The tables stand in for the project's own records: events for votes and
feedback, conversations for pages with several readings, parts for entity and
person records, documents and labels for documents and their scope.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codexlake.functions import json_text as J, rules as R, text as T
from codexlake.operators import corpus, entities, feedback, fusion, graph, hub, metrics, paths, resolve, selection, similar, strengths, vectors
from codexlake.operators.components import connected_components
from codexlake.plans import incremental, jobs
from codexlake.sources.parallel import spread_small
from codexlake.sources.scratch import new_path, written
from codexlake.streaming import state
from codexlake.streaming.tables import StateTable, merging

SALT = "stand-in salt"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df) if name == "documents" else df  # long texts in few files


def ascii_text(c: Column) -> Column:
    """Lower-case a-z words with single blanks, on which all engines' edit distances agree."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]", ""), " +", " "))


# corpus


def corpus_term_stats(spark, d):
    return corpus.corpus_stats(table(spark, d, "documents"))


def corpus_top_terms(spark, d):
    return corpus.top_terms(table(spark, d, "documents"))


def doc_quality_flags(spark, d):
    return corpus.quality_flags(table(spark, d, "documents"))


def doc_chunks(spark, d):
    return corpus.explode_chunks(table(spark, d, "documents"), 500, 50)


def search_index(spark, d):
    return corpus.search_index(table(spark, d, "documents"), lang=F.col("lang"), source=F.col("source"))


def catalogue_search(spark, d):
    return corpus.catalogue_search(search_index(spark, d), "The src1 EN", ["lang", "source", "snippet"]).select("doc_id", "source")


def search_entities(spark, d):
    """A document per eight parts, its entities the parts' types (one in three normalised), in order of their keys."""
    e = F.struct(F.col("p_partkey").alias("o"), F.concat(F.lit(" "), F.lower("p_type")).alias("text"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("normalised"))
    docs = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 8).alias("doc_id")).agg(F.array_sort(F.collect_list(e)).alias("entities"))
    return docs.select("doc_id", F.array_join(corpus.entity_names(F.col("entities")), ";").alias("entities"))


def search_records(spark, d):
    """Every document with a description of its language and date, a third of them wrapped, a third without one."""
    doc = table(spark, d, "documents")
    wert = F.concat(F.lit('{"Sprache": {"wert": "'), "lang", F.lit('"}, "Datierung": "'), (F.col("doc_id") % 700 + 1200).cast("string"), F.lit('"}'))
    plain = F.concat(F.lit('{"Sprache": "'), "lang", F.lit('", "Schrift": null}'))
    description = F.when(F.col("doc_id") % 3 == 0, F.parse_json(wert)).when(F.col("doc_id") % 3 == 1, F.parse_json(plain))
    e = F.array(F.struct(F.col("source").alias("text"), F.lit("").alias("normalised")), F.struct(F.lit("x").alias("text"), F.col("source").alias("normalised")))
    ascii_ = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z .,]", "")
    found = corpus.search_records(doc.select("doc_id", description.alias("description"), ascii_.alias("transcription"), e.alias("entities")))
    return found.withColumn("entities", F.array_join("entities", ";"))


def storage_overview(spark, d):
    return corpus.storage_overview(table(spark, d, "documents"), F.col("source"), F.length("text"))


def run_totals(spark, d):
    e = table(spark, d, "events").select("event_type", F.length("props").alias("tokens"), F.col("user_id").alias("seconds"), F.when(F.col("event_type") == "error", "x").alias("err"))
    return corpus.run_totals(e, "event_type", "seconds", "tokens", "err")


def text_functions(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.index_name(F.col("p_name")).alias("norm"), T.person_name(F.col("p_type")).alias("person_norm"), T.normalise_tokens(F.concat_ws(",  ", "p_name", "p_brand")).alias("tokens"))


def language_scripts(spark, d):
    doc = table(spark, d, "documents").withColumn("stated", F.concat(F.lit("Sprache: "), F.when(F.col("lang") == "de", "Mittelhochdeutsch").when(F.col("lang") == "fr", "Altfranzösisch").when(F.col("lang") == "es", "spanisch").otherwise("unknown")))
    return doc.select("doc_id", R.normalise_lang(F.col("stated")).alias("code"), T.script_implausible(F.coalesce("text", F.lit("")), F.col("lang")).alias("implausible"))


def years_and_centuries(spark, d):
    o = table(spark, d, "orders").withColumn("span", F.concat_ws(" - ", F.year("o_orderdate"), F.year("o_orderdate") + (F.col("o_custkey") % 400).cast("int")))
    return o.select("o_orderkey", R.parse_years(F.col("span"))["lo"].alias("lo"), R.parse_years(F.col("span"))["hi"].alias("hi"), R.parse_century(F.col("span")).cast("int").alias("century"))


def spelled_centuries(spark, d):
    doc = table(spark, d, "documents")
    n, form = F.col("doc_id") % 14 + 9, F.element_at(F.array(*map(F.lit, (". Jh.", ". JAHRHUNDERT", ". Jahrhunderts", " Jh"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(n.cast("string"), form, F.when(F.col("doc_id") % 9 == 0, " (Mittelalter)").otherwise(""))
    return doc.select("doc_id", R.parse_century(text).alias("century"))


def described_criteria(spark, d):
    """Criteria from descriptions: prose for all documents, structured ones for two thirds, half of these with the date only."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    lang = F.when(F.col("lang") == "de", "Mittelhochdeutsch").when(F.col("lang") == "fr", "Altfranzösisch").otherwise("einer Sprache")
    fifth, text = F.col("doc_id") % 5, lambda c: c.cast("string")
    date = F.when(fifth == 0, F.concat(F.lit(", "), text(F.col("doc_id") % 11 + 10), F.lit(". Jahrhundert"))).when(fifth == 1, ", 1250 - 1399").when(fifth == 2, F.concat(F.lit(", um 1"), text(F.col("doc_id") % 90 + 10), F.lit("7"))).otherwise("")
    prose = F.concat(F.lit("Eine "), pick(("Urkunde", "Chronik", "Karte", "Handschrift")), F.lit(" in "), lang, F.lit(", "), pick(("kursive", "bastarda", "Schrift")), date)
    full = F.col("doc_id") % 3 == 0
    wert = lambda c: F.struct(c.alias("wert"), F.lit(False).alias("unsicher"))
    structured = F.to_json(F.struct(F.when(full, wert(F.lit("gotische textura"))).alias("Schrift"), F.when(full, wert(F.lit("Latein"))).alias("Sprache"), wert(F.concat(text(F.col("doc_id") % 7 + 12), F.lit(". Jh."))).alias("Datierung")))
    description = F.when(F.col("doc_id") % 3 < 2, F.parse_json(structured))
    return table(spark, d, "documents").select("doc_id", J.criteria_with_prose(description, prose).alias("c")).select("doc_id", "c.*")


def tolerant_json(spark, d):
    """Event properties as a model would write them: fenced, in prose, with a trailing comma."""
    e = table(spark, d, "events")
    open_ = F.regexp_replace("props", r"\\}$", ",}")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), open_, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), open_, F.lit(" as asked"))).otherwise(F.col("props"))
    return e.select("event_id", F.try_variant_get(J.tolerant(text), "$.k", "bigint").alias("k"), F.size(J.salvage(text)).alias("objects"))


# metrics


def _readings(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", ascii_text(F.col("text")).alias("text"))


def pairwise_cer(spark, d):
    return metrics.pairwise_cer(_readings(spark, d), ["conv_id"], "turn")


def max_pairwise_cer(spark, d):
    return metrics.max_cer(pairwise_cer(spark, d), ["conv_id"])


def max_symmetric_cer(spark, d):
    return metrics.max_cer_symmetric(_readings(spark, d), ["conv_id"], "turn")


def gate_blocked(spark, d):
    return metrics.gate_readings(_readings(spark, d), ["conv_id"], "turn", threshold=0.8)


def _cer_rows(spark, d):
    r = _readings(spark, d).withColumn("engine", F.concat(F.lit("engine"), "turn"))
    reference = r.where("turn = 0").select("conv_id", F.col("text").alias("reference"))
    return metrics.cer_table(r.where("turn > 0"), reference, ["conv_id"], "engine", "turn")


def cer_best_engine(spark, d):
    return metrics.best_engine(_cer_rows(spark, d), ["conv_id"])


def cer_engine_means(spark, d):
    return metrics.engine_means(_cer_rows(spark, d), ["conv_id"]).select("engine", F.round("mean_cer", 6).alias("mean_cer"))


def page_quality(spark, d):
    return metrics.page_quality(_cer_rows(spark, d), ["conv_id"]).select("conv_id", F.round("qa_score", 9).alias("qa_score"))


def token_offsets(spark, d):
    tokens = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", "[ \\n]+"), lambda x: x != "")).alias("pos", "token"))
    return metrics.char_offsets(tokens, ["conv_id", "turn"], "pos", "token")


def edit_distances(spark, d):
    """Edits between each turn and the first one."""
    r = _readings(spark, d)
    first = r.where("turn = 0").select("conv_id", F.col("text").alias("reference"))
    return r.join(first, "conv_id").select("conv_id", "turn", metrics.edit_distance(F.col("reference"), F.col("text")).alias("edits"))


def word_error_rates(spark, d):
    """Of each turn against the first one."""
    r = _readings(spark, d)
    first = r.where("turn = 0").select("conv_id", F.col("text").alias("reference"))
    return spread_small(r.join(first, "conv_id")).select("conv_id", "turn", F.round(metrics.wer(F.col("reference"), F.col("text")), 9).alias("wer"))


# feedback


def _votes(spark, d):
    e = table(spark, d, "events")
    return e.select(F.get_json_object("props", "$.k").alias("doc"), F.col("user_id").alias("voter"), F.col("event_type").alias("candidate"), F.col("event_id").alias("ord"))


def votes_latest(spark, d):
    return feedback.latest(_votes(spark, d), ["doc", "voter"], "ord")


def votes_tally(spark, d):
    return feedback.tally(votes_latest(spark, d), ["doc"])


def votes_winner(spark, d):
    return feedback.winners(votes_tally(spark, d), ["doc"], min_votes=3)


def _overrides(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").withColumn("inferred_value", before).withColumn("chosen_value", F.col("event_type")).withColumn("field", F.concat(F.lit("field"), F.col("event_id") % 4))


def override_rates(spark, d):
    return feedback.override_rates(_overrides(spark, d))


def _selections(spark, d):
    e = _overrides(spark, d)
    chosen = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).when(F.col("value") > 50, F.array("event_type", F.lit("view"))).otherwise(F.array("event_type"))
    return e.select("event_id", F.col("inferred_value").alias("auto_pick"), chosen.alias("chosen"), (F.col("event_type") == "error").alias("rejected"), F.col("event_type").alias("bucket"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("inferred_value").alias("engine"))


def selection_agreement(spark, d):
    return feedback.selection_agreement(_selections(spark, d), {"overall": [], "bucket": ["bucket"], "engine": ["engine"]})


def coverage_rollup(spark, d):
    return feedback.coverage(_selections(spark, d), {"overall": [], "day": ["day"], "engine": ["engine"]})


def regret_percentiles(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 10 > 0, F.col("value")).alias("value"))
    return feedback.regret(e, "value", ["event_type"])


def text_regret(spark, d):
    """The automatic pick is the first turn, the person's the longest text."""
    c = table(spark, d, "conversations")
    best = c.groupBy("conv_id").agg(F.max_by("turn", F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col("turn"))).alias("best"))
    events = best.select("conv_id", (F.col("conv_id") % 3).alias("bucket"), F.lit("turn/0").alias("auto_pick"), F.array(F.concat(F.lit("turn/"), "best")).alias("chosen"))
    texts = _readings(spark, d).select("conv_id", F.concat(F.lit("turn/"), "turn").alias("candidate"), "text")
    return feedback.regret(feedback.text_regret(events, texts, ["conv_id"]), "regret", ["bucket"])


def fusion_gain(spark, d):
    """The fused text is the last turn's."""
    r = _readings(spark, d)
    last = r.groupBy("conv_id").agg(F.max_by("text", "turn").alias("fused"))
    fused = last.join(r.where("turn = 0").select("conv_id", F.col("text").alias("reference")), "conv_id")
    return metrics.fusion_gain(_cer_rows(spark, d), fused, ["conv_id"]).select("conv_id", F.round("best_cer", 9).alias("best_cer"), F.round("fused_cer", 9).alias("fused_cer"), "fusion_beats_best")


def _judged(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")


def routing_prior(spark, d):
    return feedback.routing_prior(_judged(spark, d).withColumn("model", F.concat(F.lit("q"), "quality")), ["lang"], "model")


def model_winrates(spark, d):
    rows = _judged(spark, d).select("lang", F.concat(F.lit("m"), "quality").alias("model"), F.concat(F.lit("m"), "toxic").alias("chosen"), F.when(F.col("doc_id") % 3 == 0, "human").otherwise("auto").alias("by"))
    return feedback.model_winrates(rows, ["lang"], "model", "chosen", "by")


def path_preferences(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, "path_preference").otherwise("lang").alias("field"), F.when(F.col("value") > 30, F.col("event_type")).otherwise("").alias("chosen_value"), F.lit("vlm").alias("path"))
    return feedback.path_preferences(rows)


def _preference_events(spark, d):
    """Per conversation the engines offered are its turns; the choice is the turn of the longest text."""
    offered = F.array_sort(F.collect_list(F.struct("turn", F.lit("turn").alias("engine"), F.col("turn").cast("string").alias("model_id"))))
    best = F.max_by(F.concat(F.lit("turn/"), "turn"), F.struct(F.length("text"), -F.col("turn")))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(offered.alias("offered"), best.alias("best"), F.count("*").alias("n"))
    return g.select("conv_id", "offered", F.array("best").alias("chosen"), (F.col("n") > 4).alias("combined"), (F.col("conv_id") % 7 == 0).alias("rejected"), (F.col("conv_id") % 2).alias("bucket"))


def preference_pairs(spark, d):
    return feedback.comparisons(_preference_events(spark, d), ["conv_id", "bucket"])


def _strengths(spark, d):
    return strengths.bradley_terry(feedback.comparisons(_preference_events(spark, d), ["bucket"]), ["bucket"])


def bradley_terry(spark, d):
    return _strengths(spark, d).select("bucket", "total", "sufficient", "model", *[F.round(c, 6).alias(c) for c in ("strength", "wins", "comparisons", "win_prob_vs_field")])


def strength_priors(spark, d):
    return strengths.prior_scores(_strengths(spark, d), ["bucket"])


def pseudonymise(spark, d):
    return table(spark, d, "events").select("event_id", R.pseudonym(F.col("user_id"), SALT).alias("voter"))


# selection


def _models(spark, d):
    """A model for each kind of part."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"), F.max("p_size").alias("p_size"))
    script = F.element_at(F.array(*map(F.lit, ("textura", "fraktur", "kurrent", "bastarda", "kursive"))), (F.col("p_size") % 5 + 1).cast("int"))
    lang = F.element_at(F.array(*map(F.lit, ("de", "la", "fr", "mul"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    centuries = F.array((F.col("p_size") % 6 + 12).cast("int"), (F.col("p_size") % 6 + 13).cast("int"))
    return p.select(F.concat(F.lit("m"), "p_partkey").alias("model_id"), F.col("p_partkey").alias("ordinal"), script.alias("script"), lang.alias("lang"), centuries.alias("centuries"), F.when(F.col("p_size") > 25, "medieval register").otherwise("modern").alias("notes"))


def _criteria(spark, d):
    c = table(spark, d, "documents")
    script = F.element_at(F.array(*map(F.lit, ("gotische textura", "blackletter", "deutsche kurrent", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return c.select("doc_id", script.alias("script"), F.col("lang"), (F.col("doc_id") % 7 + 11).cast("int").alias("century"), F.when(F.col("doc_id") % 5 == 0, "charter").alias("document_type"))


def model_topk(spark, d):
    return selection.rank_models(_criteria(spark, d), _models(spark, d), ["doc_id"]).select("doc_id", "rank", "model_id", F.round("score", 6).alias("score"))


def routing_gate(spark, d):
    gaps = selection.top2_gap(selection.rank_models(_criteria(spark, d), _models(spark, d), ["doc_id"], 2).withColumn("score", F.round("score", 6)), ["doc_id"])
    gaps = gaps.withColumn("gap", F.round("gap", 6))
    return selection.assess_routing(gaps, F.col("doc_id") % 11 == 0).select("doc_id", "reason", "block", "decided_by")


def ranked_candidates(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, "vlm").otherwise("kraken").alias("engine"), F.length("text").alias("n"))
    ranked = selection.rank_candidates(c, ["conv_id"], F.col("n") % 5 == 0, (F.col("n") % 3).cast("double"), F.col("n").cast("double"), "turn")
    return ranked.select("conv_id", "turn", "auto_rank")


def _line_models(spark, d):
    """A line model for each supplier."""
    s = table(spark, d, "supplier")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("s_suppkey") % len(xs) + 1).cast("int"))
    return s.select(F.concat(F.lit("l"), "s_suppkey").alias("model_id"), F.col("s_suppkey").alias("ordinal"), pick(("de", "mul", "fr")).alias("lang"), pick(("htr", "layout", "line-ocr", "htr")).alias("task"), F.col("s_name").alias("name"), F.concat(F.lit("of century "), (F.col("s_suppkey") % 6 + 12).cast("string")).alias("notes"))


def engine_models(spark, d):
    """Each document asks one engine; every fourth asks one that doesn't exist."""
    asked = _criteria(spark, d).withColumn("engine", F.element_at(F.array(*map(F.lit, ("kraken", "trocr", "party", "none"))), (F.col("doc_id") % 4 + 1).cast("int")))
    return selection.select_best(asked, ["doc_id"], _models(spark, d), _line_models(spark, d), "m1").select("doc_id", "rank", "model_id", F.round("score", 6).alias("score"))


def eligible_pairs(spark, d):
    """A conversation's turns are its readings, every fifth failed; its picks are the numbers from 0, one less than there are readings."""
    reading = F.struct("turn", F.when(F.col("turn") % 3 != 2, F.col("text")).alias("text"), F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "timeout").alias("error"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(reading)).alias("readings"), F.count("*").alias("n"))
    g = g.withColumn("picks", F.when(F.col("n") > 1, F.sequence(F.lit(0), (F.col("n") - 2).cast("int"))).otherwise(F.array().cast("array<int>")))
    return selection.eligible_pairs(g, ["conv_id"], "readings", "picks").select("conv_id", F.col("reading.turn").alias("turn"), "pick")


def engine_plan(spark, d):
    """A document per sixteen parts; its engines' models are its parts, ranked by size over all engines."""
    p = table(spark, d, "part").withColumn("doc_id", F.floor(F.col("p_partkey") / 16))
    engine = F.element_at(F.array(*map(F.lit, ("kraken", "trocr", "vlm"))), F.least(F.lit(3), F.col("p_partkey") % 5 + 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("p_size", "p_partkey"))
    planned = selection.plan_engines(p.select("doc_id", "p_partkey", engine.alias("engine"), rank.alias("rank")), ["doc_id"], "engine", "rank")
    return planned.select("doc_id", "p_partkey", "engine", "step")


# entities


def _mentions(spark, d):
    p = table(spark, d, "part")
    gnd = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("g"), F.col("p_partkey") % 45)).otherwise("")
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("doc_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), gnd.alias("gnd"), F.concat(F.lit("h"), "p_size").alias("hls"), F.lit("").alias("wikidata"), F.col("p_size").cast("string").alias("context"))


def entity_index(spark, d):
    return entities.entity_index(_mentions(spark, d))


def entity_register(spark, d):
    return entities.register(entity_index(spark, d))


def entity_lookup(spark, d):
    names = table(spark, d, "part").select(F.upper("p_name").alias("query")).distinct()
    return entities.lookup(entity_index(spark, d), names)


def entity_by_gnd(spark, d):
    return entities.by_gnd(entity_index(spark, d), _mentions(spark, d).where("gnd <> ''"))


def entity_by_name_type(spark, d):
    names = table(spark, d, "part").select(F.upper("p_name").alias("name"), F.col("p_type").alias("type"))
    return entities.by_name_type(entity_index(spark, d), names)


def _dump(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "place").when(F.col("p_partkey") % 3 == 1, "person")
    return p.groupBy(F.element_at(F.split("p_name", " "), 1).alias("name"), F.col("p_type").alias("variant"), kind.alias("type")).agg(F.min("p_partkey").alias("ord")).select(F.concat(F.lit("a"), "ord").alias("id"), "name", F.array("variant").alias("variants"), "type", "ord")


def dump_search(spark, d):
    return entities.search_dump(table(spark, d, "part").select(F.col("p_name").alias("query")), _dump(spark, d), "person")


def _for_review(spark, d):
    return _mentions(spark, d).select("doc_id", "ord", "name", F.when(F.col("ord") % 2 == 0, "PERSON").otherwise("ORG").alias("type"), F.when(F.col("ord") % 3 == 0, "none").otherwise("hub").alias("link_method"), F.when(F.col("ord") % 5 == 0, "low").otherwise("high").alias("confidence"))


def review_list(spark, d):
    return entities.review_list(_for_review(spark, d), "doc_id", "ord").select("doc_id", "ord", "nth")


def review_items(spark, d):
    found = entities.review_items(_for_review(spark, d), dump_search(spark, d), "doc_id", "ord")
    return found.select("doc_id", "ord", "name", F.array_join(F.transform("candidates", lambda x: x["id"]), ",").alias("candidates"))


def similar_names(spark, d):
    """Every fiftieth part's name with a slip in it, against all names."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type", (F.col("p_partkey") % 97).cast("string")).alias("name"))
    slip = F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)"))
    return similar.closest_of_each(p.where("p_partkey % 50 = 0").select(slip.alias("query")), p, 5, 0.8).select("query", "rank", "name", F.round("ratio", 9).alias("ratio"))


def vocabulary_match(spark, d):
    p = table(spark, d, "part")
    vocabulary = p.groupBy(F.element_at(F.split("p_name", " "), 1).alias("entry")).agg(F.min("p_partkey").alias("ord"))
    return entities.match_vocabulary(p.select(F.col("p_name").alias("term")), vocabulary)


def link_cascade(spark, d):
    p = table(spark, d, "part")
    m = p.select("p_partkey", F.col("p_name").alias("name"))
    by = lambda cond, col: p.where(cond).groupBy(F.col("p_name").alias("name")).agg(F.min(col).alias("target"))
    return entities.link_cascade(m, "name", [("federation", by("p_size > 48", "p_brand"), "high"), ("hub", by("p_size < 3", "p_type"), "medium"), ("dump", by("p_size = 25", "p_brand"), "low")])


def _persons(spark, d):
    p = table(spark, d, "part")
    gnd = F.when(F.col("p_partkey") % 10 == 0, F.col("p_brand"))
    lo = F.col("p_size") * 20 + 1000
    return p.select(
        F.col("p_partkey").alias("pid"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("source"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 25).cast("string")).alias("name"),
        F.lit("").alias("forename"), F.lit("").alias("surname"), F.when(F.col("p_size") > 10, F.concat_ws("-", lo, lo + 5)).alias("life_dates"), gnd.alias("gnd_id"), F.lit("").alias("hls_id"), F.lit("").alias("wikidata_id"),
        F.array("p_type").alias("variants"),
    )


def resolve_edges(spark, d):
    return resolve.match_edges(_persons(spark, d))


def resolve_components(spark, d):
    return connected_components(resolve.match_links(_persons(spark, d)))


def resolve_merged(spark, d):
    p = _persons(spark, d)
    merged = resolve.merge(p, resolve.clusters(p, resolve.match_links(p)))
    return merged.select("cluster", "name", F.array_join("sources", ",").alias("sources"), "confidence", "gnd_id", "life_dates", F.size("variants").alias("n_variants"), "n_members", "needs_review")


# vectors


def cosine_topk(spark, d):
    """Every fiftieth vector against all."""
    v = table(spark, d, "embeddings")
    return vectors.nearest_of_each(v, v.where("vec_id % 50 = 0"), 10).select("query", "vec_id", "rank")


def kmeans_labels(spark, d):
    """Starts from the rows with the smallest digests of their numbers."""
    return vectors.kmeans(table(spark, d, "embeddings"), 8, draw=F.sha2(F.concat(F.lit("0:"), F.col("vec_id").cast("string")).cast("binary"), 256))


# fusion


def _pages(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("engine"), "turn").alias("engine"), "text")


def fuse_votes(spark, d):
    return fusion.fuse(_pages(spark, d), ["conv_id"], "engine", "turn", no_merge_cer=2.0)


def disagreement_spans(spark, d):
    return fusion.disagreements(_pages(spark, d), ["conv_id"], "engine", "turn").select("conv_id", "idx", "token", "chars_start", F.size("readings").alias("n_readings"))


def reconciled_pairs(spark, d):
    """Each turn with the next one."""
    c = table(spark, d, "conversations")
    pairs = c.select("conv_id", "turn", F.col("text").alias("first")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second")), ["conv_id", "turn"])
    out = fusion.reconcile(pairs, "first", "second")
    return out.select("conv_id", "turn", "method", F.length("reconciled").alias("n_chars"), "agreement")


def both_passes(spark, d):
    """The first pass has the even turns, the second those not divisible by three."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return fusion.both_passes(c.where("turn % 2 = 0"), c.where("turn % 3 > 0"), ["conv_id", "turn", "text"]).select("conv_id", "turn", "pass_no")


def stacked_lines(spark, d):
    out = fusion.stacked_lines(_pages(spark, d), ["conv_id"], "turn")
    return out.select("conv_id", F.sha2("reconciled", 256).alias("reconciled_sha256"))


def page_documents(spark, d):
    """A document per conversation, a page per turn, its readings the text and its small letters; pages that differ keep the first."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("p"), "turn").alias("page"), "text")
    readings = c.select("*", F.lit(1).alias("ord"), F.lit("a").alias("engine")).unionByName(c.where("text RLIKE '[A-Z]'").select("doc_id", "page", F.lower("text").alias("text"), F.lit(2).alias("ord"), F.lit("b").alias("engine")))
    out = jobs.documents(readings, no_merge_cer=-1.0)
    return out.select("doc_id", "n_pages", "n_unmerged", F.sha2("text", 256).alias("text_sha256"))


# graph


def _hub(spark, d):
    p = table(spark, d, "part")
    id_ = F.concat(F.lit("hub_"), "p_partkey")
    wikidata = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Q"), "p_partkey")).when(F.col("p_partkey") % 4 == 1, F.col("p_partkey").cast("string")).otherwise("")
    gnd = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("gnd: "), "p_size"))
    notes = F.when(F.col("p_size") > 25, F.col("p_type"))
    entries = p.select("p_partkey", id_.alias("id"), F.col("p_name").alias("name"), wikidata.alias("wikidata"), gnd.alias("gnd"), notes.alias("notes"), F.array("p_size", F.col("p_partkey")).alias("coordinates"))
    terms = p.select(F.col("p_type").alias("term")).distinct()
    return hub.persons(entries.where("p_partkey % 2 = 0")), hub.places(entries.where("p_partkey % 2 = 1")), hub.vocabulary(terms)


def hub_summary(spark, d):
    persons, places, terms = _hub(spark, d)
    return hub.summary(persons=persons, places=places, controlled_vocabulary=terms)


def hub_graph(spark, d):
    return hub.record_triples(reduce(DataFrame.unionByName, _hub(spark, d)))


def fusion_decisions(spark, d):
    j = _judged(spark, d)
    strategy = F.when(F.col("doc_id") % 3 == 0, "no-merge (CER)").when(F.col("doc_id") % 3 == 1, "vote")
    cer = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 8) / 8)
    return graph.fusion_triples(j.select("doc_id", strategy.alias("strategy"), cer.alias("cer"), (F.col("toxic") == 1).alias("arbitrated"), F.when(F.col("quality") == 1, True).alias("judge_skipped")))


def entity_identifiers(spark, d):
    """Nodes of the register with local numbers beside the authorities' addresses."""
    p = table(spark, d, "part")
    e = p.select(F.col("p_brand").alias("doc_id"), T.slug(F.col("p_type")).alias("slug"), F.col("p_type").alias("name"), F.lit("PLACE").alias("type"), F.when(F.col("p_size") == 1, "g1").alias("gnd"), F.lit(None).cast("string").alias("hls"), F.lit(None).cast("string").alias("wikidata"), F.concat(F.lit(" h"), "p_size").alias("hub"))
    return graph.entity_triples(e, local=("hub",))


def working_readings(spark, d):
    """Every document's text as its working reading beside the source's; where the language is de, an engine has that name."""
    j = _judged(spark, d)
    engine = F.when(F.col("lang") == "de", "working").otherwise(F.col("source"))
    readings = j.select("doc_id", engine.alias("engine"), F.col("doc_id").alias("ord"))
    return graph.readings_of(readings, "doc_id", "engine", "ord", j.select("doc_id")).select("doc_id", "key")


def _graph(spark, d):
    j = _judged(spark, d)
    r = graph.readings_of(j.select("doc_id", F.col("source").alias("engine"), F.concat(F.lit("model-"), "source").alias("model_id"), F.col("doc_id").alias("ord")), "doc_id", "engine", "ord")
    s = j.where("quality = 1").select("doc_id", F.array("source").alias("chosen"), (F.col("toxic") == 1).alias("combined"), F.col("lang").alias("editor"), F.lit("2024-01-01").alias("ts"))
    return graph.union(graph.document_triples(j, lang=F.col("lang")), graph.reading_triples(r), graph.selection_triples(s))


def triples(spark, d):
    return _graph(spark, d)


def triple_counts(spark, d):
    return graph.graph_counts(_graph(spark, d))


def provenance_bgp(spark, d):
    g = written(_graph(spark, d), "graph")  # patterns read a table of triples
    found = graph.match(g, ("?doc", "crm:P128_carries", "?reading"), ("?reading", "prov:wasGeneratedBy", "?run"), ("?run", "prov:wasAssociatedWith", "?model"), optional=(("?doc", "ex:closestReading", "?selection"),))
    return found.select("doc", "reading", "run", "model", "selection")


def provenance_paths(spark, d):
    """The model behind each reading of a document, over one path."""
    way = paths.seq("crm:P128_carries", "prov:wasGeneratedBy", "prov:wasAssociatedWith")
    return graph.match(written(_graph(spark, d), "graph"), ("?doc", way, "?model"), ("?doc", "ex:closestReading", "?selection")).select("doc", "model", "selection")


def broader_terms(spark, d):
    """A part lies below the part of a third of its number; all parts above it that are of size 1."""
    p = table(spark, d, "part")
    node = lambda k: F.concat(F.lit("part:"), k.cast("string"))
    below = p.where("p_partkey > 0").select(node(F.col("p_partkey")).alias("s"), F.lit("skos:broader").alias("p"), node(F.floor(F.col("p_partkey") / 3)).alias("o"), F.lit("iri").alias("kind"))
    sized = p.select(node(F.col("p_partkey")), F.lit("ex:size"), F.col("p_size").cast("string"), F.lit("literal"))
    return graph.match(below.union(sized), ("?part", paths.plus("skos:broader"), "?above"), ("?above", "ex:size", "1")).select("part", "above")


def publication_scope(spark, d):
    j = _judged(spark, d).select("doc_id", F.when(F.col("quality") == 1, "PERSON").otherwise("PLACE").alias("type"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("gnd"), F.lit("").alias("hls"), F.lit("").alias("wikidata"), "toxic")
    return graph.publication_scope(j, F.col("toxic") == 1)[1]


def scope_metrics(spark, d):
    """What the scope withholds, counted while the entities that stay are written."""
    j = _judged(spark, d).select("doc_id", F.when(F.col("quality") == 1, "PERSON").otherwise("PLACE").alias("type"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("gnd"), F.lit("").alias("hls"), F.lit("").alias("wikidata"), "toxic")
    kept, seen = graph.observed_scope(j, F.col("toxic") == 1)
    written(kept, "kept")
    return spark.createDataFrame(list(seen.get.items()), "metric string, value long")


def released_graph(spark, d):
    """The judged documents' graph as it is released: toxic documents are flagged, the others' sources are persons and places."""
    j = _judged(spark, d)
    e = j.select("doc_id", F.concat_ws("-", "source", "quality").alias("slug"), F.col("source").alias("name"), F.when(F.col("quality") == 1, "PERSON").otherwise("PLACE").alias("type"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("gnd"), F.lit(None).cast("string").alias("hls"), F.lit(None).cast("string").alias("wikidata"))
    readings = j.select("doc_id", F.col("source").alias("engine"), F.concat(F.lit("model-"), "source").alias("model_id"), F.col("doc_id").alias("ord"))
    picked = j.where("quality = 1").select("doc_id", F.array("source").alias("chosen"), F.lit(False).alias("combined"), F.col("lang").alias("editor"), F.lit("2024-01-01").alias("ts"))
    root = new_path(spark, "release")
    jobs.build_graph(j.select("doc_id"), readings, picked, e, j.where("toxic = 1").select("doc_id"), root)
    return spark.createDataFrame(sorted(jobs.release_notes(spark, root).items()), "what string, n long")


# state


def _inputs(spark, d):
    field = F.element_at(F.array(*map(F.lit, state.INVALIDATION)), (F.col("event_id") % len(state.INVALIDATION) + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), field.alias("field"), F.col("event_type").alias("value"), F.col("event_id").alias("ord"))


def stage_states(spark, d):
    docs = table(spark, d, "events").select(F.col("user_id").alias("doc_id"))
    return state.invalidate(state.new_states(docs), _inputs(spark, d))


def pinned_criteria(spark, d):
    return state.pinned_criteria(_inputs(spark, d))


def stage_outcomes(spark, d):
    """Every event is the outcome of one stage of its user's document."""
    e = table(spark, d, "events")
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    logged = e.select(F.col("user_id").alias("doc_id"), pick(state.STAGES, F.col("event_id")).alias("stage"), pick((state.DONE, state.ERROR, state.DIRTY), F.floor(F.col("event_id") / 7)).alias("status"), F.col("event_id").alias("ord"))
    return state.advance(state.new_states(e.select(F.col("user_id").alias("doc_id"))), logged)


def new_orders(spark, d):
    """The ledger holds the open orders."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return state.new_orders(table(spark, d, "customer").select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def streaming_replay(spark, d):
    """The latest vote per document and voter, by a stream over the events' files that merges each batch into a state table."""
    source = table(spark, d, "events")
    votes = StateTable(spark, new_path(spark, "replay"), "doc string, voter long, candidate string, ord long", ["doc", "voter"], "ord")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet")
    rows = stream.select(F.get_json_object("props", "$.k").alias("doc"), F.col("user_id").alias("voter"), F.col("event_type").alias("candidate"), F.col("event_id").alias("ord"))
    query = rows.writeStream.foreachBatch(merging(votes)).option("checkpointLocation", new_path(spark, "replay-offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return votes.read().select("doc", "voter", "candidate", "ord")


def _all() -> dict:
    names = """corpus_term_stats corpus_top_terms doc_quality_flags doc_chunks search_index search_entities catalogue_search search_records storage_overview run_totals text_functions language_scripts
    years_and_centuries spelled_centuries described_criteria tolerant_json pairwise_cer max_pairwise_cer max_symmetric_cer gate_blocked cer_best_engine cer_engine_means page_quality edit_distances word_error_rates token_offsets votes_latest votes_tally votes_winner
    override_rates selection_agreement coverage_rollup regret_percentiles text_regret fusion_gain routing_prior model_winrates path_preferences preference_pairs bradley_terry strength_priors pseudonymise
    model_topk routing_gate engine_models eligible_pairs engine_plan ranked_candidates entity_index entity_register entity_lookup entity_by_gnd entity_by_name_type dump_search review_list review_items similar_names vocabulary_match link_cascade resolve_edges resolve_components resolve_merged
    cosine_topk kmeans_labels fuse_votes disagreement_spans reconciled_pairs both_passes stacked_lines page_documents hub_summary hub_graph fusion_decisions entity_identifiers working_readings triples triple_counts provenance_bgp provenance_paths broader_terms publication_scope scope_metrics released_graph stage_states stage_outcomes pinned_criteria new_orders streaming_replay"""
    return reduce(lambda out, n: out | {n: globals()[n]}, names.split(), {})


QUERIES = _all() | incremental.QUERIES
