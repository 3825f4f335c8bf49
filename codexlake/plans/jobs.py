"""Whole jobs: from readings to documents, from texts to entities, from fixtures to reports, and the release of a build."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codexlake.functions import json_text as J, text as T
from codexlake.operators import corpus, entities, fusion, graph, metrics, providers
from codexlake.sources import versions
from codexlake.sources.scratch import written
from codexlake.sources.sinks import same_content
from codexlake.sources.telemetry import observed


def read_with_retry(pages: DataFrame, engines: list[Callable[[dict], str]], columns: list[str], least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(readings, errors) of a cascade: each engine sees only the pages that those before it could not read well enough.

    readings: columns, text, qa, engine (its number), one row per page that
    some engine gave an answer for, the best by quality, the first of equals.
    Naming the last engine twice is a retry.
    """
    open_, all_, errors = pages.select(*columns), None, None
    for i, engine in enumerate(engines):
        answers = written(providers.call(open_, engine, columns, "text").withColumn("engine", F.lit(i)).withColumn("qa", T.quality_score(F.col("text"))), "read")
        failed = answers.where("error IS NOT NULL").select(*columns, "engine", "error")
        given = answers.where("text IS NOT NULL").select(*columns, "engine", "text", "qa")
        all_ = given if all_ is None else all_.unionByName(given)
        errors = failed if errors is None else errors.unionByName(failed)
        open_ = answers.where(F.col("text").isNull() | (F.col("qa") < least)).select(*columns)
    best = all_.groupBy(*columns).agg(F.max_by(F.struct("text", "qa", "engine"), F.struct("qa", -F.col("engine"))).alias("_b"))
    return best.select(*columns, "_b.*"), errors


def documents(readings: DataFrame, no_merge_cer: float = 0.35) -> DataFrame:
    """A row per document from its pages' readings (doc_id, page, ord, engine, text): text, n_pages, n_unmerged, contested, qa_score.

    Pages are fused one by one and joined in natural order under headers; a
    page without a usable reading keeps its header. The score is the mean of
    1 - the largest disagreement of a page, within 0..1; a page with one
    reading counts 1, one without any 0.
    """
    pages = readings.select("doc_id", "page").where("doc_id IS NOT NULL AND page IS NOT NULL").distinct()
    fused = fusion.fuse(readings, ["doc_id", "page"], "engine", "ord", no_merge_cer=no_merge_cer)
    every = written(pages.join(fused, ["doc_id", "page"], "left"), "pages")
    agreed = F.when(F.col("strategy").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("max_cer", F.lit(0.0)))))
    counts = every.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("strategy") == "no-merge").alias("n_unmerged"), F.coalesce(F.sum("contested"), F.lit(0)).alias("contested"), F.round(F.avg(agreed), 9).alias("qa_score"))
    return fusion.join_pages(every, "doc_id", F.col("page"), "fused").join(counts, "doc_id")


def extract_entities(docs: DataFrame, extract: Callable[[dict], str], size: int = 4000, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """(entities, errors): every chunk of every text goes to a model; its answer's objects become rows, one per document, name and type.

    Broken answers give the objects that can be saved. entities: doc_id,
    name, type, normalised, context, ord; errors: doc_id, nth, error.
    """
    chunks = corpus.explode_chunks(docs.where("coalesce(text, '') <> ''"), size, overlap)
    answers = written(providers.call(chunks, extract, ["doc_id", "nth", "chunk"]), "extracted")
    objects = answers.where("answer IS NOT NULL").select("doc_id", "nth", F.posexplode(J.salvage(F.col("answer"))).alias("pos", "o"))
    get = lambda k: F.nullif(F.trim(F.try_variant_get("o", f"$.{k}", "string")), F.lit(""))
    rows = objects.select("doc_id", F.coalesce(get("text"), get("normalised")).alias("name"), F.upper(get("type")).alias("type"), get("normalised").alias("normalised"), get("context").alias("context"), (F.col("nth").cast("long") * 1_000_000 + F.col("pos")).alias("ord"))
    found = entities.dedup_extracted(rows.where("name IS NOT NULL AND type IS NOT NULL"), ["doc_id", "name", "type"], "ord")
    return found, answers.where("error IS NOT NULL").select("doc_id", "nth", "error")


#: Elements of a source description, in order.
ELEMENTS = tuple(J.ELEMENTS.values())


def describe(docs: DataFrame, describe_text: Callable[[dict], str], describe_image: Callable[[dict], str], care: Callable[[dict], str], elements: tuple[str, ...] = ELEMENTS) -> DataFrame:
    """doc_id, description (VARIANT), missing, care (struct), low_confidence, errors: one row per document (doc_id, text, image).

    A text that is degenerate or missing is never described from itself: its
    image is, if it has one, and else the description is empty and no model is
    asked. Such rows are of low confidence. Models see both ends of long texts
    (column ``text``); their answers are read tolerantly, and a failed call or
    unreadable answer gives an empty description or care flag.
    """
    flagged = docs.select("doc_id", "text", "image", (T.is_degenerate(F.coalesce("text", F.lit(""))) | (F.trim(F.coalesce("text", F.lit(""))) == "")).alias("low"))
    flagged = written(flagged.select("doc_id", J.both_ends(F.col("text")).alias("text"), "image", "low"), "to-describe")
    readable, pictured = flagged.where("NOT low"), flagged.where("low AND coalesce(image, '') <> ''")
    told = providers.call(readable, describe_text, ["doc_id", "text"]).select("doc_id", "answer", "error")
    seen = providers.call(pictured, describe_image, ["doc_id", "image"]).select("doc_id", "answer", "error")
    about = written(told.unionByName(seen), "described")
    flags = written(providers.call(readable, care, ["doc_id", "text"]).select("doc_id", F.col("answer").alias("flag"), F.col("error").alias("care_error")), "care")
    rows = flagged.join(about, "doc_id", "left").join(flags, "doc_id", "left").withColumn("description", F.coalesce(J.tolerant(F.col("answer")), F.parse_json(F.lit("{}"))))
    return rows.select("doc_id", "description", J.missing_elements(F.col("description"), list(elements)).alias("missing"), J.care_flag(F.coalesce("flag", F.lit(""))).alias("care"), F.col("low").alias("low_confidence"), F.array_compact(F.array("error", "care_error")).alias("errors"))


def analyse_corpus(docs: DataFrame, name: str, ask: dict[str, Callable[[dict], str]], size: int = 30_000) -> dict[str, DataFrame]:
    """Reports on a corpus (doc_id, text): totals, stats, and one of each kind that ``ask`` has a model for.

    Every chunk of every text goes to each model. An answer is an object with
    ``items`` (an array of texts) and ``fields`` (texts by name); a kind's
    report has kind, items (distinct, in order of document and chunk) and
    fields (the last answer's value of a name counts), and the number of chunks
    that failed. Blank texts are left out; without any the reports are empty.
    """
    known = docs.where("trim(coalesce(text, '')) <> ''").select("doc_id", "text")
    chunks = written(corpus.explode_chunks(known, size, 0), "chunks")
    totals = known.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars")).where("doc_count > 0").select(F.lit(name).alias("corpus_name"), "doc_count", "total_chars")
    reports = {"totals": totals, "stats": corpus.corpus_stats(known)}
    for kind, model in ask.items():
        answers = written(providers.call(chunks, model, ["doc_id", "nth", "chunk"]), "asked").withColumn("v", J.tolerant(F.col("answer")))
        at = F.struct("doc_id", "nth")
        items = answers.select(at.alias("at"), F.posexplode(F.try_variant_get("v", "$.items", "array<string>")).alias("pos", "item")).where("item IS NOT NULL")
        first = items.groupBy("item").agg(F.min(F.struct("at", "pos")).alias("first"))
        fields = answers.select(at.alias("at"), F.explode(F.try_variant_get("v", "$.fields", "map<string,string>")).alias("name", "value")).groupBy("name").agg(F.max_by("value", "at").alias("value"))
        failed = answers.agg(F.count_if(F.col("v").isNull()).alias("failed"))
        reports[kind] = {"items": first.select("item", "first").orderBy("first").select("item"), "fields": fields, "failed": failed}
    return reports


def evaluate(fixtures: DataFrame, fold_abbreviations: bool = False) -> dict[str, DataFrame]:
    """Reports on fixtures (doc_id, reference, recognitions: engine -> text, fused): cers, best, engines, gain.

    Fixtures without a reference are left out; engines are in the order of the map.
    """
    known = fixtures.where("coalesce(reference, '') <> ''")
    readings = known.select("doc_id", "reference", F.posexplode("recognitions").alias("ord", "engine", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    options = {"fold_abbreviations": fold_abbreviations}
    cers = metrics.cer_table(readings.drop("reference"), known.select("doc_id", "reference"), ["doc_id"], "engine", "ord", **options)
    return {
        "cers": cers,
        "best": metrics.best_engine(cers, ["doc_id"]),
        "engines": metrics.engine_means(cers, ["doc_id"]).join(metrics.mean_rates(readings, ["engine"], **options).select("engine", "mean_wer", "n"), "engine"),
        "gain": metrics.fusion_gain(cers, known.select("doc_id", "reference", "fused"), ["doc_id"], **options),
    }


def release(lines: DataFrame, root: str, column: Column | None = None, about: dict | None = None) -> bool:
    """Write a build of lines below ``root`` and make it the current one; False if it says what the current one says.

    An empty build is refused. Builds have folders of their own, and a version
    file that is added names the current one and what is said ``about`` it, so
    readers always find a whole build, the old one or the new one.
    """
    spark = lines.sparkSession
    path = f"builds/{uuid.uuid4().hex}"
    lines.select((F.col("value") if column is None else column).alias("value")).write.text(f"{root}/{path}")
    new = spark.read.text(f"{root}/{path}")
    if new.isEmpty():
        raise ValueError("refusing to release an empty build")
    number, _ = versions.newest(spark, root)
    old = released(spark, root)
    if old is not None and same_content(old, new):
        versions.delete(spark, f"{root}/{path}")
        return False
    versions.add(spark, root, number + 1, {"build": path, "about": about or {}})
    return True


def released(spark: SparkSession, root: str) -> DataFrame | None:
    """The lines of the current build; None before the first."""
    build = versions.newest(spark, root)[1].get("build")
    return spark.read.text(f"{root}/{build}") if build else None


def release_notes(spark: SparkSession, root: str) -> dict:
    """What was said about the current build; empty before the first."""
    return versions.newest(spark, root)[1].get("about", {})


def build_graph(docs: DataFrame, readings: DataFrame, selections: DataFrame, entities: DataFrame, flagged: DataFrame, root: str, drop_persons: bool = False, need_authority: bool = True) -> tuple[bool, dict]:
    """(released, notes): the corpus graph within the publication scope, as sorted N-Triples below ``root``.

    docs (doc_id), readings (doc_id, engine, model_id, ord), selections (doc_id,
    chosen, combined, editor, ts), entities (doc_id, slug, name, type and
    authorities), flagged (doc_id). Flagged documents are left out with all that
    belongs to them; what is withheld is counted while the entities are
    written. Notes: triples, documents, readings, mentions, and the counts by
    reason; release_notes() reads them back.
    """
    shown = written(docs.join(flagged.select("doc_id").distinct(), "doc_id", "left_anti"), "docs")
    within = lambda rows: rows.join(shown.select("doc_id"), "doc_id", "left_semi")
    marked = entities.join(flagged.select("doc_id").distinct().withColumn("_f", F.lit(True)), "doc_id", "left")
    kept, seen = graph.observed_scope(marked, F.coalesce("_f", F.lit(False)), drop_persons, need_authority)
    kept = written(kept.drop("_f"), "entities")
    withheld = {k: v for k, v in seen.get.items() if k in graph.REASONS}
    made = graph.union(
        graph.document_triples(shown),
        graph.reading_triples(graph.readings_of(within(readings), "doc_id", "engine", "ord")),
        graph.selection_triples(within(selections)),
        graph.entity_triples(kept),
    )
    made, counted = observed(
        made,
        triples=F.count("*"),
        documents=F.count_if((F.col("p") == graph.TYPE) & (F.col("o") == graph.DOCUMENT)),
        readings=F.count_if((F.col("p") == graph.TYPE) & (F.col("o") == graph.READING)),
        mentions=F.count_if(F.col("p") == graph.MENTIONS),
    )
    made = written(made, "graph")  # counts once; sorting would run what stands before it twice
    notes = {**counted.get, **withheld}
    return release(graph.n_triples(made), root, about=notes), notes
