"""Readers for the file layouts of a transcription project. Schemas are given, never inferred; corrupt input is skipped or kept as the layout demands."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ENTITY = "struct<text:string,type:string,normalised:string,context:string,page:string,gnd:string,gnd_id:string,hls:string,hls_id:string,wikidata:string,wikidata_id:string,link_method:string,confidence:string>"
ENTITY_FILE = f"entities array<{ENTITY}>, _corrupt_record string"
RECOGNITION = "struct<engine:string,model_id:string,text:string,confidence:double,error:string>"
PIPELINE_FILE = f"doc_id string, transcription string, entities struct<entities:array<{ENTITY}>>, recognitions array<{RECOGNITION}>, description variant, source_url string, _corrupt_record string"
VOTES = "doc_id string, page string, candidate string, voter string, voter_name string, ts string, _corrupt_record string"
ROUTING = "doc_id string, ts string, field string, inferred_value string, chosen_value string, model_id string, script string, century int, lang string, decided_by string, path string, score double, _corrupt_record string"
PREFERENCES = "doc_id string, page string, offered array<struct<engine:string,model_id:string,local_model_id:string,auto_rank:int>>, chosen array<string>, combined boolean, rejected boolean, auto_pick string, max_pairwise_cer double, criteria struct<script:string,century:int,lang:string>, voter string, ts string, _corrupt_record string"
FIXTURE = "doc_id string, provenance string, reference string, recognitions map<string,string>, fused string, _corrupt_record string"
RUN_STATE = "doc_id string, stage_status map<string,string>, criteria map<string,string>, stale array<string>, source_url string, _corrupt_record string"
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "pdf")


def _stem(suffix: str = "") -> Column:
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return F.regexp_replace(name, suffix + r"\.[^.]+$", "")


def _json(spark: SparkSession, path: str, schema: str, glob: str | None = None, multi_line: bool = True, skip_corrupt: bool = True) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).option("mode", "PERMISSIVE")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.json(path).withColumn("file", F.col("_metadata.file_path"))
    return df.where("_corrupt_record IS NULL").drop("_corrupt_record") if skip_corrupt else df


def entity_files(spark: SparkSession, path: str) -> DataFrame:
    """ord, doc_id and the fields of each entity; alternative field names fall back on each other. ord follows file names, then place."""
    df = _json(spark, path, ENTITY_FILE, "*_entities.json").withColumn("doc_id", F.regexp_extract("file", r"([^/]+)_entities\.json$", 1))
    pos = df.select("file", "doc_id", F.posexplode("entities").alias("pos", "e"))
    pick = lambda *c: F.coalesce(*[F.nullif(F.trim(F.col(f"e.{x}")), F.lit("")) for x in c])
    return pos.select(
        F.struct("file", "pos").alias("place"), "doc_id", pick("normalised", "text").alias("name"), pick("type").alias("type"), pick("gnd_id", "gnd").alias("gnd"), pick("hls_id", "hls").alias("hls"),
        pick("wikidata_id", "wikidata").alias("wikidata"), pick("context").alias("context"), pick("page").alias("page"), "e.link_method", "e.confidence",
    )


def pipeline_files(spark: SparkSession, path: str) -> DataFrame:
    df = _json(spark, path, PIPELINE_FILE, "*_pipeline.json")
    return df.withColumn("doc_id", F.coalesce("doc_id", F.regexp_extract("file", r"([^/]+)_pipeline\.json$", 1)))


def catalogue_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, malformed ones with a null record, so that no document is missing from the catalogue."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "pipeline.json").text(path, wholetext=True)
    return raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/pipeline\.json$", 1).alias("doc_id"), F.try_parse_json("value").alias("record"))


def transcriptions(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """doc_id, text of *.txt files without their # header; ids that have no file are simply absent."""
    from codexlake.functions.text import strip_header

    df = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    df = df.select(_stem().alias("doc_id"), strip_header(F.col("value")).alias("text"))
    return df.join(ids.select("doc_id").distinct(), "doc_id", "left_semi") if ids is not None else df


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log without its corrupt and blank lines. ``ord`` (a struct) orders rows by file name, then place.

    Spark deals files out by size, so the running number orders the rows of
    one block of a file only; name and start of the block come before it.
    """
    df = _json(spark, path, schema, multi_line=False)
    place = F.struct("file", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    return df.withColumn("ord", place).drop("file")


def votes(spark: SparkSession, path: str) -> DataFrame:
    return log(spark, path, VOTES).withColumn("page", F.coalesce("page", F.lit("")))


def preferences(spark: SparkSession, path: str) -> DataFrame:
    df = log(spark, path, PREFERENCES)
    empty = {"chosen": F.array().cast("array<string>"), "combined": F.lit(False), "rejected": F.lit(False), "page": F.lit("")}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in empty.items()})


def routing_log(spark: SparkSession, path: str, for_prior: bool = False) -> DataFrame:
    df = log(spark, path, ROUTING)
    return df.dropna(subset=["script", "century", "lang", "model_id"]) if for_prior else df


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    df = _json(spark, path, FIXTURE, "*.json").where(~F.regexp_extract("file", r"([^/]+)$", 1).startswith("golden"))
    return df.withColumn("doc_id", F.coalesce("doc_id", F.regexp_extract("file", r"([^/]+)\.json$", 1)))


def run_states(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, RUN_STATE, "*.json")


def authority_dump(spark: SparkSession, path: str) -> DataFrame:
    """id, name, variants, type from a flat list or an object of persons and places; rows without id are dropped."""
    item = "struct<hls_id:string,name:string,variants:array<string>,type:string>"
    raw = spark.read.text(path, wholetext=True)
    flat = F.from_json("value", f"array<{item}>")
    both = F.from_json("value", f"struct<persons:array<{item}>,places:array<{item}>>")
    typed = lambda a, kind: F.transform(F.coalesce(a, F.array().cast(f"array<{item}>")), lambda x: x.withField("type", F.coalesce(x["type"], F.lit(kind))))
    is_list = F.ltrim("value").startswith("[")
    rows = F.when(is_list, flat).otherwise(F.concat(typed(both["persons"], "PERSON"), typed(both["places"], "PLACE")))
    out = raw.select(F.explode(rows).alias("x")).select(F.col("x.hls_id").alias("id"), "x.name", "x.variants", "x.type")
    return out.where("coalesce(id, '') <> ''")


HUB_ENTRY = "struct<id:string,name:string,variants:array<string>,modern_name:string,region:string,wikidata:string,gnd:string,hls:string,coordinates:array<string>,notes:string>"


def hub(spark: SparkSession, path: str, seed: str) -> dict[str, DataFrame]:
    """persons, places, organisations (entries), controlled_vocabulary, document_types (ord, term) of a hub file.

    A list that the file lacks is empty; without a readable file the JSON
    text ``seed`` stands in for it.
    """
    own = spark.range(1).select(F.lit(1).alias("way"), F.lit(seed).alias("value"))
    try:
        own = own.unionByName(spark.read.text(path, wholetext=True).select(F.lit(0).alias("way"), "value"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    record = own.withColumn("record", F.try_parse_json("value")).where("record IS NOT NULL").agg(F.min_by("record", "way").alias("record"))
    part = lambda name, t: F.try_variant_get("record", f"$.{name}", f"array<{t}>")
    entries = {k: record.select(F.posexplode(part(k, "variant")).alias("ord", "e")) for k in ("persons", "places", "organisations")}
    entry = F.from_json(F.to_json("e"), HUB_ENTRY)
    terms = {k: record.select(F.posexplode(part(k, "string")).alias("ord", "term")).where("term <> ''") for k in ("controlled_vocabulary", "document_types")}
    return {k: d.select("ord", entry.alias("e")).select("ord", "e.*") for k, d in entries.items()} | terms


def images(spark: SparkSession, path: str) -> DataFrame:
    """Paths of images and scans with their order (the folder below ``path``); the bytes are read only if selected."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return df.where(ext.isin(*IMAGES)).withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1))


def orders(files: DataFrame, root: str) -> DataFrame:
    """Files (path) with their order: the folder right below ``root`` that holds them, at any depth.

    If no folder below ``root`` holds any, its own files are one order with its
    name; else files that lie right in ``root`` belong to none and are left out.
    """
    base = root.rstrip("/")
    inside = F.regexp_extract("path", "^(?:[a-z0-9]+:(?://[^/]*)?)?" + re.escape(re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", base)) + "/(.+)$", 1)
    known = files.withColumn("_in", inside).where("_in <> ''").withColumn("order_id", F.regexp_extract("_in", "^([^/]+)/", 1))
    below = known.where("order_id <> ''")
    found = below if not below.isEmpty() else known.withColumn("order_id", F.lit(base.rsplit("/", 1)[-1]))
    return found.drop("_in")


#: Aliases of person fields per source: first non-empty one counts.
ALIASES = {"pid": ("pid", "id", "person_id"), "name": ("name", "n", "headword", "label"), "life_dates": ("life_dates", "y", "dates"), "gnd_id": ("gnd_id", "gnd"), "hls_id": ("hls_id", "hls"), "wikidata_id": ("wikidata_id", "wikidata"), "snippet": ("snippet", "article_text")}


def normalise_persons(raw: DataFrame, source: str, record: str = "record") -> DataFrame:
    """Source-native person records (VARIANT) in one schema; envelopes named items or results are opened."""
    get = lambda v, p, t="string": F.try_variant_get(v, f"$.{p}", t)
    items = F.coalesce(get(F.col(record), "items", "array<variant>"), get(F.col(record), "results", "array<variant>"), F.try_variant_get(F.col(record), "$", "array<variant>"), F.array(F.col(record)))
    df = raw.select(F.explode(items).alias("r"))
    picked = {k: F.coalesce(*[F.nullif(get(F.col("r"), a), F.lit("")) for a in v]) for k, v in ALIASES.items()}
    variants = F.coalesce(get(F.col("r"), "variants", "array<string>"), get(F.col("r"), "v", "array<string>"), F.array().cast("array<string>"))
    count = F.coalesce(get(F.col("r"), "mention_count", "int"), get(F.col("r"), "c", "int"), F.lit(0))
    return df.select(F.lit(source).alias("source"), *[c.alias(k) for k, c in picked.items()], variants.alias("variants"), count.alias("mention_count")).where("name IS NOT NULL")


def model_registry(raw: DataFrame, record: str = "record") -> DataFrame:
    """Registry rows of line engines: centuries as integers, the first language or ``mul``."""
    get = lambda p, t="string": F.try_variant_get(F.col(record), f"$.{p}", t)
    centuries = F.filter(F.transform(F.coalesce(get("centuries", "array<string>"), F.array().cast("array<string>")), lambda c: c.try_cast("int")), lambda c: c.isNotNull())
    out = raw.select(get("id").alias("model_id"), F.coalesce(get("engine"), F.lit("kraken")).alias("engine"), get("script").alias("script"), F.coalesce(F.get(get("languages", "array<string>"), F.lit(0)), F.lit("mul")).alias("lang"), centuries.alias("centuries"), get("notes").alias("notes"))
    return out.where("engine = 'kraken' AND model_id IS NOT NULL")


def sources_for(catalogue: DataFrame, kind: str) -> DataFrame:
    """Sources (name, kinds, external, ...) that serve a kind and are not external."""
    return catalogue.where(F.array_contains("kinds", kind) & ~F.coalesce("external", F.lit(False)))


#: Fixed kinds of entities that sources serve.
KINDS = ("person", "place", "org", "fulltext")


def catalogue_faults(catalogue: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """name, fault: what a catalogue of sources (name, kinds, tools, url, external) gets wrong; empty for a sound one.

    Names are unique and not empty, kinds and tools are not empty, kinds are
    known, and sources that aren't external have an https address.
    """
    empty = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    strange = F.exists(F.coalesce("kinds", F.array().cast("array<string>")), lambda k: ~F.coalesce(k.isin(*kinds), F.lit(False)))
    rules = {
        "no name": ~named,
        "name is used twice": named & (F.col("_n") > 1),
        "no kind": empty("kinds"),
        "unknown kind": strange,
        "no tool": empty("tools"),
        "no https address": ~F.coalesce("external", F.lit(False)) & ~F.coalesce(F.startswith("url", F.lit("https://")), F.lit(False)),
    }
    counts = catalogue.groupBy("name").agg(F.count("*").alias("_n"))
    marked = catalogue.join(counts, "name", "left")
    return marked.select("name", F.explode(F.array_compact(F.array(*[F.when(rule, fault) for fault, rule in rules.items()]))).alias("fault")).distinct()
