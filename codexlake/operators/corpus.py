"""Corpus statistics, chunks, storage overview, telemetry and the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codexlake.functions import json_text as J, text as T

#: Fixed list: German function words and formula words left out of term lists.
STOPWORDS = tuple(
    """der die das den dem des ein eine einer einem einen und oder aber sondern auch weder noch in von mit zu für auf aus nach bei an unter über durch
    vor hinter zwischen ohne um gegen seit bis ich du er sie es wir ihr mich dich sich uns euch mir dir ihm ihn dieser diese dieses deren dessen derer
    was wer wen wem wessen ist sind war waren wird werden wurde wurden sein seine seiner hat haben hatte hatten kann können konnte muss müssen musste
    soll sollen sollte will wollen wollte nicht schon nur ja nein doch also so dann als wie wenn weil damit vnd item namm nam uff""".split()
)


def term_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, term) of every countable term."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(T.terms(F.col(text))).alias("pos", "term"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: doc_count, total_words, total_unique_words, total_chars. Documents are counted one by one, without separators between them."""
    sums = docs.agg(F.count("*").alias("doc_count"), F.sum(F.size(T.tokens(F.col(text))).cast("long")).alias("total_words"), F.sum(F.length(text).cast("long")).alias("total_chars"))
    unique = docs.select(F.explode(T.terms(F.col(text))).alias("term")).groupBy("term").agg(F.lit(1).alias("one")).agg(F.count("*").alias("total_unique_words"))
    both = sums.unionByName(unique, allowMissingColumns=True)  # two rows, filled from each other
    return both.agg(*[F.max(c).alias(c) for c in ("doc_count", "total_words", "total_unique_words", "total_chars")])


def top_terms(docs: DataFrame, n: int = 30, stopwords=STOPWORDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The n most frequent terms that are no stopwords: rank, term, freq. Ties by first occurrence."""
    stop = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in stopwords], "term string"))
    freq = term_rows(docs, doc, text).groupBy("term").agg(F.count("*").alias("freq"), F.min(F.struct("doc", "pos")).alias("first"))
    best = freq.join(stop, "term", "left_anti").orderBy(F.desc("freq"), "first").limit(n)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("o"), "first", "term", "freq"))).alias("a"))  # n rows
    return ranked.select(F.posexplode("a").alias("p", "x")).select((F.col("p") + 1).alias("rank"), "x.term", "x.freq")


def explode_chunks(docs: DataFrame, size: int, overlap: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc), F.explode(T.chunks(F.col(text), size, overlap)).alias("c")).select(doc, "c.*")


def merge_chunk_results(results: DataFrame, key: str, nth: str, items: str, fields: str) -> DataFrame:
    """Per key the items of all chunks in order, and a map in which the last chunk wins."""
    ordered = F.array_sort(F.collect_list(F.struct(nth, items, F.map_entries(fields).alias(fields))))
    entries = F.flatten(F.transform("all", lambda x: x[fields]))
    last = F.aggregate(entries, F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
    return results.groupBy(key).agg(ordered.alias("all")).select(key, F.flatten(F.transform("all", lambda x: x[items])).alias(items), last.alias(fields))


def quality_flags(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, degenerate, quality; the flag is worked out once, on the text as it is."""
    flagged = docs.select(doc, text, T.is_degenerate(F.col(text)).alias("degenerate"))
    return flagged.select(doc, "degenerate", T.quality_score(F.col(text), degenerate=F.col("degenerate")).alias("quality"))


def storage_overview(files: DataFrame, group: Column, size: Column) -> DataFrame:
    """Per group: files, bytes, and tokens estimated at four bytes each."""
    return files.groupBy(group.alias("grp")).agg(F.count("*").alias("files"), F.sum(size.cast("long")).alias("bytes"), F.floor(F.sum(size) / 4).cast("long").alias("est_tokens"))


def run_totals(runs: DataFrame, by: str, seconds: str, tokens: str, error: str) -> DataFrame:
    """Telemetry per agent: runs, seconds, tokens, errors."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.sum(seconds).alias("seconds"), F.sum(tokens).alias("tokens"), F.count_if(F.coalesce(F.col(error), F.lit("")) != "").alias("errors"))


def search_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", snippet: int = 300, **columns: Column) -> DataFrame:
    """Catalogue record per document: id, a snippet of the text, and the columns given."""
    return docs.select(doc, F.substring(F.coalesce(F.col(text), F.lit("")), 1, snippet).alias("snippet"), *[c.alias(n) for n, c in columns.items()])


def search_records(docs: DataFrame, limit: int = 300) -> DataFrame:
    """Records of the search page, one per document: doc_id, date, lang, script, entities, snippet, url.

    docs: doc_id, description (VARIANT of elements), transcription, entities
    (array of text, normalised). Elements are taken as they are written, plain
    or wrapped; what is missing or null is empty. A snippet is the text with its
    white space collapsed, cut after ``limit`` characters with an ellipsis.
    """
    get = lambda k: F.coalesce(J.element(F.col("description"), J.ELEMENTS[k]), F.lit("")).alias(k)
    cut = lambda s: F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)
    snippet = T.let(T.collapse(F.coalesce("transcription", F.lit(""))), cut).alias("snippet")
    return docs.select("doc_id", get("date"), get("lang"), get("script"), entity_names(F.col("entities")).alias("entities"), snippet, F.concat(F.col("doc_id").cast("string"), F.lit("/")).alias("url"))


def index_lines(records: DataFrame) -> DataFrame:
    """doc_id, line: the rows of the search page's table."""
    cell = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]("), "url", F.lit(")"))
    return records.select("doc_id", F.concat(F.lit("| "), F.concat_ws(" | ", cell, "date", "lang", "script", F.size("entities").cast("string")), F.lit(" |")).alias("line"))


def entity_names(entities: Column) -> Column:
    """Distinct names of a document's entities (text, normalised) in order: the normalised form, else the text."""
    filled = lambda c: F.nullif(T.strip(c), F.lit(""))
    names = F.transform(F.coalesce(entities, F.array()), lambda e: F.coalesce(filled(e["normalised"]), filled(e["text"])))
    return F.array_distinct(F.array_compact(names))


def catalogue_search(index: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows in which every folded term of the query is found inside the folded fields; an empty query finds all."""
    hay = T.fold_marks(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    marked = index.withColumn("_hay", hay)
    wanted = T.fold_marks(F.lit(query))
    return marked.where(F.forall(F.filter(F.split(wanted, r"\s+"), lambda t: t != ""), lambda t: F.contains(F.col("_hay"), t))).drop("_hay")
