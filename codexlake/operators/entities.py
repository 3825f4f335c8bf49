"""Entity index, vocabulary and authority lookups, linking, review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codexlake.functions import rules as R, text as T
from codexlake.operators import similar


def dedup_extracted(entities: DataFrame, key: list[str], order: str, context: str = "context") -> DataFrame:
    """One row per key: the last one with a context, else the first."""
    has = F.coalesce(F.col(context), F.lit("")) != ""
    prefer = F.when(has, F.col(order)).otherwise(-F.col(order) - F.lit(1 << 40))
    rest = [c for c in entities.columns if c not in key]
    return entities.groupBy(*key).agg(F.max_by(F.struct(*rest), prefer).alias("x")).select(*key, "x.*")


def entity_index(entities: DataFrame) -> DataFrame:
    """Merged entities: key, slug, name, type, gnd, hls, wikidata, n_docs, n_mentions, first_ord.

    entities: ord, doc_id, name, type, gnd, hls, wikidata, context. Rows with a
    GND id merge by it, take the longest name (the first of equals) and the ids
    of their first row; the others merge by normalised name and type and keep
    the first name. Colliding slugs get a number in order of first occurrence.
    Mentions count once per document and context.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    e = entities.select("ord", "doc_id", *[blank(c).alias(c) for c in ("name", "type", "gnd", "hls", "wikidata", "context")]).where("name <> '' AND type <> ''")
    e = e.withColumn("norm", T.index_name(F.col("name"))).where("gnd <> '' OR norm <> ''")
    key = F.when(F.col("gnd") != "", F.concat(F.lit("gnd-"), "gnd")).otherwise(F.concat_ws("\t", "norm", "type"))
    e = e.withColumn("key", key)
    mentions = e.select("key", "doc_id", "context").distinct().groupBy("key").agg(F.count("*").alias("n_mentions"), F.count_distinct("doc_id").alias("n_docs"))
    first = lambda c: F.min_by(c, "ord")
    longest = F.max_by("name", F.struct(F.length("name"), -F.col("ord")))
    merged = e.groupBy("key").agg(F.when(F.max("gnd") != "", longest).otherwise(first("name")).alias("name"), *[first(c).alias(c) for c in ("type", "gnd", "hls", "wikidata")], F.min("ord").alias("first_ord"))
    merged = merged.withColumn("base", F.when(F.col("gnd") != "", F.col("key")).otherwise(T.slug(F.col("name"))))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("first_ord"))
    merged = merged.withColumn("nth", nth).withColumn("slug", F.when(F.col("nth") > 1, F.concat_ws("-", "base", "nth")).otherwise(F.col("base")))
    ids = [F.when(F.col("gnd") != "", F.col(c)).otherwise("").alias(c) for c in ("hls", "wikidata")]
    return merged.join(mentions, "key").select("key", "slug", "name", "type", "gnd", *ids, "n_docs", "n_mentions", "first_ord")


def register(index: DataFrame) -> DataFrame:
    """Entries and mentions per initial."""
    return index.groupBy(F.upper(F.substring("name", 1, 1)).alias("initial")).agg(F.count("*").alias("entries"), F.sum("n_mentions").alias("mentions"))


def by_substring(index: DataFrame, query: str) -> DataFrame:
    return index.where(F.contains(F.lower("name"), F.lit(query.lower())))


def lookup(index: DataFrame, names: DataFrame) -> DataFrame:
    """query -> slug of the entry that shares a folded or umlaut-spelled key; most mentions first, then first occurrence."""
    left = names.select("query", F.explode(T.match_keys(F.col("query"))).alias("k"))
    right = index.select("slug", "n_mentions", "first_ord", F.explode(T.match_keys(F.col("name"))).alias("k"))
    hits = left.join(right, "k")
    return hits.groupBy("query").agg(F.min_by("slug", F.struct(-F.col("n_mentions"), "first_ord")).alias("slug"))


def needs_review(link_method: Column, confidence: Column) -> Column:
    return F.coalesce(link_method.isin("none", "hls_dhs"), F.lit(False)) | F.coalesce(confidence.isin("unverified", "low"), F.lit(False))


def review_list(entities: DataFrame, doc: str, order: str, limit: int = 5) -> DataFrame:
    """The first persons and places of each document that need a look."""
    rows = entities.where(F.col("type").isin("PERSON", "PLACE") & needs_review(F.col("link_method"), F.col("confidence")))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(doc).orderBy(order))).where(F.col("nth") <= limit)


def contained(terms: DataFrame, entries: DataFrame, least: int = 4) -> DataFrame:
    """t, low of all pairs where one holds the other and ``low`` has ``least`` letters or more, equal ones included.

    ``terms`` (t) and ``entries`` (low) are distinct and not empty. Pairs come
    from joins on the rarest stretch of ``least`` letters of whatever lies in
    the other; a shorter term is met whole.
    """
    long = entries.where(F.length("low") >= least)
    inside = similar.holders(long, terms, least, "low", "t").select(F.col("text").alias("t"), F.col("needle").alias("low"))
    around = similar.holders(terms, long, least, "t", "low").select(F.col("needle").alias("t"), F.col("text").alias("low"))
    return inside.unionByName(around).distinct()


def match_vocabulary(mentions: DataFrame, vocabulary: DataFrame, term: str = "term", least: int = 4) -> DataFrame:
    """term -> entry: an equal one, else the first of ``least`` letters or more inside the mention or around it.

    vocabulary (entry, ord); null and blank terms have no entry. Terms and
    entries meet by joins on equal names and on short stretches.
    """
    v = vocabulary.select("entry", "ord", F.lower("entry").alias("low")).where("low <> ''")
    t = mentions.select(F.col(term)).distinct().withColumn("t", F.lower(F.trim(F.col(term))))
    own = t.select("t").where("t <> ''").distinct()
    equal = own.join(v.select("low").distinct(), F.col("t") == F.col("low")).select("t", "low")
    pairs = equal.union(contained(own, v.select("low").distinct(), least)).distinct()
    best = pairs.join(v, "low").groupBy("t").agg(F.min_by("entry", F.struct(F.col("low") != F.col("t"), "ord")).alias("entry"))
    return t.join(best, "t", "left").select(term, "entry")


def search_dump(queries: DataFrame, dump: DataFrame, kind: str, limit: int = 5, least: int = 4) -> DataFrame:
    """query, nth, id, name: the first entries of an authority dump (id, name, variants, type, ord) by name or variant.

    A name matches if it is equal or, with ``least`` letters or more, holds the
    query or lies in it, ignoring case. Entries of another kind are left out,
    those without a kind are not. A blank query finds nothing.
    """
    names = F.filter(F.concat(F.array("name"), F.coalesce("variants", F.array().cast("array<string>"))), lambda n: F.coalesce(n, F.lit("")) != "")
    d = dump.where(F.coalesce("type", F.lit("")).isin("", kind)).select("id", "name", "ord", F.explode(F.array_distinct(F.transform(names, lambda n: F.lower(n)))).alias("low"))
    q = queries.select("query").distinct().withColumn("t", F.lower(F.trim("query"))).where("t <> ''")
    own, low = q.select("t").distinct(), d.select("low").distinct()
    pairs = own.join(low, F.col("t") == F.col("low")).select("t", "low").union(contained(own, low, least)).distinct()
    hits = q.join(pairs, "t").join(d, "low").select("query", "id", "name", "ord").distinct()
    nth = F.row_number().over(Window.partitionBy("query").orderBy("ord", "id"))
    return hits.withColumn("nth", nth).where(F.col("nth") <= limit).select("query", "nth", "id", "name")


def review_items(entities: DataFrame, candidates: DataFrame, doc: str, order: str, limit: int = 5, k: int = 3) -> DataFrame:
    """The review list with each entity's first candidates: doc, order, name, candidates (array of id, name), which may be empty.

    ``candidates`` (query, nth, id, name) is what a search found for the names.
    """
    found = candidates.where(F.col("nth") <= k).groupBy(F.col("query").alias("name"))
    found = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id", F.col("name").alias("label")))), lambda x: F.struct(x["id"].alias("id"), x["label"].alias("name"))).alias("candidates"))
    items = review_list(entities, doc, order, limit).select(doc, order, F.trim(F.coalesce("name", F.lit(""))).alias("name"))
    none = F.array().cast("array<struct<id:string,name:string>>")
    return items.join(found.withColumn("candidates", F.col("candidates").cast("array<struct<id:string,name:string>>")), "name", "left").select(doc, order, "name", F.coalesce("candidates", none).alias("candidates"))


def by_gnd(index: DataFrame, ids: DataFrame) -> DataFrame:
    """gnd, slug: the first entry of the index with each authority id; ids without one are left out."""
    first = index.where("gnd <> ''").groupBy("gnd").agg(F.min_by("slug", "first_ord").alias("slug"))
    return ids.select("gnd").distinct().join(first, "gnd")


def by_name_type(index: DataFrame, names: DataFrame) -> DataFrame:
    """name, type, slug: the first entry of the index with the normalised name and the type."""
    first = index.select(T.index_name(F.col("name")).alias("norm"), "type", "slug", "first_ord").groupBy("norm", "type").agg(F.min_by("slug", "first_ord").alias("slug"))
    return names.select("name", "type").distinct().withColumn("norm", T.index_name(F.col("name"))).join(first, ["norm", "type"]).select("name", "type", "slug")


def name_matches(query: Column, names: Column) -> Column:
    """Substring either way with the name or any variant, ignoring case."""
    q = F.lower(query)
    return F.exists(F.transform(names, lambda n: F.lower(n)), lambda n: F.contains(q, n) | F.contains(n, q))


def tokens_subset(a: Column, b: Column) -> Column:
    """Whether the words of one name are all in the other."""
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def link_cascade(mentions: DataFrame, key: str, sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Links from the first source that has one: method, target, confidence.

    Each source is (method, table of (key, target), confidence). A source only
    sees the keys that those before it left open.
    """
    open_, done = mentions.select(key).distinct(), None
    for method, table, confidence in sources:
        t = table.groupBy(key).agg(F.min("target").alias("target"))
        hit = open_.join(t, key).select(key, "target", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
        done = hit if done is None else done.unionByName(hit)
        open_ = open_.join(t, key, "left_anti")
    rest = open_.select(key, F.lit(None).cast("string").alias("target"), F.lit("none").alias("method"), F.lit("unverified").alias("confidence"))
    return mentions.join(done.unionByName(rest), key)


def authority_links(index: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links per entry and source from resolved clusters of the same name, else of the entry's query with lower confidence.

    clusters: norm (normalised name), query_norm, source, id, confidence.
    Several ids of one source are all given and marked contested.
    """
    i = index.select("slug", T.index_name(F.col("name")).alias("n"))
    exact = i.join(clusters, i["n"] == clusters["norm"]).select("slug", "source", "id", "confidence")
    loose = i.join(exact.select("slug").distinct(), "slug", "left_anti").join(clusters, i["n"] == clusters["query_norm"])
    loose = loose.select("slug", "source", "id", R.lower_confidence(F.col("confidence")).alias("confidence"))
    both = exact.unionByName(loose)
    contested = both.groupBy("slug", "source").agg((F.count_distinct("id") > 1).alias("contested"))
    best = both.groupBy("slug", "source", "id").agg(F.max(R.confidence_rank(F.col("confidence"))).alias("rank"))
    return best.join(contested, ["slug", "source"]).withColumn("uri", R.authority_uri(F.col("source"), F.col("id")))


def answered(queried: Column, unavailable: Column) -> Column:
    return F.array_except(queried, unavailable)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows replace those of the same non-empty id; rows without id are added."""
    all_ = table.unionByName(rows)
    keyed = all_.where(F.coalesce(F.col(key), F.lit("")) != "")
    rest = [c for c in table.columns if c != key]
    last = keyed.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*").select(*table.columns)
    return last.unionByName(all_.where(F.coalesce(F.col(key), F.lit("")) == ""))


def add_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.where(F.coalesce(F.col(key), F.lit("")) != "").dropDuplicates([key]).join(table, key, "left_anti").select(*table.columns))
