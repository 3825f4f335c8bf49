"""Entity resolution: blocked matching rules, components, merged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codexlake.functions import rules as R, text as T
from codexlake.operators.components import connected_components
from codexlake.sources.parallel import spread, spread_small
from codexlake.sources.scratch import written

#: Persons of one key that are compared with as many others at a time.
BLOCK = 500

#: Persons whose pairs with a block are made at a time; Spark holds the rows of one step of a loop until it ends.
PIECE = 50

IDS = ("gnd_id", "hls_id", "wikidata_id")


def prepare(persons: DataFrame) -> DataFrame:
    """persons: pid (orderable, unique), source, name, forename, surname, life_dates, the ids, variants."""
    names = F.filter(F.concat(F.array("name"), F.coalesce("variants", F.array().cast("array<string>"))), lambda v: v.isNotNull() & (v != ""))
    keyed = spread_small(persons).select("pid", *IDS, "life_dates", T.fold(F.coalesce("surname", F.lit(""))).alias("sur"), T.fold(F.coalesce("forename", F.lit(""))).alias("fore"), T.person_name(F.coalesce("name", F.lit(""))).alias("norm"), F.explode_outer(names).alias("v"))
    keyed = keyed.withColumn("vn", T.person_name(F.col("v")))
    rest = [*IDS, "sur", "fore", "norm", "life_dates"]
    out = keyed.groupBy("pid").agg(*[F.first(c).alias(c) for c in rest], F.collect_set("vn").alias("names"))
    return out.withColumn("years", R.parse_years(F.col("life_dates"))).drop("life_dates")


def match_edges(persons: DataFrame) -> DataFrame:
    """a, b (a < b), confidence of all matching pairs, by blocking keys.

    A shared authority id matches with high confidence. Equal normalised names
    match with high confidence if the years meet, medium if they are unknown,
    and never if they don't meet. Equal surnames with equal forenames or a
    shared variant match with medium confidence if the years meet. A pair found
    by several keys takes the first of these rules. The keys are the ids, the
    name, and the surname with the forename or with each variant, so a common
    surname is no block by itself, and the first key that two persons share
    names their rule.

    Persons of a key with the same years and the same keys before it, of those
    that others have too, are one run: runs, not persons, are compared, and a match is all pairs of their
    persons. A key's persons meet block by block, in tasks of their own. What
    is written are the matching runs; their pairs are made when the result is
    read, so they are never held, sorted or stored.
    """
    p = written(prepare(persons), "prepared")
    key = lambda rule, kind, cond, *values: F.when(cond, F.struct(F.lit(rule).alias("rule"), F.concat_ws("\t", F.lit(kind), *values).alias("key")))
    filled = lambda c: F.col(c).cast("string") != ""
    sur = [F.length("sur").cast("string"), F.col("sur")]  # the length keeps a tab inside a surname apart from the one behind it
    keys = [*[key("id", c, filled(c), F.col(c).cast("string")) for c in IDS], key("name", "norm", filled("norm"), F.col("norm")), key("surname", "fore", filled("sur") & filled("fore"), *sur, F.col("fore"))]
    variants = F.transform(F.array_sort("names"), lambda n: key("surname", "variant", filled("sur"), *sur, n))
    p = p.where("pid IS NOT NULL").select("pid", "years", F.posexplode(F.array_compact(F.concat(F.array(*keys), variants))).alias("nth", "k"))
    w = Window.partitionBy("rule", "key")
    shared = p.select("pid", "years", "nth", "k.*").where("rule <> 'surname' OR years IS NOT NULL").withColumn("n", F.count("*").over(w)).where("n > 1")
    p = shared.groupBy("pid").agg(F.first("years").alias("years"), F.array_sort(F.collect_list(F.struct("nth", "rule", "key", "n"))).alias("keys"))
    before = F.transform(F.slice("keys", 1, F.col("at")), lambda k: k["key"])
    rows = p.select("pid", "years", "keys", F.posexplode("keys").alias("at", "k"))
    rows = rows.select("k.*", F.when(F.col("k.rule") != "id", F.col("years")).alias("years"), before.alias("before"), "pid")
    placed = rows.withColumn("at", F.row_number().over(w.orderBy("years", "before", "pid")) - 1)
    block, last = F.floor(F.col("at") / BLOCK).cast("int").alias("block"), F.floor((F.col("n") - 1) / BLOCK).cast("int").alias("last")
    runs = written(placed.groupBy("rule", "key", block, last, "years", "before").agg(F.array_sort(F.collect_list("pid")).alias("pids")), "runs")
    cell = ["rule", "key", "i", "j"]
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("years", "before", "pids")]
    left = runs.select("rule", "key", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), *side("a"))
    right = runs.select("rule", "key", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), *side("b"))
    met = spread(left, *cell).join(spread(right, *cell), cell).where("i < j OR a_pids[0] <= b_pids[0]").where(~F.arrays_overlap("a_before", "b_before"))
    same = (F.col("i") == F.col("j")) & (F.col("a_pids")[0] == F.col("b_pids")[0])
    overlap = R.years_overlap(F.col("a_years"), F.col("b_years"))
    by_name = F.when(overlap.isNull(), "medium").when(overlap, "high")
    label = F.when(F.col("rule") == "id", "high").when(F.col("rule") == "name", by_name).when(overlap, "medium")
    found = met.select("a_pids", "b_pids", same.alias("same"), label.alias("confidence")).where("confidence IS NOT NULL AND (NOT same OR size(a_pids) > 1)")
    pieces = F.transform(F.sequence(F.lit(0), F.size("a_pids") - 1, F.lit(PIECE)), lambda at: F.struct(at.alias("at"), F.slice("a_pids", at + 1, PIECE).alias("a_pids")))
    found = written(found.select(F.explode(pieces).alias("p"), "b_pids", "same", "confidence").select("p.*", "b_pids", "same", "confidence"), "matches")
    found = found.select("at", "b_pids", "same", "confidence", F.posexplode("a_pids").alias("nth", "x"))
    others = F.when(F.col("same"), F.slice("b_pids", F.col("at") + F.col("nth") + 2, F.size("b_pids"))).otherwise(F.col("b_pids"))
    return found.select("confidence", "x", F.explode(others).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "confidence")


def match_links(persons: DataFrame, tolerance: int = 25) -> DataFrame:
    """a, b (a < b), confidence: few of the edges of match_edges(), with the same components and the same strongest edge in each.

    Every person has at most a few links for each of its keys, however many
    share one. Where a key is enough (an authority id) all link to the smallest
    pid. Of one name, all link to the smallest pid of those without years, as
    these match everyone. Those with years link to the smallest pid among those
    with the same first year, whose years meet; per key and first year one row
    is left, at most as many as there are years, and each links back to the one
    before it that lasts longest, if their years meet.
    """
    p = written(prepare(persons), "prepared")
    filled = lambda c: F.col(c).cast("string") != ""
    key = lambda kind, rank, cond, *values: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.concat_ws("\t", F.lit(kind), *values).alias("key")))
    keys = [key("id", 3, filled(c), F.lit(c), F.col(c).cast("string")) for c in IDS]
    keys += [key("name", 3, filled("norm"), F.col("norm")), key("surname", 2, filled("sur") & filled("fore"), F.lit("fore"), F.col("sur"), F.col("fore"))]
    variant = lambda n: F.struct(F.lit("surname").alias("kind"), F.lit(2).alias("rank"), F.concat_ws("\t", F.lit("surname"), F.lit("variant"), F.col("sur"), n).alias("key"))
    variants = F.when(filled("sur"), F.transform(F.filter("names", lambda n: n.isNotNull()), variant))
    every = F.array_compact(F.concat(F.array(*keys), F.coalesce(variants, F.filter(F.array(variant(F.lit(""))), lambda x: F.lit(False)))))
    rows = written(p.select("pid", F.col("years.lo").alias("lo"), F.col("years.hi").alias("hi"), F.explode(every).alias("k")).select("pid", "lo", "hi", "k.*").distinct(), "keys")

    def star(members: DataFrame, centre: DataFrame, on: list[str], rank: Column) -> DataFrame:
        return members.join(centre, on).where("pid <> _c").select(F.col("pid").alias("x"), F.col("_c").alias("y"), rank.alias("rank"))

    ids, names = rows.where("kind = 'id'"), rows.where("kind = 'name'")
    dated = rows.where("kind <> 'id' AND lo IS NOT NULL")
    links = star(ids, ids.groupBy("key").agg(F.min("pid").alias("_c")), ["key"], F.lit(3))
    links = links.union(star(names, names.where("lo IS NULL").groupBy("key").agg(F.min("pid").alias("_c")), ["key"], F.lit(2)))
    first = written(dated.groupBy("key", "lo").agg(F.min("pid").alias("_c"), F.max("hi").alias("hi"), F.first("rank").alias("rank")), "years")
    links = links.union(star(dated.select("key", "lo", "pid", F.col("rank").alias("r")), first.select("key", "lo", "_c"), ["key", "lo"], F.col("r")))
    before = F.max(F.struct("hi", "_c")).over(Window.partitionBy("key").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    chain = first.withColumn("b", before).where(F.col("lo") - tolerance <= F.col("b.hi")).select(F.col("_c").alias("x"), F.col("b._c").alias("y"), "rank")
    pairs = links.union(chain).where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("rank").alias("rank"))
    return written(pairs.select("a", "b", F.when(F.col("rank") == 3, "high").otherwise("medium").alias("confidence")), "links")


def clusters(persons: DataFrame, edges: DataFrame) -> DataFrame:
    """pid, cluster (smallest pid), confidence (the strongest edge of the cluster; high for single records)."""
    comp = connected_components(edges)
    best = edges.join(comp, edges["a"] == comp["node"]).groupBy("component").agg(F.max(R.confidence_rank(F.col("confidence"))).alias("rank"))
    label = F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").when(F.col("rank") == 1, "low")
    joined = persons.select("pid").join(comp, F.col("pid") == F.col("node"), "left").join(best, "component", "left")
    return joined.select("pid", F.coalesce("component", "pid").alias("cluster"), F.when(F.col("component").isNull(), "high").otherwise(label).alias("confidence"))


def merge(persons: DataFrame, clustered: DataFrame) -> DataFrame:
    """One record per cluster: longest name, first known attributes, all sources and variants in order, needs_review."""
    rows = persons.join(clustered, "pid")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("pid"))).alias(c)
    surface = F.filter(F.concat(F.array("name"), F.coalesce("variants", F.array().cast("array<string>"))), lambda v: v.isNotNull() & (v != ""))
    all_names = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pid", surface.alias("s")))), lambda x: x["s"])))
    out = rows.groupBy("cluster").agg(
        F.max_by("name", F.struct(F.length(F.coalesce("name", F.lit(""))), -F.col("pid"))).alias("name"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.first("confidence").alias("confidence"),
        *[first(c) for c in ("forename", "surname", "life_dates", *IDS)],
        all_names.alias("variants"),
        F.count("*").alias("n_members"),
    )
    return out.withColumn("needs_review", F.col("confidence").isin("medium", "low") & (F.col("n_members") > 1))


def ranked(merged: DataFrame) -> DataFrame:
    """Best evidence first: confidence, number of sources, members."""
    return merged.orderBy(F.desc(R.confidence_rank(F.col("confidence"))), F.desc(F.size("sources")), F.desc("n_members"), "cluster")
