"""Quality rules with adaptive thresholds, in DataFrame functions only.

One pass computes a few numbers per document. Mergeable quantile sketches of
them per language and source, per language, and overall give the limits in
place of fixed cutoffs: a tail quantile, widened by its distance from the
median. The limits of a source are drawn towards those of its language, and
these towards the overall ones, the more the fewer documents there are; so
groups of all sizes are treated alike. A join on language and source applies
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codexlake.llm.common import text_key
from codexlake.sources.scratch import written

SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: metric: (tail quantile, what the distance from the median is raised by, both sides). The tail lies inside the share of
#: junk that a metric tells from good texts, and far out where it is the same in both.
METRICS = {"symbol_share": (0.9, 0.01, False), "dup_line_share": (0.99, 0.03, False), "repeat_share": (0.99, 0.02, False), "word_length": (0.9, 0.1, True)}
#: Distances beyond the tail that a limit lies, documents that the limits of the next larger group count for, and the sketches' accuracy.
SPREADS, PRIOR_DOCS, ACCURACY = 2, 200, 10_000


def let(value: Column, body) -> Column:
    """body(value) with ``value`` evaluated once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """What ASCII white space separates; null has no words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    window = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = lambda at: F.aggregate(at, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    found = let(F.sort_array(window(words)), lambda s: covered(F.sort_array(F.transform(twice(s), lambda x: x["i"]))))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(found).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, th, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the metrics."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    counts = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text").cast("string")).alias("th"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        counts.alias("c"),
        line_counts.alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    df = df.select("doc_id", "th", "lang", "source", "c.*", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("l.n").alias("n_lines"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return df.select(
        *[c for c in df.columns if c != "n_lines"],
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("word_length"),
    )


def _own_limits(metric: str, sketch: Column, spreads: float) -> list[Column]:
    """Highest (and lowest) value by a group's own quantiles: lower tail, median, upper tail."""
    _, guard, both = METRICS[metric]
    low, middle, high = (sketch[i] for i in range(3))
    out = [(high + spreads * (high - middle + guard)).alias(f"{metric}_max")]
    return out + [(low - spreads * (middle - low + guard)).alias(f"{metric}_min")] * both


def limits(found: DataFrame, spreads: float = SPREADS, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """lang, source and the highest (``_max``) and lowest (``_min``) value each metric may have there.

    From the sketches of the documents that pass the base rule. With n of them
    a group's limits are (n * own + prior_docs * parent) / (n + prior_docs);
    the parent of a source is its language, of a language all documents.
    """
    sketches = [F.percentile_approx(m, [1 - tail, 0.5, tail], ACCURACY).alias(m) for m, (tail, _, _) in METRICS.items()]
    levels = found.where(~F.col("base_failed")).groupingSets([["lang", "source"], ["lang"], []], "lang", "source")
    levels = written(levels.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *sketches), "sketches")
    own = levels.select("level", "lang", "source", "n", *[c for m in METRICS for c in _own_limits(m, F.col(m), spreads)])
    names = own.columns[4:]
    group = lambda level, *keys: own.where(F.col("level") == level).select(*[F.col(k).alias(f"{k}_{level}") for k in keys], *[F.col(c).alias(f"{c}_{level}") for c in ("n", *names)])
    drawn = lambda c, level, parent: F.coalesce((F.col(f"n_{level}") * F.col(f"{c}_{level}") + prior_docs * parent) / (F.col(f"n_{level}") + prior_docs), parent)
    overall = own.where(F.col("level") == 3).select(*names).first()  # one row
    top = {c: F.lit(overall[c] if overall else None).cast("double") for c in names}
    t = found.select("lang", "source").distinct()
    t = t.join(group(1, "lang"), F.col("lang").eqNullSafe(F.col("lang_1")), "left")
    t = t.join(group(0, "lang", "source"), F.col("lang").eqNullSafe(F.col("lang_0")) & F.col("source").eqNullSafe(F.col("source_0")), "left")
    return t.select("lang", "source", *[drawn(c, 0, drawn(c, 1, top[c])).alias(c) for c in names])


def judge(docs: DataFrame, spreads: float = SPREADS, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """features() of each row and ``kept``: false if the base rule fails or a metric lies outside its limits.

    A null text reads as empty and fails the base rule. Null lang or source is
    a group like any other. Repeated rows count as often as they occur. If no
    document passes the base rule there are no limits and none are kept. An
    empty table gives an empty result; other columns are ignored.
    """
    found = written(features(docs), "features")
    t = limits(found, spreads, prior_docs).withColumnsRenamed({"lang": "lang_t", "source": "source_t"})
    inside = F.lit(True)
    for m, (_, _, both) in METRICS.items():
        inside = inside & F.coalesce(F.col(m) <= F.col(f"{m}_max"), F.lit(True))
        if both:
            inside = inside & F.coalesce(F.col(m) >= F.col(f"{m}_min"), F.lit(True))
    joined = found.join(t, F.col("lang").eqNullSafe(F.col("lang_t")) & F.col("source").eqNullSafe(F.col("source_t")), "left")
    return joined.select(*found.columns, (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, all columns as they are."""
    kept = judge(docs, **how).where("kept").select("doc_id", "th", "lang", "source").distinct().hint("shuffle_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (text_key(docs["text"].cast("string")) == kept["th"])
    same = same & docs["lang"].cast("string").eqNullSafe(kept["lang"]) & docs["source"].cast("string").eqNullSafe(kept["source"])
    return docs.join(kept, same, "left_semi")
