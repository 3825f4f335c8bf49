"""Alignment and voting over several readings of a page."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codexlake.operators import metrics as M
from codexlake.sources.parallel import spread
from codexlake.sources.scratch import written


_MERGED = "struct<merged:string,agreement:double,equal_lines:int>"


def _laid_beside(pivot: pd.Series, other: pd.Series, with_inserts: pd.Series) -> pd.Series:
    """For each word of the pivot what the other reading has there.

    Between two runs of equal words the other reading's words lie at the first
    of the pivot's words there. If the pivot has none there, they join the place
    before if ``with_inserts``; before the first word they are dropped.
    """
    out = []
    for own, text, inserts in zip(pivot, other, with_inserts):
        words, theirs = own.split(), text.split()
        at: list[list[str]] = [[] for _ in words]
        place = taken = 0
        for run in difflib.SequenceMatcher(None, words, theirs, autojunk=False).get_matching_blocks():
            target = place if run.a > place else place - 1 if inserts else -1
            if target >= 0:
                at[target] += theirs[taken : run.b]
            for k in range(run.size):
                at[run.a + k].append(theirs[run.b + k])
            place, taken = run.a + run.size, run.b + run.size
        out.append([" ".join(x) for x in at])
    return pd.Series(out)


def _places(readings: DataFrame, page: list[str], label: str, order: str, text: str, with_inserts: bool) -> DataFrame:
    """page, _label, _order, _own, idx, token: what each usable reading has at each place of the longest one, which is ``_own``.

    Partitioned by page, so what groups by page and place needs no shuffle.
    """
    r = spread(M.usable(readings, text).select(*page, F.col(label).cast("string").alias("_label"), F.col(order).alias("_order"), F.col(text).alias("_text")), *page)
    r = r.groupBy(*page, "_label").agg(F.min("_order").alias("_order"), F.min_by("_text", "_order").alias("_text"))
    n_words = F.size(F.filter(F.split("_text", r"(?U)\s+"), lambda w: w != ""))
    longest = r.groupBy(*page).agg(F.min_by(F.struct("_label", "_order", "_text"), F.struct(-n_words, "_order")).alias("_p"))
    both = r.join(longest, page).withColumn("_own", F.col("_order") == F.col("_p._order"))
    beside = both.select(*page, "_label", "_order", "_own", F.pandas_udf(_laid_beside, "array<string>")("_p._text", "_text", F.lit(with_inserts)).alias("_t"))
    # outer: else a filter on the array's size is inferred, which lays the readings beside each other a second time
    return beside.select(*page, "_label", "_order", "_own", F.posexplode_outer("_t").alias("idx", "token")).where("idx IS NOT NULL")


def align(readings: DataFrame, page: list[str], label: str, order: str, text: str = "text", with_inserts: bool = True) -> DataFrame:
    """page, idx, token, chars_start, readings (label -> token) per place of the longest reading (the first of equals).

    Each other reading is laid beside the longest one on its own; a place's
    readings meet by grouping, the longest one's first, then in order. Of
    several readings with one label the first counts.
    """
    places = _places(readings, page, label, order, text, with_inserts)
    met = F.array_sort(F.collect_list(F.struct((~F.col("_own")).alias("later"), F.col("_order").alias("o"), F.col("_label").alias("l"), F.col("token").alias("t"))))
    columns = places.groupBy(*page, "idx").agg(F.map_from_entries(F.transform(met, lambda x: F.struct(x["l"], x["t"]))).alias("readings"), F.max(F.when(F.col("_own"), F.col("token"))).alias("token"))
    return M.char_offsets(columns, page, "idx", "token").select(*page, "idx", "token", "chars_start", "readings")


def voted_words(readings: DataFrame, page: list[str], label: str, order: str, text: str = "text") -> DataFrame:
    """page, voted, contested: what vote() chooses at all places of align(), as a text, and how many places have no majority.

    Words are counted per place before anything is collected, so a page may
    have any number of readings; a group holds the words of one text.
    """
    places = _places(readings, page, label, order, text, True)
    counted = places.groupBy(*page, "idx", "token").agg(F.count("*").alias("n"), F.min(F.struct(~F.col("_own"), "_order")).alias("first"))
    chosen = counted.groupBy(*page, "idx").agg(F.min_by("token", F.struct(-F.col("n"), "first")).alias("choice"), (2 * F.max("n") <= F.sum("n")).alias("contested"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("choice") != "", F.struct("idx", "choice")))), lambda x: x["choice"]), " ")
    return chosen.groupBy(*page).agg(words.alias("voted"), F.count_if("contested").alias("contested"))


def vote(columns: DataFrame) -> DataFrame:
    """token chosen, n_backers, n_present, contested: a strict majority of the readings present wins.

    An omission counts as a reading. Without a majority the most frequent
    reading (the first in label order) is the fallback.
    """
    counted = F.transform(F.array_distinct(F.map_values("readings")), lambda v: F.struct(F.size(F.filter(F.map_values("readings"), lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit("").alias("v")), lambda acc, x: F.when(x["n"] > acc["n"], x).otherwise(acc))
    out = columns.withColumn("_best", best).withColumn("n_present", F.size("readings"))
    out = out.withColumn("n_backers", F.col("_best.n")).withColumn("choice", F.col("_best.v"))
    contested = F.col("n_backers") * 2 <= F.col("n_present")
    source = F.when(contested, "fallback").when(F.col("n_backers") == F.col("n_present"), "consensus").otherwise("vote")
    return out.withColumn("contested", contested).withColumn("source", source).drop("_best")


def with_context(votes: DataFrame, page: list[str], width: int = 3) -> DataFrame:
    """The up to three decided words before each place."""
    w = Window.partitionBy(*page).orderBy("idx").rowsBetween(-width, -1)
    decided = F.when(~F.col("contested") & (F.col("choice") != ""), F.col("choice"))
    return votes.withColumn("context", F.array_join(F.collect_list(decided).over(w), " "))


def arbitrate(votes: DataFrame, choices: DataFrame, page: list[str]) -> DataFrame:
    """Decisions (page, idx, decided) of an outside judge for contested places; an empty one drops the word."""
    j = votes.join(choices.select(*page, "idx", "decided"), [*page, "idx"], "left")
    taken = F.col("contested") & F.col("decided").isNotNull()
    return j.withColumn("choice", F.when(taken, F.col("decided")).otherwise(F.col("choice"))).withColumn("source", F.when(taken, "judge").otherwise(F.col("source"))).drop("decided")


def spans(votes: DataFrame, page: list[str]) -> DataFrame:
    """Runs of consecutive words from the same source: page, span, source, text."""
    w = Window.partitionBy(*page).orderBy("idx")
    words = votes.where("choice <> ''").withColumn("new", F.coalesce((F.col("source") != F.lag("source").over(w)).cast("int"), F.lit(1)))
    words = words.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "choice"))), lambda x: x["choice"]), " ")
    return words.groupBy(*page, "span").agg(F.first("source").alias("source"), joined.alias("text"))


def fuse(readings: DataFrame, page: list[str], label: str, order: str, text: str = "text", confidence: Column | None = None, no_merge_cer: float = 0.35) -> DataFrame:
    """page, n_candidates, strategy, fused, contested, max_cer (null for one reading).

    One reading is taken as it is. Above ``no_merge_cer`` nothing is blended:
    the reading of highest confidence (the first of equals) is taken whole.
    Otherwise the readings are aligned and voted on word by word.
    """
    r = M.usable(readings, text)
    conf = F.lit(0.0) if confidence is None else confidence
    best = r.groupBy(*page).agg(F.count("*").alias("n_candidates"), F.max_by(text, F.struct(conf, -F.col(order))).alias("best"))
    worst = M.max_cer(M.pairwise_cer(readings, page, order, text), page).select(*page, "max_cer")
    pages = best.join(worst, page, "left").withColumn("strategy", F.when(F.col("n_candidates") == 1, "single").when(F.col("max_cer") > no_merge_cer, "no-merge").otherwise("vote"))
    pages = written(pages, "pages")  # what follows names it twice, and the error rates are the dear part
    fused = voted_words(r.join(pages.where("strategy = 'vote'").select(*page), page, "left_semi"), page, label, order, text)
    return pages.join(fused, page, "left").select(*page, "n_candidates", "strategy", F.coalesce("voted", "best").alias("fused"), F.coalesce("contested", F.lit(0)).alias("contested"), "max_cer")


def disagreements(readings: DataFrame, page: list[str], label: str, order: str, text: str = "text") -> DataFrame:
    """Places with more than one distinct non-empty reading; inserted words are left out."""
    found = F.filter(F.array_distinct(F.map_values("readings")), lambda v: v != "")
    return align(readings, page, label, order, text, with_inserts=False).where(F.size(found) > 1)


def _merge_lines(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """The first text, with the lines that only the second has more of between two runs of equal lines, after a mark with their number."""
    rows = []
    for a, b in zip(first, second):
        own, other = (a or "").split("\n"), (b or "").split("\n")
        out: list[str] = []
        equal = done = seen = 0
        for run in difflib.SequenceMatcher(None, own, other).get_matching_blocks():
            surplus = other[seen + run.a - done : run.b]
            out += own[done : run.a] + ([f"[+{len(surplus)}]", *surplus] if surplus else []) + own[run.a : run.a + run.size]
            equal, done, seen = equal + run.size, run.a + run.size, run.b + run.size
        rows.append({"merged": "\n".join(out), "agreement": equal / max(len(own), 1), "equal_lines": equal})
    return pd.DataFrame(rows)


def reconcile(pairs: DataFrame, first: str, second: str, agree: float = 0.95) -> DataFrame:
    """Two readings into one: an empty side gives way, near equality keeps the first, else a merge by lines with marked additions."""
    a, b = F.coalesce(F.col(first), F.lit("")), F.coalesce(F.col(second), F.lit(""))
    out = pairs.withColumn("_m", F.pandas_udf(_merge_lines, _MERGED)(a, b))
    method = F.when(F.trim(a) == "", "second only").when(F.trim(b) == "", "first only").when(F.col("_m.agreement") >= agree, "agreement").otherwise("merge")
    text = F.when(F.trim(a) == "", b).when(F.trim(b) == "", a).when(F.col("_m.agreement") >= agree, a).otherwise(F.col("_m.merged"))
    only = lambda x, y: F.filter(F.split(x, "\n"), lambda line: (line != "") & ~F.array_contains(F.split(y, "\n"), line))
    return out.withColumn("method", method).withColumn("reconciled", text).withColumn("agreement", F.col("_m.agreement")).withColumn("first_only", only(a, b)).withColumn("second_only", only(b, a)).drop("_m")


def both_passes(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Readings of two passes as a set over ``by``: those of the second that the first has too are left out. Adds ``pass_no``."""
    both = first.withColumn("pass_no", F.lit(1)).unionByName(second.withColumn("pass_no", F.lit(2)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in by]
    kept = both.groupBy(*by).agg(F.min_by(F.struct(*rest), "pass_no").alias("_r"))
    return kept.select(*by, "_r.*").select(*both.columns)


def stacked_lines(readings: DataFrame, page: list[str], order: str, text: str = "text", n_lines: int = 100) -> DataFrame:
    """Three and more readings without a judge: the first ``n_lines`` trimmed lines with text of all readings in order, as page, reconciled, method."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\R"), M.T.strip), lambda x: x != "")
    few = readings.select(*page, F.col(order).alias("o"), F.slice(lines, 1, n_lines).alias("lines"))
    stacked = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "lines"))), lambda x: x["lines"]))
    return few.groupBy(*page).agg(F.array_join(F.slice(stacked, 1, n_lines), "\n").alias("reconciled"), F.lit("merge_fallback").alias("method"))


def join_pages(pages: DataFrame, doc: str, name: Column, text: str = "text") -> DataFrame:
    """Pages in natural order as one text with a header per page."""
    from codexlake.functions.rules import natural_key

    part = F.struct(natural_key(name).alias("k"), name.alias("n"), F.col(text).alias("t"))
    return pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.concat(F.lit("--- "), x["n"], F.lit(" ---\n"), F.coalesce(x["t"], F.lit("")))), "\n\n").alias("text"))


def closest_names(names: DataFrame, query: str, n: int = 3, cutoff: float = 0.5) -> DataFrame:
    """The names most like the query by matching blocks (ratio), best first."""

    @F.pandas_udf("double")
    def ratio(s: pd.Series) -> pd.Series:
        m = difflib.SequenceMatcher()
        m.set_seq2(query)

        def one(x):
            m.set_seq1(x)
            return m.ratio() if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff else 0.0

        return s.map(one)

    return names.withColumn("ratio", ratio("name")).where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), F.desc("name")).limit(n)



def suggest_ids(names: DataFrame, query: str, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """The ids most like the query; if none is, the first in order that hold it or lie in it, upper and lower case alike."""
    alike = closest_names(names, query, n, cutoff).withColumn("way", F.lit(1))
    q, own = F.lit(query.lower()), F.lower("name")
    inside = names.where(F.contains(own, q) | F.contains(q, own)).orderBy("name").limit(n)
    both = alike.unionByName(inside.withColumn("ratio", F.lit(0.0)).withColumn("way", F.lit(2)), allowMissingColumns=True)  # 2n rows
    first = both.agg(F.min("way").alias("way"))
    return both.join(first, "way").drop("way").orderBy(F.desc("ratio"), "name")
