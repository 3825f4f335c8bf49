"""Error rates and disagreement between readings."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from codexlake.functions import text as T
from codexlake.functions.edits import edits
from codexlake.sources.parallel import paired
from codexlake.sources.scratch import written

#: Readings of a page that meet as many others at a time.
BLOCK = 16


def prepare(text: Column, ignore_case: bool = True, ignore_whitespace: bool = True, ignore_punctuation: bool = True, fold_abbreviations: bool = False) -> Column:
    if fold_abbreviations:
        text = T.fold_abbreviations(text)
    if ignore_case:
        text = F.lower(text)
    if ignore_whitespace:
        text = T.collapse(text)
    return F.translate(text, string.punctuation, "") if ignore_punctuation else text


def cer(reference: Column, hypothesis: Column, **options: bool) -> Column:
    """Edit distance in code points over the reference's length; an empty reference gives 0 or 1."""
    ref, hyp = prepare(reference, **options), prepare(hypothesis, **options)
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(edits(ref, hyp) / F.length(ref))


def edit_distance(reference: Column, hypothesis: Column, **options: bool) -> Column:
    """Edits between prepared texts; null texts are empty."""
    return edits(*[prepare(F.coalesce(c, F.lit("")), **options) for c in (reference, hypothesis)])


RAW = {"ignore_case": False, "ignore_whitespace": False, "ignore_punctuation": False}


def word_edits(a: list[str], b: list[str], limit: int | None = None) -> int:
    """Edits between two lists of words; limit + 1 as soon as they are known to be more than ``limit``.

    The column of the table that belongs to a word of ``b`` is two bit vectors
    over ``a``, its steps up and down, so a step is a few operations on integers
    of len(a) bits. What both lists begin or end with is left out first.
    """
    begin, end = 0, 0
    most = min(len(a), len(b))
    while begin < most and a[begin] == b[begin]:
        begin += 1
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if limit is not None and abs(len(a) - len(b)) > limit:
        return limit + 1
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, edits = full, 0, len(a)
    for left, y in zip(range(len(b) - 1, -1, -1), b):
        same = places.get(y, 0)
        kept = same | down
        crossed = (((same & up) + up) ^ up) | same
        rise, fall = down | full & ~(crossed | up), up & crossed
        edits += 1 if rise & top else -1 if fall & top else 0
        if limit is not None and edits - left > limit:
            return limit + 1
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(kept | rise)) & full, rise & kept & full
    return edits


def wer(reference: Column, hypothesis: Column, limit: float | None = None) -> Column:
    """Word edits over the reference's words; an empty reference gives 0 or 1, null texts are empty; texts come prepared.

    With a ``limit`` rates beyond it are null, and such texts are left as soon
    as their edits pass it.
    """

    @F.pandas_udf(DoubleType())
    def rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        def one(r, h):
            a, b = (r or "").split(), (h or "").split()
            if not a:
                found = 0.0 if not b else 1.0
                return found if limit is None or found <= limit else None
            most = None if limit is None else int(limit * len(a) + 1e-9)
            edits = word_edits(a, b, most)
            return edits / len(a) if most is None or edits <= most else None

        return pd.Series([one(r, h) for r, h in zip(ref, hyp)], dtype="float64")

    return rate(reference, hypothesis)


def usable(readings: DataFrame, text: str = "text", error: str | None = None) -> DataFrame:
    """Readings with some text and no error."""
    ok = T.collapse(F.coalesce(F.col(text), F.lit(""))) != ""
    return readings.where(ok & (F.coalesce(F.col(error), F.lit("")) == "") if error else ok)


def pairwise_cer(readings: DataFrame, page: list[str], order: str, text: str = "text", **options: bool) -> DataFrame:
    """CER of each pair of a page's usable readings, the earlier one as reference: page, a, b, cer.

    Pairs are few bytes but long work, so a page's readings meet block by block
    in all slots: one with many readings doesn't wait for one task, and a
    reading is sent once per block.
    """
    pairs = _pairs(usable(readings, text).select(*page, F.col(order).alias("o"), F.col(text).alias("t")), page)
    return pairs.select(*page, F.col("a_o").alias("a"), F.col("b_o").alias("b"), cer(F.col("a_t"), F.col("b_t"), **(options or RAW)).alias("cer"))


def _pairs(readings: DataFrame, page: list[str]) -> DataFrame:
    """page, a_o, b_o, a_t, b_t: each pair of a page's readings (page, o, t)."""
    return paired(readings, page, "o", BLOCK)


def max_cer(pairs: DataFrame, page: list[str]) -> DataFrame:
    return pairs.groupBy(*page).agg(F.max("cer").alias("max_cer"), F.count("*").alias("pairs"))


def max_cer_symmetric(readings: DataFrame, page: list[str], order: str, text: str = "text") -> DataFrame:
    """The largest normalised CER in either direction: edits are the same both ways, so they are counted once and the shorter text is the reference."""
    pairs = _pairs(usable(readings, text).select(*page, F.col(order).alias("o"), prepare(F.col(text)).alias("t")), page)
    short, long = F.least(F.length("a_t"), F.length("b_t")), F.greatest(F.length("a_t"), F.length("b_t"))
    rate = F.when(short == 0, F.when(long == 0, 0.0).otherwise(1.0)).otherwise(edits("a_t", "b_t") / short)
    return pairs.select(*page, rate.alias("cer")).groupBy(*page).agg(F.max("cer").alias("max_cer"))


def gate(pages: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Pages to show to a person: two or more readings that differ beyond the threshold."""
    return pages.withColumn("block", F.coalesce(F.col("max_cer"), F.lit(0.0)) > threshold)


def gate_readings(readings: DataFrame, page: list[str], order: str, text: str = "text", threshold: float = 0.15, **options: bool) -> DataFrame:
    """page, block: gate() on the largest pairwise_cer() of pages with a pair, without rating all pairs.

    A text takes at least as many edits as it is longer than an earlier one, so
    lengths alone block pages with readings of unlike lengths, however many
    they have; only the other pages' pairs are rated.
    """
    options = options or RAW
    r = written(usable(readings, text).dropna(subset=[*page, order]).select(*page, F.col(order).alias("o"), F.col(text).alias("t")), "readings")
    sizes = r.groupBy(*page, "o").agg(*[f(F.length(prepare(F.col("t"), **options))).alias(n) for f, n in ((F.min, "short"), (F.max, "long"))])
    before = F.min("short").over(Window.partitionBy(*page).orderBy("o").rowsBetween(Window.unboundedPreceding, -1))
    least = F.when(F.col("before") == 0, F.when(F.col("long") == 0, 0.0).otherwise(1.0)).otherwise((F.col("long") - F.col("before")) / F.col("before"))
    known = sizes.withColumn("before", before).where("before IS NOT NULL").groupBy(*page).agg(F.max(least).alias("max_cer"))
    known = written(known, "bounds")  # small; both kinds of pages need it
    unlike = known.where(F.col("max_cer") > threshold)
    rest = r.join(known.where(F.col("max_cer") <= threshold).select(*page), page, "left_semi")
    rated = max_cer(pairwise_cer(rest, page, "o", "t", **options), page)
    return gate(unlike.unionByName(rated.select(*page, "max_cer")), threshold).select(*page, "block")


def cer_table(readings: DataFrame, references: DataFrame, key: list[str], engine: str, order: str, text: str = "text", reference: str = "reference", **options: bool) -> DataFrame:
    """key, engine, ord, cer of each reading against its document's reference."""
    joined = readings.join(references, key)
    return joined.select(*key, F.col(engine).alias("engine"), F.col(order).alias("ord"), cer(F.col(reference), F.col(text), **options).alias("cer"))


def best_engine(table: DataFrame, key: list[str]) -> DataFrame:
    """The engine of lowest CER per document; the first of equals."""
    return table.groupBy(*key).agg(F.min_by("engine", F.struct("cer", "ord")).alias("best_engine"), F.min("cer").alias("best_cer"))


def engine_means(table: DataFrame, key: list[str]) -> DataFrame:
    """Mean CER per engine over all documents of the table; one without the engine counts as 0."""
    n_docs = table.select(*key).distinct().count()
    return table.groupBy("engine").agg((F.sum("cer") / F.lit(n_docs)).alias("mean_cer"))


def mean_rates(rows: DataFrame, group: list[str], reference: str = "reference", text: str = "text", **options: bool) -> DataFrame:
    """Mean CER and WER per group over its rows, and their number."""
    ref, hyp = (prepare(F.coalesce(F.col(c), F.lit("")), **options) for c in (reference, text))
    rated = rows.select(*group, cer(F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(text), F.lit("")), **options).alias("cer"), wer(ref, hyp).alias("wer"))
    return rated.groupBy(*group).agg(F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"), F.count("*").alias("n"))


def fusion_gain(table: DataFrame, fused: DataFrame, key: list[str], text: str = "fused", reference: str = "reference", **options: bool) -> DataFrame:
    """key, best_cer, fused_cer, fusion_beats_best: whether the fused text is nearer to the reference than any engine's; null without one."""
    own = fused.select(*key, F.when(F.coalesce(F.col(text), F.lit("")) != "", cer(F.col(reference), F.col(text), **options)).alias("fused_cer"))
    return best_engine(table, key).join(own, key, "left").select(*key, "best_cer", "fused_cer", (F.col("fused_cer") < F.col("best_cer")).alias("fusion_beats_best"))


def page_quality(table: DataFrame, key: list[str]) -> DataFrame:
    """Mean of 1 - CER, clamped to 0..1."""
    return table.groupBy(*key).agg(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("cer")))).alias("qa_score"))


def require_independent(references: DataFrame, status: str) -> DataFrame:
    """Fails on references that are editorial selections; accuracy can't be measured against them."""
    bad = F.col(status) == "revisable_editorial_choice"
    return references.where(F.when(bad, F.raise_error(F.lit("an editorial selection is no independent reference"))).otherwise(F.lit("")).cast("string") == "")


def char_offsets(tokens: DataFrame, key: list[str], pos: str, token: str) -> DataFrame:
    """Offset of each token: lengths plus blanks of those before it."""
    before = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("chars_start", F.coalesce(F.sum(F.length(token) + 1).over(before), F.lit(0)).cast("long"))
