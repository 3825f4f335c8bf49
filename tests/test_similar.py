"""Similarity and containment joins against all pairs."""

import difflib
import random

import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codexlake.operators import metrics, similar


def frame(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def names(n, seed):
    draw = random.Random(seed)
    parts = ["anna", "berta", "von", "thun", "urbar", "1450", "missive", "ä", "zoll-", "rat "]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 6))) for _ in range(n)] + ["", "a", "aa", "aaaa", None, "\U0001d54f"]


def ratio(q, x):
    m = difflib.SequenceMatcher()
    m.set_seq2(q)
    m.set_seq1(x)
    return m.ratio()


def test_all_pairs(spark):
    own, asked = names(150, 1), names(40, 2) + ["urbar_1450x", "xyz"]
    for cutoff in (0.5, 0.6, 0.85, 1.0):
        got = {(r.query, r.name): r.ratio for r in similar.similar_names(frame(spark, asked, "query"), frame(spark, own, "name"), cutoff).collect()}
        want = {(q, x): ratio(q, x) for q in set(asked) - {None} for x in set(own) - {None} if ratio(q, x) >= cutoff}
        assert got == want, cutoff
    best = similar.closest_of_each(frame(spark, asked, "query"), frame(spark, own, "name"), 3, 0.5).collect()
    by = {}
    for r in best:
        by.setdefault(r.query, {})[r.rank] = r.name
    for q in set(asked) - {None}:
        want = difflib.get_close_matches(q, [x for x in set(own) if x is not None], 3, 0.5)
        assert [by.get(q, {}).get(i + 1) for i in range(len(want))] == want and len(by.get(q, {})) == len(want)


def test_suggestions_fall_back_to_what_holds_the_query(spark):
    own = ["order-thun-1450b", "a-very-long-identifier-MAP-of-a-document", "other"]
    got = {(r.query, r["rank"], r.name) for r in similar.suggest_of_each(frame(spark, ["order-thun-145b", "map-", "nothing", ""], "query"), frame(spark, own, "name")).collect()}
    assert got == {("order-thun-145b", 1, own[0]), ("map-", 1, own[1])}
    assert similar.suggest_of_each(frame(spark, [], "query"), frame(spark, own, "name")).collect() == []


def test_holders(spark):
    texts, needles = names(120, 3), names(30, 4) + ["ann", "x", "urbarurb"]
    for size in (2, 4):
        got = sorted((r.needle, r.text) for r in similar.holders(frame(spark, needles, "needle"), frame(spark, texts, "text"), size).collect())
        assert got == sorted((n, t) for n in set(needles) if n for t in set(texts) if t is not None and n in t)
    assert similar.holders(frame(spark, ["", None], "needle"), frame(spark, texts, "text")).collect() == []


def plain(a, b):
    row = list(range(len(a) + 1))
    for i, y in enumerate(b, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(a, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90), st.integers(0, 40))
def test_word_edits(a, b, limit):
    want = plain(a, b)
    assert metrics.word_edits(a, b) == want
    assert metrics.word_edits(a, b, limit) == min(want, limit + 1)


def test_word_error_rate(spark):
    draw = random.Random(5)
    long = [str(draw.randrange(300)) for _ in range(10_000)]
    other = [w for w in long if draw.random() > 0.1] + ["x"] * 50
    rows = [("a b c d", "a b x d"), (None, None), ("", "a"), ("a", None), (" ".join(long), " ".join(other))]
    df = spark.createDataFrame(rows, "r string, h string")
    got = [r.w for r in df.select(metrics.wer(F.col("r"), F.col("h")).alias("w")).collect()]
    assert got[:4] == [0.25, 0.0, 1.0, 1.0] and 0.1 < got[4] < 0.13
    assert [r.w for r in df.select(metrics.wer(F.col("r"), F.col("h"), 0.1).alias("w")).collect()] == [None, 0.0, None, None, None]


def test_closest_compares_few_of_many_alike(spark, monkeypatch):
    """Names that are all alike: the n best are those of brute force, and letters rule most pairs out before a comparison."""
    draw = random.Random(7)
    own = sorted({f"{draw.choice(['large', 'hot', 'blue'])} {draw.choice(['ring', 'bolt'])} Brand#{draw.randrange(25)} {draw.choice(['PROMO', 'SMALL'])} {draw.randrange(97)}" for _ in range(900)}) + ["", "ä" * 300, "ä" * 250 + "b" * 50]
    asked = [x[:3] + x[4:] for x in own[::30]] + ["", "ä" * 299]
    compared, real = spark.sparkContext.accumulator(0), similar._ratio

    def counted(cutoff):
        plain_ratio = real(cutoff).func

        def each(queries: pd.Series, names: pd.Series) -> pd.Series:
            compared.add(len(queries))
            return plain_ratio(queries, names)

        return F.pandas_udf(each, "double")

    monkeypatch.setattr(similar, "_ratio", counted)
    got = {}
    for r in similar.closest_of_each(frame(spark, asked, "query"), frame(spark, own, "name"), 5, 0.5).collect():
        got[r.query, r["rank"]] = (r.name, r.ratio)
    want = {(q, i + 1): (x, ratio(q, x)) for q in asked for i, x in enumerate(difflib.get_close_matches(q, own, 5, 0.5))}
    assert got == want
    assert compared.value < len(asked) * len(own) / 4, compared.value
