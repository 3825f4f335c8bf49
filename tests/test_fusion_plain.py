"""Fusion against plain versions on the readings of the driver's conversations and on random texts."""

import difflib
import random

from pyspark.sql import functions as F

from codexlake.operators import fusion, metrics
from codexlake.plans import queries

SF = "/root/testdata/sf0.001"


def laid(pivot, other, inserts=True):
    """Places by opcodes: what the other reading has for each word of the pivot."""
    at = [[] for _ in pivot]
    for kind, lo, hi, a, b in difflib.SequenceMatcher(None, pivot, other, autojunk=False).get_opcodes():
        if kind == "equal":
            for k in range(hi - lo):
                at[lo + k].append(other[a + k])
        elif kind == "replace":
            at[lo] += other[a:b]
        elif kind == "insert" and inserts and lo > 0:
            at[lo - 1] += other[a:b]
    return [" ".join(x) for x in at]


def columns(texts, inserts=True):
    """Per place the readings in order, the longest first."""
    words = [t.split() for t in texts]
    own = max(range(len(words)), key=lambda i: (len(words[i]), -i))
    rest = [laid(words[own], w, inserts) for i, w in enumerate(words) if i != own]
    return words[own], list(zip(words[own], *rest))


def fused(texts, no_merge=float("inf")):
    rates = [metrics.word_edits(list(a), list(b)) / len(a) for i, a in enumerate(texts) for b in texts[i + 1 :]]
    if len(texts) == 1 or max(rates) > no_merge:
        return texts[0], 0
    out, contested = [], 0
    for place in columns(texts)[1]:
        best = max(dict.fromkeys(place), key=place.count)
        out.append(best)
        contested += 2 * place.count(best) <= len(place)
    return " ".join(w for w in out if w), contested


def conversations(spark):
    found = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        if (r.text or "").strip():
            found.setdefault(r.conv_id, []).append(r.text)
    return found


def test_fuse_votes(spark):
    want = {k: fused(v, 2.0) for k, v in conversations(spark).items()}
    got = {r.conv_id: (r.fused, r.contested) for r in queries.fuse_votes(spark, SF).collect()}
    assert got == want and any(n for _, n in want.values())


def test_disagreement_spans(spark):
    want = set()
    for k, texts in conversations(spark).items():
        own, places = columns(texts, inserts=False)
        start = 0
        for i, place in enumerate(places):
            if len({v for v in place if v}) > 1:
                want.add((k, i, own[i], start, len(place)))
            start += len(own[i]) + 1
    assert {(r.conv_id, r.idx, r.token, r.chars_start, r.n_readings) for r in queries.disagreement_spans(spark, SF).collect()} == want


def test_votes_of_many_readings(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["a", "b", "c", "dd"]) for _ in range(draw.randrange(1, 30))) for _ in range(40)]
    df = spark.createDataFrame([(i % 4, i, f"e{i}", t) for i, t in enumerate(texts)], "page int, ord int, engine string, text string")
    got = {r.page: (r.voted, r.contested) for r in fusion.voted_words(df, ["page"], "engine", "ord").collect()}
    assert got == {p: fused([t for i, t in enumerate(texts) if i % 4 == p]) for p in range(4)}
    same = fusion.vote(fusion.align(df, ["page"], "engine", "ord")).groupBy("page").agg(F.count_if("contested").alias("n")).collect()
    assert {r.page: r.n for r in same} == {p: n for p, (_, n) in got.items()}


def merged(a, b):
    """Own lines in order; where the other has more lines than the own ones it stands for, the surplus follows a mark."""
    out, equal = [], 0
    for kind, lo, hi, at, to in difflib.SequenceMatcher(None, a, b).get_opcodes():
        out += a[lo:hi]
        equal += hi - lo if kind == "equal" else 0
        more = b[at + hi - lo : to] if kind in ("replace", "insert") else []
        out += [f"[+{len(more)}]", *more] if more else []
    return "\n".join(out), equal


def test_merged_lines(spark):
    draw = random.Random(3)
    text = lambda: [draw.choice(["x", "y", "z", "a long line", ""]) for _ in range(draw.randrange(1, 12))]
    pairs = [(text(), text()) for _ in range(300)]
    found = fusion._merge_lines([("\n".join(a)) for a, _ in pairs], ["\n".join(b) for _, b in pairs])
    assert [(r.merged, r.equal_lines) for r in found.itertuples()] == [merged(a, b) for a, b in pairs]
