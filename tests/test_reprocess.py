"""Incremental work against full recomputation."""

import pytest
from pyspark.sql import functions as F

from codexlake.streaming import reprocess as rp, state
from codexlake.streaming.tables import StateTable


def runner(fails="false"):
    return lambda docs: docs.select("doc_id", F.lit("made").alias("artifact"), F.when(F.expr(fails), "broken").alias("error"))


RUNNERS = {s: runner() for s in ("model_select", "reconcile", "agent_b", "agent_c")} | {"kraken": runner("doc_id LIKE 'bad%'")}
REQUEST = "doc_id string, field string, stage string"


def done(spark, *docs):
    return state.new_states(spark.createDataFrame([(d,) for d in docs], "doc_id string")).withColumn("status", F.lit("done"))


def test_reprocess_runs_only_what_the_change_touches(spark):
    states = done(spark, "a", "b", "bad", "other")
    asked = spark.createDataFrame([("a", "script", None), ("b", None, "agent_c"), ("bad", "lang", None), ("gone", "lang", None), (None, "lang", None), ("b", None, "no stage")], REQUEST)
    after, artifacts, report = rp.reprocess(states, asked, RUNNERS)
    got = {r.doc_id: (r.ran, r.errors, r.published) for r in report.collect()}
    assert got == {"a": (["agent_b", "model_select", "kraken", "reconcile"], [], True), "b": (["agent_c"], [], True), "bad": (["agent_b", "model_select", "kraken"], ["kraken"], False)}
    assert {r.doc_id: r.skipped for r in report.collect()}["a"] == ["vlm", "agent_c", "agent_d"]
    stale = {(r.doc_id, r.stage) for r in after.where("stale").collect()}
    assert stale == {("bad", "agent_d")}
    assert {(r.doc_id, r.stage) for r in artifacts.collect()} == {("a", s) for s in ("agent_b", "model_select", "kraken", "reconcile")} | {("b", "agent_c"), ("bad", "agent_b"), ("bad", "model_select")}
    with pytest.raises(Exception, match="unknown field"):
        rp.force(states, spark.createDataFrame([("a", "colour", None)], REQUEST)).collect()


def test_resume_pending(spark):
    states = done(spark, "full").unionByName(state.new_states(spark.createDataFrame([("part",)], "doc_id string")))
    _, _, report = rp.resume_pending(states, RUNNERS)
    assert [(r.doc_id, r.ran, r.published) for r in report.collect()] == [("part", ["agent_b", "model_select", "kraken", "reconcile", "agent_c"], True)]
    _, _, report = rp.resume_pending(states, RUNNERS, spark.createDataFrame([("full",)], "doc_id string"))
    assert [(r.doc_id, r.ran, r.published) for r in report.collect()] == [("full", [], False)]
    _, _, report = rp.resume_pending(states.limit(0), RUNNERS)
    assert report.collect() == []


def test_watched_folder(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "states"), rp.STATES, ["doc_id", "stage"], "version")
    seen = []
    step = rp.watching(table, RUNNERS, lambda report, n: seen.append({r.doc_id: (r.action, len(r.ran)) for r in report.collect()}))
    rows = lambda *x: spark.createDataFrame(x, "doc_id string, field string, ord long")
    step(rows(("a", None, 1), ("a", "lang", 2), ("bad", None, 3), (None, None, 4)), 0)
    step(rows(("a", "script", 5), ("new", None, 6)), 1)
    before = sorted(map(tuple, table.read().collect()))
    step(rows(("a", "script", 5), ("new", None, 6)), 1)  # replayed
    assert sorted(map(tuple, table.read().collect())) == before
    step(rows(("a", None, 7)), 2)
    assert seen == [{"a": ("run", 5), "bad": ("run", 3)}, {"a": ("reprocess", 4), "new": ("run", 5)}, {"a": ("reprocess", 5)}]
    got = {(r.doc_id, r.stage): (r.status, r.version) for r in table.read().collect()}
    assert len(got) == 3 * len(state.STAGES) and got["a", "kraken"] == ("done", 7) and got["bad", "kraken"] == ("error", 3) and got["bad", "reconcile"] == ("pending", 3)


def test_orders(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "order_id string")
    pages = spark.createDataFrame([("o1", "p"), ("o1", "q"), ("o2", "p"), ("o4", "p"), ("unasked", "p")], "order_id string, page string")

    def process(row):
        if row["order_id"] == "o4":
            raise ValueError("no ink")
        return "ok"

    outcomes, ledger = rp.run_orders(ids("o1", "o2", "o3", "o4", "o4", None), pages, ids("o2", "old"), process)
    assert {(r.order_id, r.outcome, r.n_pages, r.error) for r in outcomes.collect()} == {("o1", "done", 2, None), ("o2", "skipped", 1, None), ("o3", "empty", 0, None), ("o4", "errors", 1, "no ink")}
    assert {r.order_id for r in ledger.collect()} == {"o1", "o2", "old"}
    outcomes, _ = rp.run_orders(ids("o2"), pages, ids("o2"), process, again=True)
    assert [(r.order_id, r.outcome) for r in outcomes.collect()] == [("o2", "done")]


def test_second_passes_shrink_to_the_full_rerun(spark):
    criteria = spark.createDataFrame([(i, i % 7 if i % 5 else None, "de" if i % 2 else None) for i in range(40)], "doc_id long, century int, lang string")

    def derive(rows):  # halves the century; forgets the language
        return rows.select("doc_id", F.floor(F.col("century") / 2).cast("int").alias("century"), F.lit(None).cast("string").alias("lang"), F.concat_ws("/", "century", "lang").alias("text"))

    got, sizes = rp.rerun_until_stable(criteria, derive)
    assert sizes == sorted(sizes, reverse=True) and len(sizes) > 2 and sizes[-1] < sizes[0]
    want = {}
    for r in criteria.collect():
        c, lang = r.century, r.lang
        if c is None and lang is None:
            continue
        for n in range(1, 11):
            new = c // 2 if c is not None else None
            text = "/".join(str(x) for x in (c, lang) if x is not None)
            c, changed = (new, new != c) if new is not None else (c, False)
            want[r.doc_id] = (c, lang, text, n)
            if not changed:
                break
    assert {r.doc_id: (r.century, r.lang, r.text, r["round"]) for r in got.collect()} == want
    empty, sizes = rp.rerun_until_stable(criteria.limit(0), derive)
    assert empty.collect() == [] and sizes == []
    assert rp.rerun_until_stable(criteria, derive, rounds=1)[1] == [len(want)]
