"""Incremental work: which documents and stages run again, and what came of it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codexlake.operators import providers
from codexlake.operators.feedback import latest
from codexlake.sources.scratch import written
from codexlake.streaming import state
from codexlake.streaming.tables import StateTable

#: What a table of stage states holds.
STATES = "doc_id string, nth int, stage string, status string, stale boolean, version long"
Runner = Callable[[DataFrame], DataFrame]


def with_action(arrivals: DataFrame, states: DataFrame, key: str = "doc_id") -> DataFrame:
    """The arrivals with action: ``run`` for documents without a state, ``reprocess`` for the others."""
    known = states.select(F.col(key)).distinct().withColumn("_k", F.lit(True))
    return arrivals.join(known, key, "left").withColumn("action", F.when(F.col("_k"), "reprocess").otherwise("run")).drop("_k")


def force(states: DataFrame, requests: DataFrame) -> DataFrame:
    """States after requests (doc_id, field, stage): a field makes its stages dirty or stale, a named stage becomes dirty.

    Unknown fields are errors; stages and documents without a state are passed over.
    """
    fields = requests.where("doc_id IS NOT NULL AND field IS NOT NULL").select("doc_id", "field", F.lit(None).cast("long").alias("ord"))
    named = requests.where("doc_id IS NOT NULL AND stage IS NOT NULL").select("doc_id", "stage").distinct().withColumn("_n", F.lit(True))
    out = state.invalidate(states, fields).join(named, ["doc_id", "stage"], "left")
    return out.withColumn("status", F.when(F.col("_n"), state.DIRTY).otherwise(F.col("status"))).select(*states.columns)


def rerun(states: DataFrame, runners: dict[str, Runner]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, artifacts, report) after the open stages that have a runner ran in order, each document up to its first error.

    report: doc_id, ran, skipped, errors (arrays of stages in order), published:
    something ran and nothing failed, so the document is exported and published
    anew. Documents without an open stage are reported with nothing run.
    """
    before = written(states, "states")
    after, artifacts = state.resume(before, runners, stop_on_error=True)
    if artifacts is not None:
        artifacts = written(artifacts, "artifacts")
    after = written(after, "states")
    was = before.select("doc_id", "stage", F.col("status").alias("_b"))
    both = after.join(was, ["doc_id", "stage"])
    ran = F.col("_b").isin(state.PENDING, state.DIRTY) & F.col("status").isin(state.DONE, state.ERROR)
    stages = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("nth", "stage")))), lambda x: x["stage"])  # noqa: E731  one row per stage of a document
    report = both.groupBy("doc_id").agg(stages(ran).alias("ran"), stages(~ran).alias("skipped"), stages(ran & (F.col("status") == state.ERROR)).alias("errors"))
    return after, artifacts, report.withColumn("published", (F.size("ran") > 0) & (F.size("errors") == 0))


def reprocess(states: DataFrame, requests: DataFrame, runners: dict[str, Runner]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rerun() of just the documents that are asked for (doc_id, field, stage)."""
    asked = states.join(requests.select("doc_id").distinct(), "doc_id", "left_semi")
    return rerun(force(asked, requests), runners)


def resume_pending(states: DataFrame, runners: dict[str, Runner], docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rerun() of the documents with an open stage, or of ``docs`` (doc_id)."""
    chosen = docs if docs is not None else state.to_run(states)
    return rerun(states.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi"), runners)


def watching(table: StateTable, runners: dict[str, Runner], reports: Callable[[DataFrame, int], None] | None = None):
    """A foreachBatch function for arrivals (doc_id, field, ord) in a watched folder.

    A new document gets all stages and runs; a known one has the stages of its
    field made dirty (all stages if it names none, as its source changed) and
    runs again. The states go into the table as one version, so a batch that is
    replayed does nothing; a row's version is the highest ``ord`` of its
    document in the batch that touched it. Of several arrivals of a document
    and field the last counts.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= table.last_batch("watch"):
            return
        arrivals = written(batch.where("doc_id IS NOT NULL").groupBy("doc_id", "field").agg(F.max("ord").alias("ord")), "arrivals")
        states = table.read().join(arrivals.select("doc_id").distinct(), "doc_id", "left_semi")
        chosen = written(with_action(arrivals, states), "actions")
        new = state.new_states(chosen.where("action = 'run'"))
        again = chosen.where("action = 'reprocess'")
        asked = again.where("field IS NOT NULL").select("doc_id", "field", F.lit(None).cast("string").alias("stage"))
        whole = again.where("field IS NULL").select("doc_id", F.lit(None).cast("string").alias("field"), F.explode(F.array(*map(F.lit, state.STAGES))).alias("stage"))
        after, artifacts, report = rerun(force(states, asked.unionByName(whole)).unionByName(new), runners)
        at = arrivals.groupBy("doc_id").agg(F.max("ord").alias("_o"))
        rows = after.join(at, "doc_id").withColumn("version", F.greatest("version", F.col("_o").cast("long"))).drop("_o")
        table.merge(rows, batch_id, "watch")
        if reports:
            reports(report.join(chosen.groupBy("doc_id").agg(F.first("action").alias("action")), "doc_id"), batch_id)

    return run


def run_orders(orders: DataFrame, pages: DataFrame, ledger: DataFrame, process: Callable[[dict], str], again: bool = False) -> tuple[DataFrame, DataFrame]:
    """(outcomes, ledger) of a batch of orders: order_id, outcome (done, skipped, empty, errors), n_pages, error.

    Orders of the ledger (order_id) are skipped unless ``again``; an order
    without pages (order_id, page) is empty; the others are processed, one call
    for each with order_id and n_pages, and a failure is an outcome that stops
    nothing. The ledger gains the orders that are done.
    """
    n = pages.groupBy("order_id").agg(F.count("*").alias("n_pages"))
    known = ledger.select("order_id").distinct().withColumn("_k", F.lit(not again))
    planned = orders.where("order_id IS NOT NULL").select("order_id").distinct().join(known, "order_id", "left").join(n, "order_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)).cast("long"))
    kind = F.when(F.col("_k"), "skipped").when(F.col("n_pages") == 0, "empty")
    planned = written(planned.select("order_id", "n_pages", kind.alias("outcome")), "orders")
    answers = providers.call(planned.where("outcome IS NULL"), process, ["order_id", "n_pages"])
    tried = written(answers.select("order_id", "n_pages", F.when(F.col("error").isNull(), "done").otherwise("errors").alias("outcome"), "error"), "orders")
    outcomes = planned.where("outcome IS NOT NULL").withColumn("error", F.lit(None).cast("string")).unionByName(tried)
    return outcomes, ledger.select("order_id").unionByName(tried.where("outcome = 'done'").select("order_id")).distinct()


def rerun_until_stable(criteria: DataFrame, derive: Callable[[DataFrame], DataFrame], rounds: int = 10, key: str = "doc_id") -> tuple[DataFrame, list[int]]:
    """Second passes that take only the documents whose criteria changed, until none does.

    ``criteria`` has key and criteria columns; ``derive`` takes such rows, does
    the pass for these documents (readings with the models the criteria ask
    for, a description of what was read) and returns key, the criteria that now
    follow, and anything else it made. Documents without a known criterion have
    nothing to run with and no row. One goes into the next round only if a
    criterion differs from what its pass was run with; a criterion that comes
    back null keeps its former value, as not knowing doesn't overwrite
    knowledge. Returns each document's last derived row, with
    ``round``, and the number of documents per round. Documents still changing
    after ``rounds`` keep their last result.
    """
    names = [c for c in criteria.columns if c != key]
    open_ = written(criteria.where(_any([F.col(c).isNotNull() for c in names])), "criteria")
    passes, sizes = [], []
    for n in range(1, rounds + 1):
        size = open_.count()
        if size == 0:
            break
        sizes.append(size)
        before = open_.select(key, *[F.col(c).alias(f"_{c}") for c in names])
        made = derive(open_).join(before, key).withColumns({c: F.coalesce(c, f"_{c}") for c in names})
        changed = _any([~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
        result = written(made.withColumn("_changed", changed).drop(*[f"_{c}" for c in names]).withColumn("round", F.lit(n)), "pass")
        passes.append(result.drop("_changed"))
        open_ = result.where("_changed").select(key, *names)
    if not passes:
        return derive(open_).withColumn("round", F.lit(0)), sizes
    return latest(reduce(DataFrame.unionByName, passes), [key], "round"), sizes


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
