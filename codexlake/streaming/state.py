"""Stage state of documents as an append log of versions, and its invalidation by human input."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codexlake.operators.feedback import latest

#: Fixed stages in order, and which of them a human input makes dirty or stale.
STAGES = ("vlm", "agent_b", "model_select", "kraken", "reconcile", "agent_c", "agent_d")
INVALIDATION = {
    "century": (("model_select", "kraken", "reconcile", "agent_b", "agent_c"), ("agent_d",)),
    "lang": (("model_select", "kraken", "reconcile", "agent_b", "agent_c"), ("agent_d",)),
    "script": (("model_select", "kraken", "reconcile", "agent_b"), ()),
    "document_type": (("model_select", "kraken", "reconcile", "agent_b"), ()),
    "path_preference": (("reconcile", "agent_b", "agent_c"), ("agent_d",)),
    "entity_link": ((), ()),
}
CRITERIA = ("century", "lang", "script", "document_type")
PENDING, DONE, DIRTY, ERROR = "pending", "done", "dirty", "error"


def new_states(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A row per document and stage: doc_id, stage, nth, status, stale, version 0."""
    stages = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])
    return docs.select(F.col(doc).alias("doc_id")).distinct().select("doc_id", F.explode(stages).alias("s")).select("doc_id", "s.nth", "s.stage", F.lit(PENDING).alias("status"), F.lit(False).alias("stale"), F.lit(0).cast("long").alias("version"))


def invalidation_matrix(spark) -> DataFrame:
    rows = [(f, s, mark) for f, (dirty, stale) in INVALIDATION.items() for mark, stages in ((DIRTY, dirty), ("stale", stale)) for s in stages]
    return spark.createDataFrame(rows, "field string, stage string, mark string")


def invalidate(states: DataFrame, inputs: DataFrame) -> DataFrame:
    """States after human inputs (doc_id, field, ord): affected stages dirty or stale; unknown fields fail."""
    known = F.col("field").isin(*INVALIDATION)
    checked = inputs.where(F.when(known, F.lit("")).otherwise(F.raise_error(F.concat(F.lit("unknown field "), F.col("field")))).cast("string") == "")
    hits = checked.join(F.broadcast(invalidation_matrix(states.sparkSession)), "field")  # as many rows as the matrix has
    hits = hits.groupBy("doc_id", "stage").agg(F.max((F.col("mark") == DIRTY).cast("int")).alias("d"), F.max((F.col("mark") == "stale").cast("int")).alias("t"), F.max("ord").alias("o"))
    out = states.join(hits, ["doc_id", "stage"], "left")
    return out.select(
        "doc_id",
        "nth",
        "stage",
        F.when(F.col("d") == 1, DIRTY).otherwise(F.col("status")).alias("status"),
        (F.col("stale") | (F.coalesce("t", F.lit(0)) == 1)).alias("stale"),
        F.greatest(F.col("version"), F.coalesce("o", F.lit(0)).cast("long")).alias("version"),
    )


def pinned_criteria(inputs: DataFrame) -> DataFrame:
    """The last human value of each criterion: doc_id, field, value."""
    return latest(inputs.where(F.col("field").isin(*CRITERIA) & F.col("value").isNotNull()).select("doc_id", "field", "value", "ord"), ["doc_id", "field"], "ord")


def to_run(states: DataFrame) -> DataFrame:
    return states.where(F.col("status").isin(PENDING, DIRTY))


def resume(states: DataFrame, runners: dict[str, Callable[[DataFrame], DataFrame]], stop_on_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """Run open stages in order. A runner takes the documents (doc_id) and returns doc_id, artifact, error.

    Returns the new states and all artifacts (doc_id, stage, artifact); a
    failed stage keeps no new artifact. With ``stop_on_error`` a document's
    later stages wait after a failure.
    """
    open_, artifacts, outcomes = to_run(states), None, None
    failed = None
    for stage in STAGES:
        if stage not in runners:
            continue
        docs = open_.where(F.col("stage") == stage).select("doc_id")
        if stop_on_error and failed is not None:
            docs = docs.join(failed, "doc_id", "left_anti")
        result = runners[stage](docs).withColumn("stage", F.lit(stage))
        bad = F.coalesce(F.col("error"), F.lit("")) != ""
        outcome = result.select("doc_id", "stage", F.when(bad, ERROR).otherwise(DONE).alias("new"))
        good = result.where(~bad).select("doc_id", "stage", "artifact")
        artifacts = good if artifacts is None else artifacts.unionByName(good)
        outcomes = outcome if outcomes is None else outcomes.unionByName(outcome)
        lost = result.where(bad).select("doc_id")
        failed = lost if failed is None else failed.unionByName(lost)
    if outcomes is None:
        return states, states.select("doc_id", "stage", F.lit(None).cast("string").alias("artifact")).limit(0)
    after = states.join(outcomes, ["doc_id", "stage"], "left").withColumn("status", F.coalesce("new", "status")).drop("new")
    return after.select(*states.columns), artifacts


def advance(states: DataFrame, events: DataFrame) -> DataFrame:
    """States after logged outcomes (doc_id, stage, status, ord), taken in order.

    A stage may be made dirty at any time; only a pending or dirty one can end
    in done or error, so what counts is the first outcome after the last time
    it was made dirty. The version is the ``ord`` of the last step taken; a
    stage that ends done isn't stale. Rows with nulls, other statuses or stages
    that the table doesn't have are left out. Logs of any length combine
    before they are shuffled.
    """
    logged = events.where("doc_id IS NOT NULL AND ord IS NOT NULL").where(F.col("status").isin(DONE, ERROR, DIRTY)).select("doc_id", "stage", "status", F.col("ord").cast("long").alias("ord"))
    dirty = logged.where(F.col("status") == DIRTY).groupBy("doc_id", "stage").agg(F.max("ord").alias("_d"))
    begun = states.join(dirty, ["doc_id", "stage"], "left")
    open_ = F.col("_d").isNotNull() | F.col("status").isin(PENDING, DIRTY)
    begins = begun.where(open_).select("doc_id", "stage", "_d")
    after = logged.where(F.col("status") != DIRTY).withColumnRenamed("status", "_s").join(begins, ["doc_id", "stage"]).where("_d IS NULL OR ord > _d")
    first = after.groupBy("doc_id", "stage").agg(F.min_by("_s", "ord").alias("_s"), F.min("ord").alias("_o"))
    status = F.coalesce(F.col("_s"), F.when(F.col("_d").isNotNull(), DIRTY), F.col("status"))
    out = begun.join(first, ["doc_id", "stage"], "left").withColumn("status", status)
    out = out.withColumn("version", F.coalesce("_o", "_d", "version")).withColumn("stale", F.col("stale") & ~(F.col("_s").eqNullSafe(DONE)))
    return out.select(*states.columns)


def new_orders(found: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Orders that the ledger doesn't have yet."""
    return found.join(ledger.select(key).distinct(), key, "left_anti")


def debounced(events: DataFrame, stem: str, time: str, quiet_seconds: int = 2) -> DataFrame:
    """The last event of each burst: those with no other of the same stem within the quiet time."""
    from pyspark.sql import Window

    w = Window.partitionBy(stem).orderBy(time)
    after = F.lead(time).over(w)
    return events.withColumn("_after", after).where(F.col("_after").isNull() | (F.col("_after") - F.col(time) > F.make_dt_interval(secs=F.lit(quiet_seconds)))).drop("_after")


def settled(stream: DataFrame, stem: str, value: str, time: str, quiet_ms: int = 2000) -> DataFrame:
    """The last event of each burst of a stream, once its stem was quiet: stem, value, n_events.

    Keyed state holds the latest event only (the one of the highest ``time``);
    each new event puts the timer back, and the timer's end gives the row.
    """
    schema = f"{stem} string, {value} string, n_events long"

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            at, last, n = state.get
            state.remove()
            yield pd.DataFrame({stem: [key[0]], value: [last], "n_events": [n]})
            return
        at, last, n = state.get if state.exists else (None, None, 0)
        for rows in batches:
            best = rows.sort_values("_t", kind="stable").iloc[-1]
            n += len(rows)
            if at is None or best["_t"] >= at:
                at, last = int(best["_t"]), best[value]
        state.update((at, last, n))
        state.setTimeoutDuration(quiet_ms)

    rows = stream.where(F.col(stem).isNotNull() & F.col(time).isNotNull()).select(F.col(stem).cast("string").alias(stem), F.col(value).cast("string").alias(value), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"))
    return rows.groupBy(stem).applyInPandasWithState(run, schema, "at long, last string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def gate_outcomes(stream: DataFrame, gate: str, decision: str, time: str, minutes: float = 30) -> DataFrame:
    """gate, decision, decided_by for a stream of posted gates (null decision) and answers to them.

    The first answer by ``time`` counts, by ``human``; a gate without one
    closes by ``timeout`` when its minutes are over, however often it is
    posted meanwhile. A closed gate leaves no state: answers to gates that
    are not open give nothing, and posting one again opens it anew.
    """
    schema = f"{gate} string, {decision} string, decided_by string"

    def run(key, batches, state: GroupState):
        outcome = None
        if state.hasTimedOut:
            outcome = (None, "timeout")
        else:
            deadline = state.get[0] if state.exists else None
            rows = pd.concat(list(batches)).sort_values("_t", kind="stable")
            answers = rows[decision].dropna()
            if deadline is None and len(answers) < len(rows):
                deadline = state.getCurrentProcessingTimeMs() + int(minutes * 60_000)
            if deadline is not None and len(answers):
                outcome = (answers.iloc[0], "human")
            elif deadline is not None:
                state.update((deadline,))
                state.setTimeoutDuration(max(1, deadline - state.getCurrentProcessingTimeMs()))
        if outcome:
            if state.exists:
                state.remove()
            yield pd.DataFrame({gate: [key[0]], decision: [outcome[0]], "decided_by": [outcome[1]]})

    rows = stream.where(F.col(gate).isNotNull()).select(F.col(gate).cast("string").alias(gate), F.col(decision).cast("string").alias(decision), F.unix_micros(F.col(time).cast("timestamp")).alias("_t"))
    return rows.groupBy(gate).applyInPandasWithState(run, schema, "deadline long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_log(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key of a batch and appends it once per batch id.

    Every batch has a folder of its own and overwrites it, so a batch that is
    replayed after a failure leaves the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def current(spark, path: str, key: list[str], order: str) -> DataFrame:
    """The latest row of each key over all batches of merge_log()."""
    return latest(spark.read.parquet(path).drop("batch"), key, order)


def watch_folder(spark, path: str, schema: str, archive: str | None = None):
    """A file stream of JSON lines from a watched folder; processed files move to the archive folder if one is given."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(path)


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and group; rows later than the watermark are left out. Times without zone are read as UTC."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(F.window("_t", window), *by).agg(F.count("*").alias("n"))
