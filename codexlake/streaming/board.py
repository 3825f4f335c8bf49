"""The live board of phase events: a snapshot per document that is written only where it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codexlake.streaming.tables import StateTable

#: What a board's table holds.
BOARD = "doc_id string, phases array<struct<first: long, phase: string, status: string, decision: string, n: long>>, n_events long, updated long"


def board(events: DataFrame) -> DataFrame:
    """doc_id, phases, n_events, updated from phase events (doc_id, phase, status, decision, ord).

    A document's phases are in the order of their first event, each with the
    status and decision of its last one. Works on tables and, in complete mode,
    on streams: one aggregation whose state holds the last event of each
    document and phase. Events without doc_id, phase or ord are left out.
    """
    e = events.where("doc_id IS NOT NULL AND phase IS NOT NULL AND ord IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "phase", "status", "decision", F.col("ord").cast("long").alias("ord"))
    at = F.struct("ord", "status", "decision")
    return e.groupBy("doc_id", "phase").agg(F.min("ord").alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def rows_of(phases: DataFrame) -> DataFrame:
    """The boards of board()'s groups."""
    one = F.struct("first", "phase", F.col("last.status").alias("status"), F.col("last.decision").alias("decision"), "n")
    return phases.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("phases"), F.sum("n").alias("n_events"), F.max("last.ord").alias("updated"))


def show_on(table: StateTable, stream: str = "board"):
    """A foreachBatch function for board() in complete mode: boards that differ from the table's are merged, the others cost no write."""

    def run(groups: DataFrame, batch_id: int) -> None:
        new = rows_of(groups)
        old = table.read().select("doc_id", F.xxhash64("phases").alias("_d"))
        changed = new.join(old, "doc_id", "left").where(~F.xxhash64("phases").eqNullSafe(F.col("_d"))).drop("_d")
        table.merge(changed, batch_id, stream)

    return run


def follow(events: DataFrame, table: StateTable, checkpoint: str, every: str = "2 seconds", once: bool = False):
    """Start the board of a stream of phase events; ``once`` reads what is there and ends."""
    writer = board(events).writeStream.outputMode("complete").foreachBatch(show_on(table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
