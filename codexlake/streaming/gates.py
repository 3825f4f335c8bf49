"""Gates that wait for an answer, as keyed state that can be read back from a checkpoint."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "gate string, decision string, decided_by string, posted_us long, decided_us long"
_OPEN = "message string, posted_us long, deadline_us long"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as keyed values with timers need; the setting goes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Gates(StatefulProcessor):
    def __init__(self, wait_us: int):
        self.wait_us = wait_us

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues):
        state, before = self.open.get() if self.open.exists() else None, None
        before = state and state[2]
        out = []
        for r in pd.concat(list(rows)).sort_values(["us", "ord"], kind="stable").itertuples(index=False):
            if state and r.us > state[2]:
                out.append((None, "timeout", state[1], state[2]))
                state = None
            if state and r.decision is not None:
                out.append((r.decision, "human", state[1], r.us))
                state = None
            elif state:
                state = (r.message if r.message is not None else state[0], *state[1:])
            elif r.decision is None:
                state = (r.message, r.us, r.us + self.wait_us)
        after = state and state[2]
        if before and before != after:
            self.handle.deleteTimer(before // 1000 + 1)
        if after and before != after:
            self.handle.registerTimer(after // 1000 + 1)
        if state:
            self.open.update(tuple(state))
        elif before:
            self.open.clear()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.open.exists():
            _, posted, deadline = self.open.get()
            out.append((None, "timeout", posted, deadline))
            self.open.clear()
        yield self._rows(key, out)

    def _rows(self, key, found):
        rows = [(key[0], *r) for r in found]
        return pd.DataFrame(rows, columns=["gate", "decision", "decided_by", "posted_us", "decided_us"]).astype({"posted_us": "int64", "decided_us": "int64"})

    def close(self) -> None:
        pass


def gate_stream(stream: DataFrame, minutes: float, late: str = "1 hour") -> DataFrame:
    """gate, decision, decided_by, posted_us, decided_us from a stream of (gate, decision, message, ts, ord).

    A row without a decision posts its gate, which opens it if it is closed; a
    later one only renews the message that shows it. The first answer by (ts,
    ord) within the minutes after the posting decides it, by ``human``; without
    one it closes at its deadline, by ``timeout``, as soon as the watermark or a
    later row of the gate is past it. Answers to gates that aren't open give
    nothing. Event time alone decides, so a replay gives the same outcomes.
    Rows without gate or time are left out.
    """
    at = F.col("ts").cast("timestamp")
    rows = stream.where("gate IS NOT NULL AND ts IS NOT NULL").withColumn("_t", at).withWatermark("_t", late)
    rows = rows.select(F.col("gate").cast("string").alias("gate"), F.col("decision").cast("string").alias("decision"), F.col("message").cast("string").alias("message"), F.unix_micros("_t").alias("us"), F.coalesce(F.col("ord").cast("long"), F.lit(0)).alias("ord"), "_t")
    return rows.groupBy("gate").transformWithStateInPandas(_Gates(int(minutes * 60_000_000)), OUTCOME, "Append", "EventTime")


def open_gates(spark: SparkSession, checkpoint: str) -> DataFrame:
    """gate, message, posted_us, deadline_us of the gates that a stopped or running gate_stream() left open at its last finished batch.

    Reads the state below the checkpoint as a table, without the stream; the
    restarted stream goes on with the same gates.
    """
    with keyed_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return state.select(F.col("key.gate").alias("gate"), "value.message", "value.posted_us", "value.deadline_us")


def parse_control(control: Column) -> Column:
    """struct(doc, gate, field) of a control named ``ah:doc:gate:field``, none of them empty or with a colon; else null."""
    part = lambda i: F.regexp_extract(control, "^ah:([^:]+):([^:]+):([^:]+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("doc"), part(2).alias("gate"), part(3).alias("field")))


def to_restore(open_: DataFrame, paths: DataFrame) -> DataFrame:
    """doc, gate, field, message: the controls to bind again after a restart.

    open_ comes from open_gates() with gates named as controls. A gate needs a
    message; a gate2 of a document needs readings to choose from (paths:
    doc_id), as nothing can be shown otherwise.
    """
    c = open_.where("message IS NOT NULL AND message <> ''").select(parse_control(F.col("gate")).alias("c"), "message").where("c IS NOT NULL").select("c.*", "message")
    readable = paths.select(F.col("doc_id").cast("string").alias("doc")).distinct().withColumn("_r", F.lit(True))
    return c.join(readable, "doc", "left").where("gate <> 'gate2' OR _r").drop("_r")
