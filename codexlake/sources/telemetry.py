"""Metrics that jobs and streams bring along, without a pass of their own."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Telemetry of one agent's work on a document, and of one batch of a stream.
RUNS = "doc_id string, agent string, started timestamp, seconds double, tokens long, error string"
BATCHES = "stream string, batch long, at string, metric string, value double"


def observed(rows: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and the metrics (aggregates) that the next action on them computes in passing; ``.get`` has them by name."""
    seen = Observation(f"seen-{uuid.uuid4().hex}")
    return rows.observe(seen, *[c.alias(name) for name, c in metrics.items()]), seen


@contextmanager
def recorded(spark: SparkSession, path: str, doc_id: str, agent: str):
    """Append a row of RUNS for the work inside: wall-clock seconds, tokens (set on what is yielded), and the error if it raised."""
    began, at, found = time.monotonic(), datetime.now(timezone.utc), {"tokens": None}
    error = None
    try:
        yield found
    except Exception as e:
        error = str(e) or type(e).__name__
        raise
    finally:
        row = (doc_id, agent, at, time.monotonic() - began, found["tokens"], error)
        spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(path)


class BatchMetrics(StreamingQueryListener):
    """Collects what the streams of a session observe: input rows, seconds, and each metric of an observe() in their plans.

    Keeps at most ``keep`` rows in memory, the oldest go to ``path`` when it is
    full and at flush(); rows() has both.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 1000):
        super().__init__()
        self.spark, self.path, self.keep, self._rows = spark, path, keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name, batch, at = p.name or str(p.id), p.batchId, p.timestamp
        self._rows += [(name, batch, at, "input_rows", float(p.numInputRows)), (name, batch, at, "seconds", p.batchDuration / 1000)]
        for group, row in p.observedMetrics.items():
            self._rows += [(name, batch, at, f"{group}.{k}", float(v)) for k, v in row.asDict().items() if isinstance(v, (int, float))]
        if len(self._rows) > self.keep:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self) -> None:
        rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, BATCHES).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(BATCHES).parquet(self.path)
