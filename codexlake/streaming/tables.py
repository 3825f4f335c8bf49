"""Keyed tables with versions that batches are merged into."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codexlake.operators.feedback import latest
from codexlake.sources import versions


class StateTable:
    """The row with the highest ``order`` of each key, in runs of Parquet files below ``path``.

    A merge writes the batch's last rows as a run. Runs of at most twice its
    rows that lie before it are folded into it, so sizes fall by half or more
    from run to run: a reader meets at most twice the rows of the largest run,
    whatever the number of batches, and a row is rewritten a logarithmic number
    of times. A version is a list of runs; it takes effect as one small file,
    and names the last batch of each stream, so a batch that is replayed after a
    failure changes nothing; a batch without rows adds no version. Late batches meet the rows they are older than in
    ``read()``. Rows need a key and an order without nulls, others are left out;
    of rows that share key and order the greatest in its other columns counts.
    """

    #: Versions that stay readable.
    KEEP = 8

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: str):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.schema = spark.createDataFrame([], schema).schema

    def version(self) -> int:
        return versions.newest(self.spark, self.path)[0]

    def last_batch(self, stream: str = "") -> int:
        """Number of the stream's last merged batch; -1 before the first."""
        return versions.newest(self.spark, self.path)[1].get("streams", {}).get(stream, -1)

    def _rows(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r['path']}" for r in runs])

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in (*self.key, self.order)]
        return latest(rows.withColumn("_o", F.struct(self.order, *rest)), self.key, "_o").select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the newest if none is given."""
        content = versions.newest(self.spark, self.path)[1] if version is None else versions.read(self.spark, self.path, version)
        if version and content is None:
            raise ValueError(f"{self.path} has no version {version}")
        runs = (content or {}).get("runs", [])
        return self._rows(runs) if len(runs) == 1 else self._last(self._rows(runs))

    def runs(self) -> list[dict]:
        """path and rows of the newest version's runs, the oldest first."""
        return versions.newest(self.spark, self.path)[1].get("runs", [])

    def merge(self, rows: DataFrame, batch_id: int | None = None, stream: str = "") -> bool:
        """Add rows; False if the stream's batch was merged before or has none.

        A merge that meets another writer's is an error (versions.Conflict);
        the rows can be merged again.
        """
        number, content = versions.newest(self.spark, self.path)
        done = content.get("streams", {})
        if batch_id is not None and batch_id <= done.get(stream, -1):
            return False
        named = F.lit(True)
        for c in (*self.key, self.order):
            named = named & F.col(c).isNotNull()
        runs = list(content.get("runs", []))
        new = self._write(self._last(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).where(named)))
        if not new["rows"]:
            versions.delete(self.spark, f"{self.path}/{new['path']}")
            return False
        folded = [new]
        while runs and runs[-1]["rows"] <= 2 * sum(r["rows"] for r in folded):
            folded.insert(0, runs.pop())
        if len(folded) > 1:
            runs.append(self._write(self._last(self._rows(folded))))
            versions.delete(self.spark, f"{self.path}/{new['path']}")  # no version names it
        else:
            runs.append(new)
        versions.add(self.spark, self.path, number + 1, {"runs": runs, "streams": done | ({stream: batch_id} if batch_id is not None else {})})
        self.vacuum()
        return True

    def _write(self, rows: DataFrame) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return {"path": name, "rows": self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").count()}

    def vacuum(self) -> None:
        """Drop the versions before the last KEEP, and runs that only they name."""
        old = versions.numbers(self.spark, self.path)
        if len(old) < 2 * self.KEEP:
            return
        kept = {r["path"] for n in old[: self.KEEP] for r in (versions.read(self.spark, self.path, n) or {}).get("runs", [])}
        named = {r["path"] for n in old[self.KEEP :] for r in (versions.read(self.spark, self.path, n) or {}).get("runs", [])}
        for name in named - kept:
            versions.delete(self.spark, f"{self.path}/{name}")
        for n in old[self.KEEP :]:
            versions.delete(self.spark, f"{self.path}/{versions.FOLDER}/{n:012d}")


def merging(table: StateTable, stream: str = ""):
    """A foreachBatch function that merges each batch once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id, stream)

    return run
