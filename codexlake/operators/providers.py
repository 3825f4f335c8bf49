"""Outside services (recognition, language models, lookups) as functions called per Arrow batch; failures are data."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def call(rows: DataFrame, provider: Callable[[dict], str], columns: list[str], out: str = "answer") -> DataFrame:
    """One call per row: the columns, the answer, and the error if it failed."""

    def run(batches: Iterable[pd.DataFrame]):
        for b in batches:
            answers, errors = [], []
            for row in b.to_dict("records"):
                try:
                    answers.append(provider(row))
                    errors.append(None)
                except Exception as e:  # a failing service must not fail the job
                    answers.append(None)
                    errors.append(str(e))
            yield b.assign(**{out: answers, "error": errors})

    slim = rows.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema) + f", `{out}` string, error string"
    return slim.mapInPandas(run, schema)


def federated(queries: DataFrame, sources: list[str], search: Callable[[str, str], list[dict]], fields: str) -> tuple[DataFrame, DataFrame]:
    """(hits, failed): every source asked for every query. hits has query, source and ``fields``; failed has query, source, error."""
    asked = queries.select("query").distinct().withColumn("source", F.explode(F.array(*map(F.lit, sources))))

    def run(batches):
        for b in batches:
            rows = []
            for q, s in zip(b["query"], b["source"]):
                try:
                    rows += [{"query": q, "source": s, "hit": hit, "error": None} for hit in search(s, q)]
                except Exception as e:
                    rows.append({"query": q, "source": s, "hit": None, "error": str(e)})
            yield pd.DataFrame(rows, columns=["query", "source", "hit", "error"])

    found = asked.mapInPandas(run, f"query string, source string, hit struct<{fields}>, error string")
    return found.where("error IS NULL").select("query", "source", "hit.*"), found.where("error IS NOT NULL").select("query", "source", "error")


def lookup(requests: DataFrame, get: Callable[[str, str], dict | None], fields: str) -> DataFrame:
    """source, pid, found (struct of ``fields``), error: one call for each distinct request; found is null where the source has nothing or failed."""
    asked = requests.select("source", "pid").where("source IS NOT NULL AND pid IS NOT NULL").distinct()

    def run(batches):
        for b in batches:
            rows = []
            for source, pid in zip(b["source"], b["pid"]):
                try:
                    rows.append((source, pid, get(source, pid), None))
                except Exception as e:
                    rows.append((source, pid, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "pid", "found", "error"])

    return asked.mapInPandas(run, f"source string, pid string, found struct<{fields}>, error string")


def first_usable(rows: DataFrame, text_columns: list[str], out: str = "text") -> DataFrame:
    """A cascade: the first reading that is not blank, and which one it was."""
    usable = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in text_columns]
    which = F.coalesce(*[F.when(u.isNotNull(), F.lit(c)) for u, c in zip(usable, text_columns)])
    return rows.withColumn(out, F.coalesce(*usable)).withColumn("reading", which)


def expand_until_agreed(pages: DataFrame, ranks: list[Callable[[DataFrame], DataFrame]], spread: Callable[[DataFrame], DataFrame], start: int = 3, threshold: float = 0.30) -> DataFrame:
    """Readings of the first ``start`` engines for all pages, then of one more engine at a time for pages that still disagree.

    Each entry of ``ranks`` reads pages into rows (page, engine, text);
    ``spread`` gives page, max_cer. Later engines see ever fewer pages.
    """
    from codexlake.sources.scratch import written

    readings = None
    open_ = pages
    for i, read in enumerate(ranks):
        if i >= start:
            unsettled = spread(readings).where(F.col("max_cer") > threshold).select("page")
            open_ = written(open_.join(unsettled, "page", "left_semi"), "open")
            if open_.isEmpty():
                break
        new = written(read(open_), "readings")
        readings = new if readings is None else readings.unionByName(new)
    return readings
