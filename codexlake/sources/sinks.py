"""Sinks: append logs, keyed rewrites, one-file reports, N-Triples with a manifest, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codexlake.operators.corpus import index_lines
from codexlake.operators.graph import graph_counts, n_triples


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_by_key(rows: DataFrame, path: str, key: str) -> None:
    """Rewrite only the keys that occur in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_errors(errors: DataFrame, runs: DataFrame, path: str) -> None:
    """One entry per run, also for runs without errors: doc_id, errors."""
    grouped = errors.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in errors.columns if c != "doc_id"])).alias("errors"))
    runs.select("doc_id").distinct().join(grouped, "doc_id", "left").write.mode("append").json(path)


def write_index(index: DataFrame, path: str) -> None:
    """The index sorted by slug; sorted parts in order, so the reading order is the slug order at any size."""
    index.orderBy("slug").write.mode("overwrite").json(path)


def write_search(records: DataFrame, path: str) -> None:
    """The search page's records as JSON lines under ``path``/search and its table's rows under ``path``/index, both sorted by document; the same input gives the same lines."""
    records.orderBy("doc_id").write.mode("overwrite").json(f"{path}/search")
    index_lines(records).orderBy("doc_id").select("line").write.mode("overwrite").text(f"{path}/index")


def entity_pages(index: DataFrame, mentions: DataFrame) -> DataFrame:
    """slug, path, content: one page per entity with its documents."""
    docs = mentions.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda d: F.concat(F.lit("* "), d.cast("string"))), "\n").alias("docs"))
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), "name"), "type", F.col("docs"))
    return index.join(docs, "slug", "left").select("slug", F.concat(F.lit("entities/"), "slug", F.lit("/index.md")).alias("path"), content.alias("content"))


def file_plan(documents: DataFrame, *parts: tuple[str, str]) -> DataFrame:
    """doc_id, path, content of all files of a publication, from (file name, column) pairs; blank ones are left out."""
    made = F.array(*[F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(f"/{name}")).alias("path"), F.col(c).cast("string").alias("content")) for name, c in parts])
    return documents.select("doc_id", F.explode(made).alias("f")).select("doc_id", "f.*").where("coalesce(content, '') <> ''")


def write_graph(graph: DataFrame, withheld: DataFrame, path: str) -> None:
    """Sorted N-Triples under ``path``/graph, counts and withheld numbers beside it; refuses an empty graph."""
    if graph.isEmpty():
        raise ValueError("refusing to publish an empty graph")
    n_triples(graph).write.mode("overwrite").text(f"{path}/graph")
    graph_counts(graph).write.mode("overwrite").json(f"{path}/counts")
    withheld.write.mode("overwrite").json(f"{path}/withheld")


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two line tables hold the same lines: equal counts and order-free hash sums, so that an unchanged build is not swapped in."""
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("value").cast("decimal(38,0)"))).first())
    return mark(a) == mark(b)
