import random

import pytest
from brute import DOCS, docs_frame, line_dedup, rows_of

from codexlake.llm import line_dedup as op

COLS = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_hostile_rows(spark):
    assert rows_of(op.dedup_lines(docs_frame(spark)), *COLS) == sorted(line_dedup(DOCS), key=repr)


def test_empty(spark):
    assert op.dedup_lines(docs_frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_groups_cut_by_partition_borders(spark, seed):
    """One line in most documents, so its group spans several partitions."""
    rng = random.Random(seed)
    rows = [(d, "\n".join(rng.choice(["a line that everybody has got", f"line number {rng.randrange(40)} of the others", "short"]) for _ in range(rng.randrange(6))), "en", "a") for d in range(400)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows_of(op.dedup_lines(docs_frame(spark, rows).repartition(7)), *COLS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == sorted(line_dedup(rows), key=repr)


def test_text(spark):
    kept = {r.doc_id: r.kept_text for r in op.dedup_lines(docs_frame(spark)).collect() if r.doc_id in (1, 3)}
    assert kept == {1: "body one two three four five six", 3: DOCS[2][1]}
