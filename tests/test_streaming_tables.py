"""Versioned state tables, the board of phases, gates read back from a checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from codexlake.sources import versions
from codexlake.streaming import board, gates
from codexlake.streaming.tables import StateTable, merging

SCHEMA = "doc string, voter long, vote string, ord long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def expected(rows):
    best = {}
    for r in rows:
        if None not in (r[0], r[1], r[3]):
            best[r[:2]] = max(best.get(r[:2], r), r, key=lambda x: (x[3], x[2] or ""))
    return sorted(best.values())


def test_replayed_late_and_unordered_batches_leave_the_same_table(spark, tmp_path):
    draw = random.Random(1)
    rows = [(draw.choice("abc"), draw.randrange(3), draw.choice("xyz"), i) for i in range(60)]
    batches = [rows[i : i + 10] for i in range(0, 60, 10)]
    t = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["doc", "voter"], "ord")
    for i, b in enumerate([batches[3], batches[0], batches[1], batches[5], batches[2], batches[4]]):
        assert t.merge(frame(spark, b), i, "s")
        assert not t.merge(frame(spark, b), i, "s")  # replayed
    assert t.version() == 6
    again = StateTable(spark, t.path, SCHEMA, ["doc", "voter"], "ord")
    assert sorted(map(tuple, again.read().collect())) == expected(rows)
    assert t.merge(frame(spark, [("a", 0, "late", -5)]), 0, "other")
    assert sorted(map(tuple, t.read().collect())) == expected(rows)


def test_reading_does_not_grow_with_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(StateTable, "KEEP", 3)
    t = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["doc", "voter"], "ord")
    rows = []
    for i in range(24):
        batch = [(f"d{(i * 3 + j) % 10}", 0, f"v{i}", i * 10 + j) for j in range(3)]
        rows += batch
        t.merge(frame(spark, batch), i)
    sizes = [r["rows"] for r in t.runs()]
    assert all(b <= a / 2 for a, b in zip(sizes, sizes[1:])) and sum(sizes) <= 2 * 10
    assert sorted(map(tuple, t.read().collect())) == expected(rows)
    assert len(versions.numbers(spark, t.path)) <= 6
    assert len([c for c in versions.children(spark, t.path) if c.startswith("run-")]) <= 12
    before = t.read(t.version() - 1)
    assert before.where("ord >= 230").count() == 0


def test_merge_edges(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), SCHEMA, ["doc", "voter"], "ord")
    assert t.read().collect() == [] and t.version() == 0
    assert not t.merge(frame(spark, [(None, 1, "x", 1), ("a", 1, "x", None)]), 0)
    assert t.version() == 0 and versions.children(spark, t.path) == []
    t.merge(frame(spark, [("a", 1, None, 1), ("a", 1, "x", 1)]).withColumn("more", F.lit(1)), 1)  # ties: the greatest row
    assert [tuple(r) for r in t.read().collect()] == [("a", 1, "x", 1)]
    with pytest.raises(ValueError):
        t.read(7)
    with pytest.raises(versions.Conflict):
        versions.add(spark, t.path, 1, {})
    (tmp_path / "t" / "_versions" / "000000000002").write_text("{broken")  # a writer that died
    assert t.version() == 1 and t.read().count() == 1


def phases(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, phase string, status string, decision string, ord long")


def test_board_writes_only_what_changed(spark, tmp_path):
    source, check = tmp_path / "in", str(tmp_path / "check")
    table = StateTable(spark, str(tmp_path / "board"), board.BOARD, ["doc_id"], "updated")

    def run(rows):
        phases(spark, rows).coalesce(1).write.mode("append").json(str(source))
        q = board.follow(spark.readStream.schema("doc_id string, phase string, status string, decision string, ord long").json(str(source)), table, check, once=True)
        q.awaitTermination()
        return {r.doc_id: [(p.phase, p.status, p.n) for p in r.phases] for r in table.read().collect()}

    got = run([("d", "vlm", "done", None, 2), ("d", "vlm", "started", None, 1), ("d", "agent_b", "done", "x", 3), ("e", "vlm", "error", None, 4), (None, "vlm", "x", None, 5), ("e", None, "x", None, 6)])
    assert got == {"d": [("vlm", "done", 2), ("agent_b", "done", 1)], "e": [("vlm", "error", 1)]}
    assert table.version() == 1
    run([(None, "vlm", "x", None, 7)])  # a batch that changes no board
    assert table.version() == 1
    got = run([("e", "vlm", "done", None, 8)])
    assert got["e"] == [("vlm", "done", 2)] and table.version() == 2 and table.runs()[-1]["rows"] in (1, 2)


BASE = 1_000_000  # rows at or before the epoch count as late


def gate_rows(spark, path, rows):
    spark.createDataFrame(rows, "gate string, decision string, message string, s long, ord long").select("gate", "decision", "message", F.timestamp_seconds(F.col("s") + BASE).alias("ts"), "ord").coalesce(1).write.mode("append").json(path)


def run_gates(spark, tmp_path, minutes=10, late="1 minute"):
    stream = spark.readStream.schema("gate string, decision string, message string, ts timestamp, ord long").json(str(tmp_path / "in"))
    with gates.keyed_state(spark):
        q = gates.gate_stream(stream, minutes, late).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.gate, r.decision, r.decided_by, r.posted_us // 10**6 - BASE) for r in spark.read.schema(gates.OUTCOME).json(str(tmp_path / "out")).collect()}


def test_open_gates_survive_a_restart(spark, tmp_path):
    rows = [("ah:d1:gate1:lang", None, "m1", 0, 0), ("ah:d2:gate2:path", None, "m2", 10, 0), ("ah:d2:gate2:path", "kraken", None, 30, 1), ("ah:d2:gate2:path", "vlm", None, 20, 2)]
    rows += [("ah:d3:gate2:path", None, "m3", 0, 3), ("ah:d4:gate2:path", None, "m4", 0, 4), ("odd", None, "m5", 1, 5), ("ah:d5:gate1:lang", None, None, 1, 6), ("x", "answer without a gate", None, 2, 7), (None, None, "m", 1, 8)]
    gate_rows(spark, str(tmp_path / "in"), rows)
    assert run_gates(spark, tmp_path) == {("ah:d2:gate2:path", "vlm", "human", 10)}
    left = gates.open_gates(spark, str(tmp_path / "check"))
    assert {(r.gate, r.message, r.posted_us, r.deadline_us) for r in left.collect()} == {(g, m, (s + BASE) * 10**6, (s + BASE + 600) * 10**6) for g, d, m, s, _ in rows if g and d is None and "d2" not in g}
    controls = gates.to_restore(left, spark.createDataFrame([("d4",)], "doc_id string"))
    assert {tuple(r) for r in controls.select("doc", "gate", "field", "message").collect()} == {("d1", "gate1", "lang", "m1"), ("d4", "gate2", "path", "m4")}
    gate_rows(spark, str(tmp_path / "in"), [("ah:d1:gate1:lang", "de", None, 60, 1), ("odd", None, "m6", 70, 1)])
    got = run_gates(spark, tmp_path)  # the stream goes on from its checkpoint
    assert ("ah:d1:gate1:lang", "de", "human", 0) in got and len(got) == 2
    left = {r.gate: r.message for r in gates.open_gates(spark, str(tmp_path / "check")).collect()}
    assert left["odd"] == "m6" and "ah:d1:gate1:lang" not in left
    gate_rows(spark, str(tmp_path / "in"), [("ah:d3:gate2:path", "too late", None, 700, 1), ("later", None, "m", 5000, 1)])
    got = run_gates(spark, tmp_path)
    assert {r[:3] for r in got if r[2] == "timeout"} == {(g, None, "timeout") for g in ("ah:d3:gate2:path", "ah:d4:gate2:path", "odd", "ah:d5:gate1:lang")}
    assert [r.gate for r in gates.open_gates(spark, str(tmp_path / "check")).collect()] == ["later"]


def test_parse_control(spark):
    rows = [("ah:d:gate1:lang",), ("ah:d::lang",), ("x:d:g:f",), ("ah:d:g:f:more",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(gates.parse_control(F.col("c"))).collect()]
    assert tuple(got[0]) == ("d", "gate1", "lang") and got[1:] == [None] * 5
