import json

from pyspark.sql import functions as F

from codexlake.operators import graph
from codexlake.sources import readers, sinks
from codexlake.streaming import state


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_entity_and_pipeline_files(spark, tmp_path):
    put(tmp_path / "a" / "d1_entities.json", {"entities": [{"text": "Bern", "type": "PLACE", "gnd": "4"}, {"text": "x", "normalised": " Hans ", "type": "PERSON"}]})
    put(tmp_path / "b" / "bad_entities.json", "{not json")
    put(tmp_path / "b" / "d2_pipeline.json", {"transcription": "t", "recognitions": [{"engine": "vlm", "text": "t"}], "description": {"x": {"wert": "1"}}})
    got = sorted((r.doc_id, r.name, r.gnd) for r in readers.entity_files(spark, str(tmp_path)).collect())
    assert got == [("d1", "Bern", "4"), ("d1", "Hans", None)]
    (p,) = readers.pipeline_files(spark, str(tmp_path)).select("doc_id", F.size("recognitions").alias("n")).collect()
    assert (p.doc_id, p.n) == ("d2", 1)


def test_catalogue_keeps_bad_files(spark, tmp_path):
    put(tmp_path / "d1" / "pipeline.json", {"lang": {"wert": "de"}})
    put(tmp_path / "d2" / "pipeline.json", "{broken")
    from codexlake.functions.text import unwrap

    df = readers.catalogue_files(spark, str(tmp_path))
    got = {r.doc_id: r.lang for r in df.select("doc_id", unwrap(F.try_variant_get("record", "$.lang", "variant")).alias("lang")).collect()}
    assert got == {"d1": "de", "d2": None}


def test_logs_skip_bad_lines(spark, tmp_path):
    put(tmp_path / "v.jsonl", '{"doc_id": "d", "candidate": "a", "voter": "u"}\n\nnot json\n{"doc_id": "d", "candidate": "b", "voter": "u", "page": "p"}\n')
    got = [(r.candidate, r.page) for r in readers.votes(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [("a", ""), ("b", "p")]
    put(tmp_path / "p" / "p.jsonl", '{"doc_id": "d", "offered": [{"engine": "vlm"}]}\n')
    (r,) = readers.preferences(spark, str(tmp_path / "p")).collect()
    assert r.chosen == [] and r.combined is False


def test_log_order_over_files_of_unequal_size(spark, tmp_path):
    """Spark packs files by size; the last line of the last file by name must still be the latest."""
    from codexlake.operators import feedback

    for month, n in (("2023-12", 400), ("2024-01", 5), ("2024-02", 40)):
        lines = [json.dumps({"doc_id": "d", "candidate": f"{month}-{i}", "voter": "u", "voter_name": "x" * 50}) for i in range(n)]
        put(tmp_path / f"votes-{month}.jsonl", "\n".join(lines) + "\n")
    votes = readers.votes(spark, str(tmp_path))
    assert [r.candidate for r in feedback.latest(votes, ["doc_id", "voter"], "ord").collect()] == ["2024-02-39"]
    got = [r.candidate for r in votes.orderBy("ord").collect()]
    assert got == [f"{m}-{i}" for m, n in (("2023-12", 400), ("2024-01", 5), ("2024-02", 40)) for i in range(n)]


def test_transcriptions_and_fixtures(spark, tmp_path):
    put(tmp_path / "t" / "d1.txt", "# a\n# b\n\nText hier")
    put(tmp_path / "t" / "d2.txt", "plain")
    ids = spark.createDataFrame([("d1",), ("missing",)], "doc_id string")
    assert [(r.doc_id, r.text) for r in readers.transcriptions(spark, str(tmp_path / "t"), ids).collect()] == [("d1", "Text hier")]
    put(tmp_path / "f" / "x.json", {"reference": "r", "recognitions": {"e": "r"}})
    put(tmp_path / "f" / "golden_x.json", {"reference": "no"})
    assert [(r.doc_id, r.reference) for r in readers.fixtures(spark, str(tmp_path / "f")).collect()] == [("x", "r")]


def test_authorities(spark, tmp_path):
    put(tmp_path / "a" / "flat.json", [{"hls_id": "1", "name": "A", "type": "PERSON"}, {"name": "no id"}])
    put(tmp_path / "b" / "both.json", {"persons": [{"hls_id": "2", "name": "B"}], "places": [{"hls_id": "3", "name": "C"}]})
    assert [(r.id, r.type) for r in readers.authority_dump(spark, str(tmp_path / "a")).collect()] == [("1", "PERSON")]
    assert sorted((r.id, r.type) for r in readers.authority_dump(spark, str(tmp_path / "b")).collect()) == [("2", "PERSON"), ("3", "PLACE")]


def test_person_records(spark):
    raw = spark.createDataFrame([('{"items": [{"id": "7", "n": "Hans", "y": "1300", "v": ["H."], "c": 3}]}',), ('{"pid": "8", "headword": "Eva"}',)], "j string").select(F.parse_json("j").alias("record"))
    got = sorted((r.pid, r.name, r.life_dates, r.variants, r.mention_count) for r in readers.normalise_persons(raw, "s").collect())
    assert got == [("7", "Hans", "1300", ["H."], 3), ("8", "Eva", None, [], 0)]
    models = spark.createDataFrame([('{"id": "m", "centuries": ["14", "x", 15], "languages": ["la", "de"]}',), ('{"id": "t", "engine": "trocr"}',)], "j string").select(F.parse_json("j").alias("record"))
    (m,) = readers.model_registry(models).collect()
    assert (m.model_id, m.lang, m.centuries) == ("m", "la", [14, 15])


def test_images(spark, tmp_path):
    put(tmp_path / "order1" / "p1.PNG", "x")
    put(tmp_path / "order1" / "notes.txt", "x")
    assert [(r.folder, r.stem) for r in readers.images(spark, str(tmp_path)).select("folder", "stem").collect()] == [("order1", "p1")]


def test_sinks(spark, tmp_path):
    g = spark.createDataFrame([("doc:1", "rdf:type", "x", "iri"), ("doc:1", "rdfs:label", 'say "hi"\n', "literal")], "s string, p string, o string, kind string")
    sinks.write_graph(g, spark.createDataFrame([("person", 2)], "reason string, withheld long"), str(tmp_path / "g"))
    lines = spark.read.text(str(tmp_path / "g" / "graph"))
    assert lines.count() == 2 and sinks.same_content(lines, graph.n_triples(g)) and not sinks.same_content(lines.limit(1), lines)
    runs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    sinks.append_errors(spark.createDataFrame([("a", "boom")], "doc_id string, error string"), runs, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    table = spark.createDataFrame([("k1", 1), ("k2", 2)], "key string, v int")
    sinks.save_by_key(table, str(tmp_path / "k"), "key")
    sinks.save_by_key(table.where("key = 'k1'").withColumn("v", F.lit(9)), str(tmp_path / "k"), "key")
    assert {r.key: r.v for r in spark.read.parquet(str(tmp_path / "k")).collect()} == {"k1": 9, "k2": 2}
    plan = sinks.file_plan(spark.createDataFrame([("d", "text", "")], "doc_id string, t string, e string"), ("t.txt", "t"), ("e.json", "e"))
    assert [(r.path, r.content) for r in plan.collect()] == [("d/t.txt", "text")]


def test_invalidation_and_resume(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    inputs = spark.createDataFrame([("d1", "script", "textura", 1), ("d1", "script", "fraktur", 2), ("d1", "path_preference", "x", 3)], "doc_id string, field string, value string, ord long")
    done = state.new_states(docs).withColumn("status", F.lit(state.DONE))
    after = state.invalidate(done, inputs)
    dirty = {r.stage for r in after.where("doc_id = 'd1' AND status = 'dirty'").collect()}
    assert dirty == {"model_select", "kraken", "reconcile", "agent_b", "agent_c"} and after.where("stale").count() == 1
    assert [(r.field, r.value) for r in state.pinned_criteria(inputs).collect()] == [("script", "fraktur")]
    ok = lambda d: d.withColumn("artifact", F.lit("a")).withColumn("error", F.lit(None).cast("string"))
    bad = lambda d: d.withColumn("artifact", F.lit(None).cast("string")).withColumn("error", F.lit("e"))
    states, artifacts = state.resume(after, {"agent_b": bad, "kraken": ok, "agent_c": ok}, stop_on_error=True)
    got = {r.stage: r.status for r in states.where("doc_id = 'd1'").collect()}
    assert got["agent_b"] == "error" and got["kraken"] == "dirty" and got["agent_c"] == "dirty" and artifacts.count() == 0
    states, artifacts = state.resume(after, {"agent_b": bad, "kraken": ok})
    assert {r.stage: r.status for r in states.where("doc_id = 'd1'").collect()}["kraken"] == "done" and artifacts.count() == 1


def test_watched_folder(spark, tmp_path):
    put(tmp_path / "in" / "a.json", '{"k": "x", "ord": 1, "v": "old"}\n{"k": "x", "ord": 2, "v": "new"}\n')
    query = state.watch_folder(spark, str(tmp_path / "in"), "k string, ord long, v string").writeStream.foreachBatch(state.merge_log(str(tmp_path / "log"), ["k"], "ord"))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    put(tmp_path / "in" / "b.json", '{"k": "y", "ord": 3, "v": "first"}\n{"k": "x", "ord": 4, "v": "newest"}\n')
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.v for r in state.current(spark, str(tmp_path / "log"), ["k"], "ord").collect()} == {"x": "newest", "y": "first"}


def test_debounce_and_windows(spark, tmp_path):
    rows = [("s", "2024-01-01 00:00:00"), ("s", "2024-01-01 00:00:01"), ("s", "2024-01-01 00:00:09"), ("t", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "stem string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert state.debounced(df, "stem", "t").count() == 3
    df.withColumn("t", F.col("t").cast("timestamp_ntz")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("stem string, t timestamp_ntz").parquet(str(tmp_path / "e"))
    q = state.windowed_counts(stream, "t", ["stem"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.stem: r.n for r in spark.table("counts").collect()} == {"s": 3, "t": 1}
