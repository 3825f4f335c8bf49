import json

import pytest
from pyspark.sql import functions as F

from codexlake.plans import jobs

GOOD = "Item der Vogt von Thun git zwen pfunt"


def test_read_with_retry(spark):
    def first(row):
        if row["page"] == "c":
            raise RuntimeError("down")
        return GOOD if row["page"] == "a" else "x"

    pages = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "page string, n int")
    got, errors = jobs.read_with_retry(pages, [first, lambda r: GOOD if r["page"] == "b" else None, lambda r: "y" if r["page"] == "d" else ""], ["page"])
    assert {(r.page, r.text, r.engine) for r in got.collect()} == {("a", GOOD, 0), ("b", GOOD, 1), ("c", "", 2), ("d", "x", 0)}
    assert [(r.page, r.engine, r.error) for r in errors.collect()] == [("c", 0, "down")]
    assert jobs.read_with_retry(pages.limit(0), [first], ["page"])[0].count() == 0


def test_documents(spark):
    rows = [("d", "p10", 1, "a", "last page"), ("d", "p2", 1, "a", "eins zwei drei"), ("d", "p2", 2, "b", "eins zwei drei"), ("d", "p3", 1, "a", "aaaa"), ("d", "p3", 2, "b", "zzzzzz"), ("d", "p4", 1, "a", None), ("e", "p1", 1, "a", ""), (None, "p1", 1, "a", "x")]
    got = {r.doc_id: r for r in jobs.documents(spark.createDataFrame(rows, "doc_id string, page string, ord int, engine string, text string")).collect()}
    assert got["d"].text == "--- p2 ---\neins zwei drei\n\n--- p3 ---\naaaa\n\n--- p4 ---\n\n\n--- p10 ---\nlast page"
    assert (got["d"].n_pages, got["d"].n_unmerged, got["d"].qa_score) == (4, 1, 0.5) and (got["e"].n_pages, got["e"].qa_score) == (1, 0.0) and len(got) == 2


def test_extract_entities(spark):
    def model(row):
        if "BAD" in row["chunk"]:
            raise ValueError("no answer")
        found = [{"text": w.strip(".,"), "type": "person", "context": row["chunk"]} for w in row["chunk"].split() if w[0].isupper()]
        return "Here: " + json.dumps(found)[:-1]  # cut off

    docs = spark.createDataFrame([("a", "Anna und Beat und Anna"), ("b", "BAD text"), ("c", None), ("d", "")], "doc_id string, text string")
    found, errors = jobs.extract_entities(docs, model)
    assert {(r.doc_id, r.name, r.type) for r in found.collect()} == {("a", "Anna", "PERSON"), ("a", "Beat", "PERSON")}
    assert [(r.doc_id, r.error) for r in errors.collect()] == [("b", "no answer")]
    found, _ = jobs.extract_entities(docs, model, size=8, overlap=2)
    assert {r.name for r in found.collect()} >= {"Anna"}


def test_evaluate(spark):
    rows = [("d", "eins zwei", {"a": "eins zwei", "b": "eins drei"}, "eins zwo"), ("e", "vier", {"a": None}, None), ("f", None, {"a": "x"}, "x")]
    got = jobs.evaluate(spark.createDataFrame(rows, "doc_id string, reference string, recognitions map<string,string>, fused string"))
    assert {r.doc_id: r.best_engine for r in got["best"].collect()} == {"d": "a", "e": "a"}
    assert {r.engine: (r.mean_cer, r.mean_wer, r.n) for r in got["engines"].collect()}["a"] == (0.5, 0.5, 2)
    assert {r.doc_id: r.fusion_beats_best for r in got["gain"].collect()} == {"d": False, "e": None}


def test_release(spark, tmp_path):
    lines = spark.createDataFrame([("b",), ("a",)], "value string")
    assert jobs.released(spark, str(tmp_path)) is None
    assert jobs.release(lines, str(tmp_path)) and not jobs.release(lines.orderBy("value"), str(tmp_path))
    with pytest.raises(ValueError):
        jobs.release(lines.limit(0), str(tmp_path))
    assert jobs.release(lines.withColumn("value", F.upper("value")), str(tmp_path))
    assert sorted(r.value for r in jobs.released(spark, str(tmp_path)).collect()) == ["A", "B"]


def test_release_is_never_half_there(spark, tmp_path):
    root = str(tmp_path)
    jobs.release(spark.createDataFrame([("a",)], "value string"), root, about={"n": 1})
    assert jobs.release_notes(spark, root) == {"n": 1}
    (tmp_path / "_versions" / "000000000002").write_text("")  # a writer that died
    assert [r.value for r in jobs.released(spark, root).collect()] == ["a"] and jobs.release_notes(spark, root) == {"n": 1}


def test_scope_is_counted_in_passing(spark, tmp_path):
    from codexlake.operators import graph
    from codexlake.sources import telemetry

    rows = [("d1", "PERSON", "g1", False), ("d1", "PERSON", None, False), ("d2", "PLACE", None, True), ("d3", "PLACE", "", False)]
    e = spark.createDataFrame(rows, "doc_id string, type string, gnd string, f boolean").withColumns({"hls": F.lit(""), "wikidata": F.lit(None).cast("string")})
    kept, seen = graph.observed_scope(e, F.col("f"))
    assert kept.count() == 2
    assert seen.get == {"all": 4, "kept": 2, "flagged": 1, "persons": 0, "without_authority": 1}
    assert {r.reason: r.withheld for r in graph.publication_scope(e, F.col("f"))[1].collect()} == {"flagged document": 1, "person without authority": 1}

    log = str(tmp_path / "runs")
    with telemetry.recorded(spark, log, "d1", "C") as run:
        run["tokens"] = 7
    with pytest.raises(ValueError), telemetry.recorded(spark, log, "d2", "C"):
        raise ValueError("no text")
    assert {(r.doc_id, r.agent, r.tokens, r.error) for r in spark.read.parquet(log).collect()} == {("d1", "C", 7, None), ("d2", "C", None, "no text")}

    metrics = telemetry.BatchMetrics(spark, str(tmp_path / "batches"))
    spark.streams.addListener(metrics)
    try:
        e.coalesce(1).write.json(str(tmp_path / "in"))
        stream = spark.readStream.schema(e.schema).json(str(tmp_path / "in")).observe("scope", F.count_if("f").alias("flagged"))
        q = stream.writeStream.format("noop").queryName("watched").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if metrics._rows:
                break
            import time

            time.sleep(0.2)
        got = {(r.stream, r.metric): r.value for r in metrics.rows().where("metric <> 'seconds' AND batch = 0").collect()}
        assert got == {("watched", "input_rows"): 4.0, ("watched", "scope.flagged"): 1.0}
    finally:
        spark.streams.removeListener(metrics)


def test_descriptions(spark):
    docs = spark.createDataFrame([("a", "Ein guter alter Text ueber den Spital und die Armen der Stadt Bern", None), ("b", "u" * 80, "page.jpg"), ("c", "", None), ("d", None, "broken.jpg"), ("long", "wort " * 2000, None)], "doc_id string, text string, image string")
    seen = []

    def from_text(row):
        assert len(row["text"]) < 4100
        return '```json\n{"Sprache": {"wert": "Deutsch"}, "Schrift": "Kurrent",}\n```'

    def from_image(row):
        if row["image"] == "broken.jpg":
            raise ValueError("no image")
        return '{"Schrift": "Kurrent"}'

    def care(row):
        return '{"is_care_related": true, "care_types": ["alms"], "beteiligte": "nobody"}' if "Spital" in row["text"] else "thinking ..."

    got = {r.doc_id: r for r in jobs.describe(docs, from_text, from_image, care).withColumn("d", F.to_json("description")).drop("description").collect()}
    assert set(got) == {"a", "b", "c", "d", "long"}
    assert got["a"].missing == ["Datierung", "Dokumenttyp", "Inhalt"] and not got["a"].low_confidence
    assert tuple(got["a"].care) == (True, "", ["alms"], []) and tuple(got["c"].care) == (False, "", [], [])
    assert got["b"].low_confidence and got["b"].d == '{"Schrift":"Kurrent"}' and got["b"].errors == []
    assert got["c"].d == "{}" and got["c"].low_confidence and len(got["c"].missing) == 5
    assert got["d"].errors == ["no image"] and not seen
    assert jobs.describe(docs.limit(0), from_text, from_image, care).collect() == []


def test_corpus_analysis(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, " "), (3, "ghi"), (4, None)], "doc_id long, text string")

    def topics(row):
        if row["chunk"] == "def":
            return "no answer"
        return '{"items": ["t%d", "all", null], "fields": {"last": "%s"}}' % (row["nth"], row["chunk"])

    got = jobs.analyse_corpus(docs, "c", {"topics": topics}, size=3)
    assert [tuple(r) for r in got["totals"].collect()] == [("c", 2, 9)]
    assert [r.item for r in got["topics"]["items"].collect()] == ["t0", "all"]
    assert [tuple(r) for r in got["topics"]["fields"].collect()] == [("last", "ghi")] and got["topics"]["failed"].first().failed == 1
    empty = jobs.analyse_corpus(docs.where("doc_id > 3"), "c", {"topics": topics})
    assert empty["totals"].collect() == [] and empty["topics"]["items"].collect() == []


def test_search_page(spark, tmp_path):
    from codexlake.operators import corpus
    from codexlake.sources import sinks

    docs = spark.createDataFrame([("b", None, "x  y\n" * 200, [("Bern", None)]), ("a", '{"Sprache": {"wert": "de"}, "Datierung": 1450}', None, None)], "doc_id string, j string, transcription string, entities array<struct<text:string,normalised:string>>")
    records = corpus.search_records(docs.withColumn("description", F.try_parse_json("j")))
    got = {r.doc_id: r for r in records.collect()}
    assert tuple(got["a"]) == ("a", "1450", "de", "", [], "", "a/") and got["b"].snippet == ("x y " * 200)[:300] + "…" and got["b"].entities == ["Bern"]
    sinks.write_search(records, str(tmp_path))
    assert [r.value for r in spark.read.text(str(tmp_path / "index")).collect()] == ["| [a](a/) | 1450 | de |  | 0 |", "| [b](b/) |  |  |  | 1 |"]
    assert [r.doc_id for r in spark.read.json(str(tmp_path / "search")).collect()] == ["a", "b"]
    index = spark.createDataFrame([("1", "Müller ﬁnden"), ("2", "muller")], "doc_id string, snippet string")
    assert {r.doc_id for r in corpus.catalogue_search(index, "MULLER", ["snippet"]).collect()} == {"1", "2"}
    assert corpus.catalogue_search(index, "finden", ["snippet"]).collect() == []  # a ligature is no diacritic
