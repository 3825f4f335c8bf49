"""Authority records, their graph, and the keyed timers of streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from codexlake.functions import text as T
from codexlake.operators import corpus, fusion, graph, hub, metrics
from codexlake.sources import readers
from codexlake.streaming import state

SEED = json.dumps({"controlled_vocabulary": ["Rat", "Spital"], "document_types": ["Urbar"], "persons": [], "places": [{"id": "p1", "name": "Thun", "coordinates": [46.7, 7.6]}], "organisations": []})


def test_hub_file_and_seed(spark, tmp_path):
    seeded = readers.hub(spark, str(tmp_path / "none.json"), SEED)
    assert [r.term for r in seeded["controlled_vocabulary"].orderBy("ord").collect()] == ["Rat", "Spital"]
    (tmp_path / "broken.json").write_text("{no json")
    assert readers.hub(spark, str(tmp_path / "broken.json"), SEED)["places"].first().name == "Thun"
    (tmp_path / "hub.json").write_text(json.dumps({"persons": [{"id": "a", "name": "Anna", "wikidata": "12", "gnd": "gnd:7 ", "more": 1}]}))
    own = readers.hub(spark, str(tmp_path / "hub.json"), SEED)
    assert own["persons"].first().name == "Anna" and own["places"].count() == 0
    counts = hub.summary(persons=own["persons"], places=own["places"])
    assert {r.kind: r.n for r in counts.collect()} == {"persons": 1, "places": 0}


def test_hub_records(spark):
    e = "id string, name string, wikidata string, gnd string, coordinates array<string>, notes string"
    rows = [("1", "Bern", "Q70", None, ["46.9", "7.4"], None), ("2", "Thun", "", "", ["46.7"], "n"), ("3", None, None, None, ["x", "y"], None), ("4", "Biel", None, None, None, None)]
    places = hub.places(spark.createDataFrame(rows, e))
    assert [(r.lat, r.lon) for r in places.orderBy("id").collect()] == [(46.9, 7.4), (None, None), (None, None), (None, None)]
    persons = hub.persons(spark.createDataFrame([("a", "Anna", "12", "gnd:7 ", None, "")], e))
    g = hub.record_triples(places.unionByName(persons)).collect()
    of = lambda s: {(r.p, r.o) for r in g if r.s == s}
    assert {("rdf:type", "wd:Q12"), ("schema:sameAs", "wd:Q12"), ("schema:sameAs", "gnd:7"), ("crm:P1_is_identified_by", "wd:Q12/name")} <= of("wd:Q12")
    assert ("geo:lat", "46.9") in of("wd:Q70") and not any(p == "schema:sameAs" for p, _ in of("wd:Q70"))
    assert not any(r.o == "" and r.p == "rdfs:label" for r in g)  # the place without a name
    other = spark.createDataFrame([("x", "role", "Vogt"), ("y", "care_action", ""), ("z", "thing", "Ding"), ("w", None, None)], "id string, kind string, name string")
    missing = {c: F.lit(None).cast(t) for c, t in hub.RECORD.items() if c not in other.columns}
    found = hub.record_triples(other.withColumns(missing))
    assert {(r.p, r.o) for r in found.collect()} == {("rdf:type", "sdhss:Role"), ("rdfs:label", "Vogt"), ("rdf:type", "crm:E7_Activity"), ("rdfs:label", ""), ("rdfs:label", "Ding")}
    assert hub.record_triples(other.withColumns(missing).limit(0)).count() == 0


def test_typed_literals(spark):
    g = spark.createDataFrame([("s", "p", "o", "iri"), ("s", "p", "a", "literal"), ("s", "p", "b", "literal@de"), ("s", "p", "1.5", "literal^^xsd:double")], "s string, p string, o string, kind string")
    assert [r.value for r in graph.n_triples(g).collect()] == ['<s> <p> "1.5"^^<xsd:double> .', '<s> <p> "a" .', '<s> <p> "b"@de .', "<s> <p> <o> ."]


def test_advance(spark):
    docs = spark.createDataFrame([("d",)], "doc_id string")
    done = state.new_states(docs).withColumn("status", F.when(F.col("stage") == "vlm", "done").otherwise("pending")).withColumn("stale", F.lit(True))
    log = [("d", "vlm", "error", 1), ("d", "kraken", "error", 2), ("d", "kraken", "done", 3), ("d", "kraken", "dirty", 4), ("d", "kraken", "done", 5), ("d", "agent_b", "done", 6), ("d", "agent_b", "dirty", 7), ("d", "x", "done", 8), ("d", "agent_d", None, 9), ("d", "agent_d", "odd", 10)]
    got = {r.stage: (r.status, r.version, r.stale) for r in state.advance(done, spark.createDataFrame(log, "doc_id string, stage string, status string, ord long")).collect()}
    assert len(got) == len(state.STAGES) and got["vlm"] == ("done", 0, True) and got["kraken"] == ("done", 5, False) and got["agent_b"] == ("dirty", 7, True) and got["agent_d"] == ("pending", 0, True)


def test_texts(spark):
    s = lambda *x: spark.createDataFrame([(v,) for v in x], "t string")
    got = [r[0] for r in s("abc дом", "дом a", "漢字かな abc", "12 !", "").select(T.dominant_script(F.col("t"))).collect()]
    assert got == ["Latin", "Cyrillic", "CJK", "", ""]
    rows = spark.createDataFrame([("e", "a b c d", "a b x d"), ("e", "a", None)], "engine string, reference string, text string")
    r = metrics.mean_rates(rows, ["engine"]).first()
    assert (r.n, r.mean_wer, round(r.mean_cer, 6)) == (2, 0.625, round((1 / 7 + 1) / 2, 6))
    d = spark.createDataFrame([([("x ", None), ("a", "X"), (" ", ""), ("x", "x")],), (None,)], "e array<struct<text:string,normalised:string>>")
    assert [r[0] for r in d.select(corpus.entity_names(F.col("e"))).collect()] == [["x", "X"], []]
    names = spark.createDataFrame([("urbar_1450",), ("urbar_1451",), ("missive",)], "name string")
    assert [r.name for r in fusion.suggest_ids(names, "urbar_145").collect()] == ["urbar_1450", "urbar_1451"]
    assert [r.name for r in fusion.suggest_ids(names, "URB").collect()] == ["urbar_1450", "urbar_1451"]
    readings = spark.createDataFrame([("p", 2, "c\n\n d "), ("p", 1, " a\r\nb"), ("q", 1, None)], "page string, n int, text string")
    assert {r.page: r.reconciled for r in fusion.stacked_lines(readings, ["page"], "n", n_lines=3).collect()} == {"p": "a\nb\nc", "q": ""}


def run(stream, name, seconds, rows):
    """All rows of a stream that runs until it has given so many, at most for the seconds given."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + seconds
        while time.time() < end and stream.sparkSession.table(name).count() < rows:
            assert q.exception() is None
            time.sleep(0.5)
    finally:
        q.stop()
    return stream.sparkSession.table(name).collect()


@pytest.fixture
def events(spark, tmp_path):
    def make(rows, schema):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema.replace("ts string", "ts timestamp")).parquet(str(tmp_path / "in"))

    return make


def test_settled(events):
    rows = [("a", "f1", "2024-01-01 00:00:00"), ("a", "f3", "2024-01-01 00:00:02"), ("a", "f2", "2024-01-01 00:00:01"), ("b", "g", "2024-01-01 00:00:00"), (None, "x", "2024-01-01 00:00:00")]
    got = run(state.settled(events(rows, "stem string, path string, ts string"), "stem", "path", "ts", quiet_ms=500), "settled", 60, 2)
    assert {(r.stem, r.path, r.n_events) for r in got} == {("a", "f3", 3), ("b", "g", 1)}


def test_gate_outcomes(events):
    rows = [("a", None, "2024-01-01 00:00:00"), ("a", "no", "2024-01-01 00:00:03"), ("a", "yes", "2024-01-01 00:00:02"), ("b", None, "2024-01-01 00:00:00"), ("c", "late", "2024-01-01 00:00:00")]
    got = run(state.gate_outcomes(events(rows, "gate string, answer string, ts string"), "gate", "answer", "ts", minutes=0.02), "gates", 60, 2)
    assert {(r.gate, r.answer, r.decided_by) for r in got} == {("a", "yes", "human"), ("b", None, "timeout")}
