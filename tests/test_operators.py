import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexlake.operators import components, entities, feedback, fusion, graph, providers, resolve, selection, strengths, vectors


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)] + [(9000, 9001 + i) for i in range(200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(df.limit(0)).collect() == []


def test_bradley_terry(spark):
    rows = [("b", "x", "y", 1.0)] * 8 + [("b", "y", "x", 1.0)] * 2 + [("b", "y", "z", 1.0)] * 6 + [("b", "z", "y", 1.0)] * 4 + [("thin", "x", "y", 1.0)]
    df = spark.createDataFrame(rows, "bucket string, winner string, loser string, weight double")
    got = strengths.bradley_terry(df, ["bucket"]).collect()
    s = {r.model: r.strength for r in got if r.sufficient}
    assert s["x"] / (s["x"] + s["y"]) == pytest.approx(0.8, abs=1e-6) and s["y"] / (s["y"] + s["z"]) == pytest.approx(0.6, abs=1e-6)
    assert sum(s.values()) == pytest.approx(3) and [r.model for r in got if not r.sufficient] == [None]
    assert {r.model: r.prior_score for r in strengths.prior_scores(strengths.bradley_terry(df, ["bucket"]), ["bucket"]).collect()} == {"x": 0.15}


def test_bradley_terry_over_rows_agrees_with_the_matrix(spark):
    import random

    limits = {"iterations": 6, "tolerance": 1e-3}  # both forms agree after any number of rounds; some buckets settle before
    draw = random.Random(2)
    rows = [(b, draw.choice("abcdefghij"), draw.choice("klmnaefg"), float(draw.randrange(1, 4)) / 2) for b in ("x", "y", None) for _ in range(60)]
    rows = [r for r in rows if r[1] != r[2]] + [("settled", "a", "b", 5.0), ("settled", "b", "a", 5.0), ("thin", "a", "b", 1.0), ("small", "a", "b", 20.0), ("small", "b", "a", 1.0)]
    df = spark.createDataFrame(rows, "bucket string, winner string, loser string, weight double")
    value = lambda df: {(r.bucket, r.model): tuple(r)[1:] for r in df.collect()}
    dense, mixed = value(strengths.bradley_terry(df, ["bucket"], **limits)), value(strengths.bradley_terry(df, ["bucket"], dense_models=1, **limits))
    assert dense.keys() == mixed.keys()
    for k, row in dense.items():
        for a, b in zip(row, mixed[k]):
            assert (a is None or a != a) == (b is None or b != b) and (not isinstance(a, float) or a != a or b == pytest.approx(a, abs=1e-7)), k


def test_kmeans_leaves_out_what_is_no_vector(spark):
    rows = [(i, [float(i % 2) * 10 + i * 0.01, 1.0]) for i in range(40)] + [(100, None), (101, [1.0]), (102, [None, 1.0]), (103, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.cluster for r in vectors.kmeans(df, 2).collect()}
    assert set(got) == set(range(40)) and len({(i % 2, c) for i, c in got.items()}) == 2
    assert vectors.kmeans(df.limit(0), 2).collect() == []


def test_few_links_give_the_components_of_all_edges(spark):
    import random

    draw = random.Random(11)
    pick = lambda *x: draw.choice(x)
    schema = "pid long, source string, name string, forename string, surname string, life_dates string, gnd_id string, hls_id string, wikidata_id string, variants array<string>"
    for _ in range(4):
        rows = []
        for i in range(120):
            first, last = pick("Anna", "Bert", "Cäsar"), pick("Egli", "Frey", "Gut", "")
            dates = None if draw.random() < 0.3 else f"{(y := draw.randrange(1200, 1500))}-{y + draw.randrange(0, 60)}"
            rows.append((i, pick("x", "y"), pick(f"{first} {last}", first, "", f"{first} von {last}"), pick(first, ""), pick(last, ""), dates, pick(None, "", "", "", f"g{draw.randrange(60)}"), None, "", pick(None, [], [last, None], [f"{first} {last}"])))
        df = spark.createDataFrame(rows, schema)
        all_, few = resolve.match_edges(df), resolve.match_links(df)
        value = lambda e: {tuple(r) for r in resolve.clusters(df, e).collect()}
        assert value(few) == value(all_)
        assert len({r.cluster for r in resolve.clusters(df, few).collect()}) > 5
    same = spark.createDataFrame([(i, "x", "Anna Egli", "", "", f"{1200 + i % 3}", None, None, None, None) for i in range(500)], schema)
    assert resolve.match_links(same).count() < 1000  # all edges would be 124,750
    assert resolve.match_links(df.limit(0)).collect() == []


def test_comparisons(spark):
    schema = "offered array<struct<engine:string,model_id:string>>, chosen array<string>, combined boolean, rejected boolean, k int"
    offered = [("kraken", "m1"), ("vlm", ""), ("trocr", "m2")]
    df = spark.createDataFrame([(offered, ["kraken/m1", "vlm"], True, False, 1), (offered, ["vlm"], False, True, 1), (offered, [], False, False, 1)], schema)
    assert sorted(tuple(r) for r in feedback.comparisons(df, ["k"]).collect()) == [(1, "kraken/m1", "trocr/m2", 0.5), (1, "vlm", "trocr/m2", 0.5)]


def test_record_selection(spark):
    offered = spark.createDataFrame([("d", "p1:kraken/a", 1), ("d", "p1:vlm", 2), ("d", "p2:vlm", 1)], "doc_id string, label string, auto_rank int")
    choices = spark.createDataFrame([("d", "p1:vlm", "v", "t"), ("d", "p9:x", "v", "t")], "doc_id string, label string, voter string, ts string")
    context = spark.createDataFrame([("d", "textura", 15, "de")], "doc_id string, script string, century int, lang string")
    (one,) = feedback.record_selection(choices, offered, context).collect()
    assert (one.page, one.chosen, one.auto_pick, one.script) == ("p1", ["vlm"], "kraken/a", "textura")
    assert {r.page for r in feedback.record_selection(choices.limit(1), offered, context, rejected=True).collect()} == {"p1", "p2"}


def test_fusion(spark):
    rows = [
        ("a", 1, "x", "der graf von bern gab das gut", 0.5), ("a", 2, "y", "der graf von born gab das gut", 0.9), ("a", 3, "z", "der graf uon bern gab das", 0.1),
        ("b", 1, "x", "nur eine", 0.1), ("c", 1, "x", "ganz anders", 0.2), ("c", 2, "y", "völlig verschieden hier", 0.7), ("d", 1, "x", "  ", 0.1),
    ]
    df = spark.createDataFrame(rows, "page string, ord int, engine string, text string, conf double")
    got = {r.page: r for r in fusion.fuse(df, ["page"], "engine", "ord", confidence=F.col("conf")).collect()}
    assert got["a"].fused == "der graf von bern gab das gut" and got["a"].strategy == "vote" and got["a"].contested == 0
    assert got["b"].strategy == "single" and got["c"].strategy == "no-merge" and got["c"].fused == "völlig verschieden hier" and "d" not in got
    spots = {r.token: (r.idx, r.chars_start) for r in fusion.disagreements(df.where("page = 'a'"), ["page"], "engine", "ord").collect()}
    assert spots == {"von": (2, 9), "bern": (3, 13)}
    voted = fusion.with_context(fusion.vote(fusion.align(df.where("page = 'a'"), ["page"], "engine", "ord")), ["page"])
    assert {r.idx: r.context for r in voted.collect()}[3] == "der graf von"
    assert [r.text for r in fusion.spans(fusion.vote(fusion.align(df.where("page = 'b'"), ["page"], "engine", "ord")), ["page"]).collect()] == ["nur eine"]


def test_inserted_words(spark):
    """The first of the longest readings is the pivot; words inserted before its start are dropped."""
    df = spark.createDataFrame([("p", 1, "x", "a b c d e"), ("p", 2, "y", "q a b new c")], "page string, ord int, engine string, text string")
    got = {r.idx: dict(r.readings) for r in fusion.align(df, ["page"], "engine", "ord").collect()}
    assert [got[i]["x"] for i in range(5)] == list("abcde") and [got[i]["y"] for i in range(5)] == ["a", "b new", "c", "", ""]
    assert fusion.disagreements(df, ["page"], "engine", "ord").count() == 0


def test_reconcile(spark):
    df = spark.createDataFrame([("a\nb", "a\nb"), ("", "x"), ("x", None), ("a\nb\nc", "a\nz\nc\nd")], "f string, s string")
    got = fusion.reconcile(df, "f", "s").collect()
    assert [r.method for r in got] == ["agreement", "second only", "first only", "merge"]
    assert got[3].reconciled == "a\nb\nc\n[+1]\nd" and got[3].second_only == ["z", "d"]


def test_resolve(spark):
    schema = "pid int, source string, name string, forename string, surname string, life_dates string, gnd_id string, hls_id string, wikidata_id string, variants array<string>"
    rows = [
        (1, "s1", "Hans von Müller", "Hans", "Müller", "1300-1370", "", None, None, ["Johann Müller"]),
        (2, "s2", "Hans Muller", "Hans", "Muller", "1310", "", None, None, []),
        (3, "s2", "Hans Müller", "Hans", "Müller", "1600", "", None, None, None),
        (4, "s3", "Jean Meunier", "Jean", "Meunier", None, "118", None, None, []),
        (5, "s1", "J. M.", None, None, None, "118", None, None, []),
        (6, "s3", "Johann Müller", "Johann", "Müller", "1340", "", None, None, []),
    ]
    p = spark.createDataFrame(rows, schema)
    edges = resolve.match_edges(p)
    assert sorted(tuple(r) for r in edges.collect()) == [(1, 2, "high"), (1, 6, "medium"), (4, 5, "high")]
    merged = {r.cluster: r for r in resolve.merge(p, resolve.clusters(p, edges)).collect()}
    assert sorted(merged) == [1, 3, 4] and merged[1].name == "Hans von Müller" and merged[1].confidence == "high" and merged[1].sources == ["s1", "s2", "s3"]
    assert merged[1].variants == ["Hans von Müller", "Johann Müller", "Hans Muller"] and not merged[3].needs_review and merged[4].gnd_id == "118"


def test_lookup_and_upsert(spark):
    mentions = spark.createDataFrame([(1, "d1", "Müller", "PERSON", "", "c"), (2, "d2", "Muller", "PERSON", "", "c"), (3, "d3", "Müller", "PLACE", "", "c"), (4, "d3", "", "PLACE", "", "c")], "ord int, doc_id string, name string, type string, gnd string, context string")
    index = entities.entity_index(mentions.withColumn("hls", F.lit(None).cast("string")).withColumn("wikidata", F.lit("")))
    got = {r.slug: (r.type, r.n_mentions) for r in index.collect()}
    assert got == {"mueller": ("PERSON", 2), "mueller-2": ("PLACE", 1)}
    names = spark.createDataFrame([("Mueller",), ("MULLER",), ("nobody",)], "query string")
    assert {r.query: r.slug for r in entities.lookup(index, names).collect()} == {"Mueller": "mueller", "MULLER": "mueller"}
    table = spark.createDataFrame([("1", "old", 1), ("", "no id", 2)], "id string, v string, ord int")
    rows = spark.createDataFrame([("1", "new", 3), ("2", "add", 4)], "id string, v string, ord int")
    assert sorted(r.v for r in entities.upsert(table, rows, "id", "ord").collect()) == ["add", "new", "no id"]


def test_vocabulary_and_dump(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abAB "), n))
    entries = [(word(rng.integers(0, 7)), i) for i in range(60)] + [(None, 99)]
    terms = [word(rng.integers(0, 10)) for _ in range(80)] + [None, "  "]
    want = {}
    for t in terms:
        low = (t or "").strip(" ").lower()
        hits = [(e.lower() != low, i, e) for e, i in entries if e and low and (e.lower() == low or len(e) >= 4 and (e.lower() in low or low in e.lower()))]
        want[t] = min(hits)[2] if hits else None
    v = spark.createDataFrame(entries, "entry string, ord int")
    got = entities.match_vocabulary(spark.createDataFrame([(t,) for t in terms], "term string"), v)
    assert {r.term: r.entry for r in got.collect()} == want
    dump = spark.createDataFrame([("1", "Bern", ["Berne"], "place", 1), ("2", "Bernhard", None, "person", 2), ("3", "Berner", [""], None, 3), ("4", None, ["Abernathy"], "person", 4)], "id string, name string, variants array<string>, type string, ord int")
    q = spark.createDataFrame([("bern",), (" ",), (None,), ("Anna Bernhard",)], "query string")
    assert sorted((r["query"], r.nth, r.id) for r in entities.search_dump(q, dump, "person").collect()) == [("Anna Bernhard", 1, "2"), ("bern", 1, "2"), ("bern", 2, "3"), ("bern", 3, "4")]
    people = spark.createDataFrame([("d", 1, "bern", "PERSON", "none", "high"), ("d", 2, "nobody", "PLACE", "none", "high")], "doc string, ord int, name string, type string, link_method string, confidence string")
    items = {r.name: [c.id for c in r.candidates] for r in entities.review_items(people, entities.search_dump(q, dump, "person"), "doc", "ord", k=2).collect()}
    assert items == {"bern": ["2", "3"], "nobody": []}


def test_text_regret_and_fusion_gain(spark):
    from codexlake.operators import metrics

    events = spark.createDataFrame([("a", "x", ["y"]), ("b", "x", ["x"]), ("c", "x", ["gone"]), ("d", "x", ["y", "z"]), ("e", None, ["y"])], "doc string, auto_pick string, chosen array<string>")
    texts = spark.createDataFrame([(d, c, t) for d in "abcde" for c, t in (("x", "abcd"), ("y", "abcf"))], "doc string, candidate string, text string")
    assert {r.doc: r.regret for r in feedback.text_regret(events, texts, ["doc"]).collect()} == {"a": 0.25, "c": None, "d": None}
    kept = spark.createDataFrame([("d", "abxx"), ("c", "")], "doc string, text string")
    assert {r.doc: r.regret for r in feedback.text_regret(events, texts, ["doc"], kept).collect()} == {"a": 0.25, "c": None, "d": 0.5}
    cers = spark.createDataFrame([("a", "e", 1, 0.5), ("b", "e", 1, 0.0)], "doc string, engine string, ord int, cer double")
    fused = spark.createDataFrame([("a", "abcd", "abcd"), ("b", "abcd", "")], "doc string, reference string, fused string")
    assert {r.doc: r.fusion_beats_best for r in metrics.fusion_gain(cers, fused, ["doc"]).collect()} == {"a": True, "b": None}


def test_alignment_against_opcodes(spark):
    """What lies beside each word of the longest reading, by the edit operations of two word lists."""
    import difflib

    rng = np.random.default_rng(7)
    rows = [(p, o, f"e{o}", " ".join(rng.choice(list("abcde"), rng.integers(1, 9)))) for p in range(25) for o in range(2)]
    df = spark.createDataFrame([(int(p), int(o), e, t) for p, o, e, t in rows], "page int, ord int, engine string, text string")
    got = {(r.page, r.idx): dict(r.readings) for r in fusion.align(df, ["page"], "engine", "ord").collect()}
    for p in range(25):
        a, b = [t.split() for q, _, _, t in rows if q == p]
        (own, other), (me, you) = ((a, b), ("e0", "e1")) if len(a) >= len(b) else ((b, a), ("e1", "e0"))
        beside = [""] * len(own)
        for op, i, i2, j, j2 in difflib.SequenceMatcher(None, own, other, autojunk=False).get_opcodes():
            if op == "equal":
                beside[i:i2] = other[j:j2]
            elif op == "replace":
                beside[i] = " ".join(other[j:j2])
            elif op == "insert" and i:
                beside[i - 1] = f"{beside[i - 1]} {' '.join(other[j:j2])}".strip()
        assert [got[p, i] for i in range(len(own))] == [{me: w, you: x} for w, x in zip(own, beside)]


def test_dedup_extracted(spark):
    rows = [("t", "P", 1, "first"), ("t", "P", 2, ""), ("u", "P", 3, ""), ("u", "P", 4, ""), ("v", "P", 5, "a"), ("v", "P", 6, "b")]
    df = spark.createDataFrame(rows, "text string, type string, ord int, context string")
    assert {r.text: r.ord for r in entities.dedup_extracted(df, ["text", "type"], "ord").collect()} == {"t": 1, "u": 3, "v": 6}


def test_graph(spark):
    j = spark.createDataFrame([(1, "e", "m")], "doc_id int, engine string, model_id string").withColumn("ord", F.lit(1))
    g = graph.union(graph.document_triples(j), graph.reading_triples(graph.readings_of(j, "doc_id", "engine", "ord")))
    found = graph.match(g, ("?d", "crm:P128_carries", "?r"), optional=(("?d", "ex:closestReading", "?s"),)).first()
    assert (found.d, found.r, found.s) == ("doc:1", "reading:1/e", None)
    lines = [r.value for r in graph.n_triples(g).collect()]
    assert lines == sorted(lines) and '<doc:1> <rdfs:label> "1" .' in lines


def test_providers(spark):
    def ask(row):
        if row["k"] == 2:
            raise RuntimeError("down")
        return f"answer {row['k']}"

    got = {r.k: (r.answer, r.error) for r in providers.call(spark.range(1, 4).toDF("k"), ask, ["k"]).collect()}
    assert got == {1: ("answer 1", None), 2: (None, "down"), 3: ("answer 3", None)}
    hits, failed = providers.federated(spark.createDataFrame([("q",)], "query string"), ["a", "b"], lambda s, q: [{"pid": s}] if s == "a" else 1 / 0, "pid string")
    assert [(r.source, r.pid) for r in hits.collect()] == [("a", "a")] and [r.source for r in failed.collect()] == ["b"]


def test_expansion_stops_where_pages_agree(spark):
    pages = spark.createDataFrame([("same",), ("differs",)], "page string")
    reader = lambda n: lambda p: p.select("page", F.lit(f"e{n}").alias("engine"), F.when(F.col("page") == "same", "text").otherwise(f"text{n}" * 3).alias("text"))
    spread = lambda r: r.groupBy("page").agg(F.when(F.count_distinct("text") > 1, 1.0).otherwise(0.0).alias("max_cer"))
    got = providers.expand_until_agreed(pages, [reader(i) for i in range(4)], spread, start=2)
    assert {r["page"]: r["count"] for r in got.groupBy("page").count().collect()} == {"same": 2, "differs": 4}


def test_kmeans_and_search(spark):
    rows = [(i, [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = {r.vec_id: r.cluster for r in vectors.kmeans(df, 2).collect()}
    assert len({got[i] for i in range(0, 40, 2)}) == 1 and got[0] != got[1]
    embedded = vectors.embed(spark.createDataFrame([(1, "ab"), (2, " ")], "doc_id int, text string"), lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert [(r.doc_id, r.embedding) for r in embedded.collect()] == [(1, [2.0, 1.0])]
    assert [r.vec_id for r in vectors.nearest(df, [0.0, 1.0], 2).collect()] == [0, 1]


def test_nearest_of_each(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.integers(-2, 3, size=(300, 4)).astype(np.float32)  # many equal directions, some zero vectors
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(300, None)], "vec_id int, embedding array<float>").repartition(5)
    m = np.vstack([m, np.zeros(4)]).astype(float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    similar = np.round(unit @ unit.T, 9)
    want = {(q, r + 1, int(v)) for q in range(0, 301, 50) for r, v in enumerate(np.lexsort((np.arange(301), -similar[q]))[:7])}
    for block in (4096, 2):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        got = vectors.nearest_of_each(df, df.where("vec_id % 50 = 0"), 7).collect()
        assert {(r["query"], r["rank"], r.vec_id) for r in got} == want
    assert vectors.nearest_of_each(df.limit(0), df.where("vec_id = 0"), 3).collect() == [] == vectors.nearest_of_each(df, df.limit(0), 3).collect()


def test_kmeans_runs_until_labels_are_stable(spark):
    """The border between two centroids that start at one end creeps along the line for more than 20 rounds."""
    points = np.random.default_rng(1).random(600)
    x = np.sort(points**3).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "vec_id int, embedding array<float>")
    start = [r.vec_id for r in df.orderBy(F.xxhash64(F.lit(0), "vec_id"), "vec_id").limit(8).collect()]
    data, centroids, labels, rounds = x.astype(float), x[start].astype(float), None, 0
    while True:
        new = np.argmin((data[:, None] - centroids[None]) ** 2, axis=1)
        if labels is not None and (new == labels).all():
            break
        labels, rounds = new, rounds + 1
        centroids = np.array([data[labels == c].mean() if (labels == c).any() else centroids[c] for c in range(8)])
    assert 22 < rounds < 100
    got = {r.vec_id: r.cluster for r in vectors.kmeans(df, 8).collect()}
    assert [got[i] for i in range(len(x))] == labels.tolist()


def test_gates(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("bad",), ("2024-01-01T00:30:01+00:00",)], "ts string")
    got = [r.x for r in df.select(selection.expired(F.col("ts"), F.lit("2024-01-01T00:30:01Z").cast("timestamp")).alias("x")).collect()]
    assert got == [True, False, False]


def test_merge_chunks(spark):
    from codexlake.operators.corpus import merge_chunk_results

    df = spark.createDataFrame([("d", 1, ["b"], {"k": "new"}), ("d", 0, ["a"], {"k": "old", "j": "x"})], "doc string, nth int, items array<string>, fields map<string,string>")
    (r,) = merge_chunk_results(df, "doc", "nth", "items", "fields").collect()
    assert r["items"] == ["a", "b"] and r.fields == {"k": "new", "j": "x"}
    assert json.dumps(r["items"])
