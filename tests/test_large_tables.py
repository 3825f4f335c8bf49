"""Steps that once held only for small tables."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from codexlake.functions import edits, text as T
from codexlake.operators import metrics, resolve, selection, vectors
from codexlake.plans import queries
from codexlake.plans.oracle import SQL
from codexlake.sources.parallel import paired


def test_a_registry_of_any_size(spark):
    n = 12_000
    lines = spark.range(n).select(F.concat(F.lit("l"), "id").alias("model_id"), F.col("id").alias("ordinal"), F.when(F.col("id") < n - 5, "fr").otherwise("de").alias("lang"), F.lit("htr").alias("task"), F.lit("line").alias("name"), F.lit("").alias("notes"))
    asked = spark.createDataFrame([(1, "", "deutsch", 15, None), (2, "", "französisch", 14, None), (3, "", "deutsch", 15, None)], "doc_id int, script string, lang string, century int, document_type string")
    got = sorted((r.doc_id, r["rank"], r.model_id) for r in selection.rank_line_models(asked, lines, ["doc_id"]).collect())
    assert got == [(d, k + 1, f"l{first + k}") for d, first in ((1, n - 5), (2, 0), (3, n - 5)) for k in range(3)]
    pages = lines.select("model_id", "ordinal", F.lit("textura").alias("script"), "lang", F.array(F.lit(15)).alias("centuries"), "notes")
    got = sorted((r.doc_id, r["rank"], r.model_id) for r in selection.rank_models(asked, pages, ["doc_id"], 1).collect())
    assert got == [(1, 1, f"l{n - 5}"), (2, 1, "l0"), (3, 1, f"l{n - 5}")]


def test_kmeans_stops_where_its_sql_stops(spark, tmp_path):
    """Starts at one end of a line and creeps along it for more than 100 rounds; 0.1 and its like make sums depend on their order unless they are exact."""
    ids = sorted(range(10_000), key=lambda i: hashlib.sha256(f"0:{i}".encode()).hexdigest())
    x = np.sort(np.random.default_rng(3).random(10_000) ** 2).astype(np.float32)
    spark.createDataFrame([(i, [float(v), 0.1]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.cluster for r in queries.kmeans_labels(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == dict(db.execute(SQL["kmeans_labels"]).fetchall())
    start = {i: vectors.kmeans(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), 8, draw=F.sha2(F.concat(F.lit("0:"), F.col("vec_id").cast("string")).cast("binary"), 256), iterations=i) for i in (90, 100)}
    assert start[90].exceptAll(start[100]).count() > 0  # still creeping


def test_pairs_of_one_page_are_dealt_out(spark):
    readings = spark.createDataFrame([(1, i, "abc" * (i + 1)) for i in range(30)], "page int, ord int, text string")
    pairs = metrics.pairwise_cer(readings, ["page"], "ord")
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and pairs.count() == 435
    assert [r.max_cer for r in metrics.max_cer_symmetric(readings, ["page"], "ord").collect()] == [29.0]


def test_search_holds_few_similarities_at_once(monkeypatch):
    monkeypatch.setattr(vectors, "CELLS", 100)
    rows = [{"query": i, "q": [1.0, float(i)]} for i in range(60)]
    batch = pd.DataFrame({"vec_id": range(20), "embedding": [[1.0, float(i)] for i in range(20)]})
    parts = list(vectors._scored(rows, 3, "vec_id", "embedding", 9)([batch]))
    assert max(map(len, parts)) == 15 and sum(map(len, parts)) == 180
    assert [tuple(x) for x in pd.concat(parts).groupby("query").vec_id.first().items()] == [(i, min(i, 19)) for i in range(60)]


def test_letters_are_counted_by_runs(spark):
    df = spark.createDataFrame([("abc αβ 1",), ("",), (None,), ("\U0001d54f\U00010400é-ж",), ("12 !",)], "t string")
    for script in ("Latin", "Greek"):
        share = T.script_share(F.col("t"), script)
        want = F.coalesce(F.try_divide(F.regexp_count("t", F.lit(rf"\p{{Is{script}}}")), F.regexp_count("t", F.lit(r"\p{L}"))), F.lit(1.0))
        assert df.where(~share.eqNullSafe(want)).count() == 0 and "regexp_count" not in str(share)


def test_each_pair_of_a_group_meets_once_in_some_cell(spark):
    rows = [("x", i // 2, i) for i in range(41)] + [("y", 1, 50), ("z", None, 60), ("z", 3, 61), ("z", 4, 62), (None, 1, 70), (None, 2, 71)]
    got = [(r.g, r.a_i, r.b_i) for r in paired(spark.createDataFrame(rows, "g string, o int, i int").repartition(3), ["g"], "o", 4).collect()]
    want = [(g, i, j) for g, o, i in rows for h, q, j in rows if g and g == h and o is not None and q is not None and o < q]
    assert sorted(got) == sorted(want)


def test_persons_of_one_key_are_compared_in_many_places(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 10, raising=False)
    schema = "pid int, source string, name string, forename string, surname string, life_dates string, gnd_id string, hls_id string, wikidata_id string, variants array<string>"
    rows = [(i, "s", "Anna Egli", "Anna", "Egli", f"{1200 + i % 9 * 20}", "g1" if i % 2 else "", "h1" if i % 3 else None, None, ["Anna E."]) for i in range(95)]
    edges = resolve.match_edges(spark.createDataFrame(rows, schema))
    want = {}
    for a in range(95):
        for b in range(a + 1, 95):
            if a % 2 and b % 2 or a % 3 and b % 3 or abs(a % 9 - b % 9) <= 1:
                want[a, b] = "high"
    assert sorted(tuple(r) for r in edges.collect()) == sorted((*k, v) for k, v in want.items())
    assert edges.select(F.input_file_name().alias("f")).distinct().count() > 1  # one key, several tasks


PERSON = "pid long, source string, name string, forename string, surname string, life_dates string, gnd_id string, hls_id string, wikidata_id string, variants array<string>"


def test_pairs_of_persons_are_not_stored(spark):
    """What the result reads grows with blocks of persons, not with their pairs."""
    rows = [(i, "s", "Anna Egli", "", "", None, f"g{i}", None, "Q1", None) for i in range(2000)]  # an id of its own separates nobody
    edges = resolve.match_edges(spark.createDataFrame(rows, PERSON))
    assert edges.count() == edges.distinct().count() == 1_999_000
    assert spark.read.parquet(*edges.inputFiles()).count() <= 100


def test_runs_of_persons_give_the_pairs_of_the_rules(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 7)
    monkeypatch.setattr(resolve, "PIECE", 3)
    draw = random.Random(4)
    rows = []
    for i in draw.sample(range(1000), 160):
        dates = None if draw.random() < 0.2 else f"{(y := draw.randrange(1200, 1500, 10))}-{y + draw.choice([0, 40])}"
        ids = [draw.choice([None, "", "", f"{c}{draw.randrange(5)}"]) for c in "ghw"]
        rows.append((i, "s", draw.choice([None, "", "anna egli", "bert frey", "cas gut"]), draw.choice([None, "", "a", "b", "b\tc"]), draw.choice([None, "", "x", "a", "a\tb"]), dates, *ids, draw.choice([None, [], ["!", "c"], ["c", "d"], ["d", None, "e"]])))

    def years(r):
        return tuple(map(int, r[5].split("-"))) if r[5] else None

    def names(r):
        return {" ".join(n.replace("!", "").split()) for n in [r[2], *(r[9] or [])] if n}

    def rule(p, q):
        if any(p[k] and p[k] == q[k] for k in (6, 7, 8)):
            return "high"
        x, y = years(p), years(q)
        meet = None if not x or not y else x[0] - 25 <= y[1] and y[0] - 25 <= x[1]
        if p[2] and p[2] == q[2]:
            return {None: "medium", True: "high", False: None}[meet]
        if p[4] and p[4] == q[4] and (p[3] and p[3] == q[3] or names(p) & names(q)) and meet:
            return "medium"

    want = sorted((p[0], q[0], label) for p in rows for q in rows if p[0] < q[0] and (label := rule(p, q)))
    got = resolve.match_edges(spark.createDataFrame([*rows, (None, "s", "anna egli", "", "", None, "g1", None, None, None)], PERSON)).collect()
    assert sorted(tuple(r) for r in got) == want and len({r.confidence for r in got}) == 2


def _texts(n):
    draw = random.Random(5)
    for _ in range(n):
        letters = draw.choice(["ab", "abcdefghij ", "aäß€\U0001f600中", "".join(map(chr, range(0x4E00, 0x4F00)))])
        a = "".join(draw.choices(letters, k=draw.choice([0, 1, 2, 5, 63, 64, 65, 127, 128, 129, draw.randrange(400)])))
        near = "".join(c for c in a if draw.random() < 0.9) + draw.choice(["", "x"])
        yield a, draw.choice([near, near, a, "".join(draw.choices(letters, k=draw.randrange(300)))])


def test_edits_of_many_pairs_at_a_time(spark, monkeypatch):
    rows = [*_texts(300), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where(~edits.edits("a", "b").eqNullSafe(F.levenshtein("a", "b"))).count() == 0
    want = edits.edit_counts(*map(list, zip(*rows[:300]))).tolist()
    monkeypatch.setattr(edits, "WORDS", 1)
    monkeypatch.setattr(edits, "TABLE", 1)
    assert edits.edit_counts(*map(list, zip(*rows[:300]))).tolist() == want and edits.edit_counts([], []).tolist() == []


def test_gate_rates_only_pages_that_lengths_leave_open(spark, monkeypatch):
    rows = [(d, o, t) for d in range(60) for o, (t, _) in enumerate(_texts(d % 7 + 20))][::3]
    rows += [(100, 1, "a" * 10), (100, 2, "a" * 18), (101, 1, "a" * 10), (101, 2, "a" * 19), (102, 2, "ab"), (102, 1, "abcd"), (103, 1, "x"), (104, 1, "a"), (104, 1, "abcde"), (105, None, "a"), (105, 1, "abcde"), (None, 1, "a"), (None, 2, "abcde"), (106, 1, "!"), (106, 2, "abc"), (107, 1, "ab"), (107, 2, "cd"), (108, 1, "  "), (108, 2, "a")]
    df = spark.createDataFrame(rows, "page int, ord int, text string")
    for threshold, options in ((0.8, {}), (0.3, {}), (1.0, {"ignore_case": True}), (0.8, {"ignore_punctuation": True})):
        want = metrics.gate(metrics.max_cer(metrics.pairwise_cer(df, ["page"], "ord", **options), ["page"]), threshold)
        got = metrics.gate_readings(df, ["page"], "ord", threshold=threshold, **options)
        assert sorted(map(tuple, got.collect())) == sorted((r.page, r.block) for r in want.collect())
    seen, rate = [], metrics.pairwise_cer
    monkeypatch.setattr(metrics, "pairwise_cer", lambda r, *a, **k: seen.append(r) or rate(r, *a, **k))
    many = spark.createDataFrame([(1, i, "ab" * (i + 1)) for i in range(50)] + [(2, 1, "ab"), (2, 2, "ac")], "page int, ord int, text string")
    assert sorted(map(tuple, metrics.gate_readings(many, ["page"], "ord", threshold=0.8).collect())) == [(1, True), (2, False)]
    assert [r.page for r in seen[0].select("page").distinct().collect()] == [2]


def test_pairs_are_made_and_rated_in_one_step(spark):
    readings = spark.createDataFrame([(1, i, f"{i:b}") for i in range(100)], "page int, ord int, text string")
    pairs = metrics.pairwise_cer(readings, ["page"], "ord")
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "levenshtein" not in plan and "ArrowEvalPython" in plan
    assert "Exchange" not in plan[: plan.index("Join")] and "REPARTITION" not in plan[: plan.index("Join")]  # texts aren't sent pair by pair
    want = {(1, i, j): r for i, j, r in pairs.select("a", "b", "cer").collect()}
    texts = spark.createDataFrame([(i, j, f"{i:b}", f"{j:b}") for i in range(100) for j in range(i + 1, 100)], "i int, j int, x string, y string")
    assert want == {(1, i, j): r for i, j, r in texts.select("i", "j", F.levenshtein("x", "y") / F.length("x")).collect()}
