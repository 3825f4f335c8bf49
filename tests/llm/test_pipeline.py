import hashlib
import random

import pytest
from brute import docs_frame, line_dedup, words

import corpus_pipeline as cp
from codexlake.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(a.lower()), words(b.lower()))]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("lo", "mi", "an", "ther", "wi") for b in ("rem", "psum", "th", "ing", "ou", "é") for c in ("a", "e", "us", "ing", "or")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = {d: text(rng.randrange(60, 400)) for d in range(150)}
    for d in range(20):
        rows[200 + d] = rows[d]
        w = rows[20 + d].split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        rows[300 + d] = " ".join(w)
        rows[400 + d] = rows[40 + d].split("\n")[0] + "\nThis very line is on twenty pages.\n" + text(80)
        rows[500 + d] = " ".join(f"{w}***" for w in text(90).split())
        rows[600 + d] = text(20)
    items = [(i, text(30)) for i in range(10)]
    for i, t in items:
        rows[700 + i] = f"{text(50)} {t} {text(50)}"
    folder = tmp_path_factory.mktemp("corpus")
    docs = docs_frame(spark, [(d, t, "en", "a") for d, t in rows.items()] + [(None, None, None, None), (900, "", "en", "a"), (901, rows[1], "en", "a"), (901, rows[1], "en", "a")])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, str(folder)


def test_stages(spark, corpus):
    rows, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, folder)
        if i < 4:
            assert docs.columns == COLUMNS
            docs = docs.cache()
        seen.append({r.doc_id: r for r in docs.collect()})
    good = set(rows) - set(range(500, 520)) - set(range(600, 620)) | {901}
    assert set(seen[0]) == good
    lines = {d: sha for d, _, _, sha in line_dedup([(r.doc_id, r.text) for r in seen[0].values()])}
    assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in seen[1].items()} == lines
    gone = set(seen[1]) - set(seen[2])
    texts = {d: r.text for d, r in seen[1].items()}
    empty = {d for d, t in texts.items() if not words(t)}
    likest = {d: max((jaccard(t, u) for o, u in texts.items() if o < d), default=0) for d, t in texts.items() if d not in empty}
    assert {d for d, j in likest.items() if j >= 0.86} <= gone and {*range(202, 220)} <= gone
    assert min(likest[d] for d in gone - empty) > 0.7, sorted((round(likest[d], 3), d, len(words(texts[d]))) for d in gone - empty)[:8]
    assert empty - gone == {min(empty)}
    assert set(seen[2]) - set(seen[3]) == set(range(700, 710)) - gone
    assert set(seen[4]) == set(seen[3])
    run = cp.run(spark, folder)
    assert {r.doc_id for r in run.collect()} == set(seen[4])


def test_empty_tables(spark, corpus):
    _, folder = corpus
    for i, (_, stage) in enumerate(cp.STAGES):
        assert stage(spark, docs_frame(spark, []), folder).collect() == []


def test_192_bits_follow_the_shingles(spark):
    """Copies with few changed words are linked, texts that share half their shingles aren't."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, alike = [], set()
    for d in range(40):
        base = [word() for _ in range(500)]
        near, far = list(base), list(base)
        for at in rng.sample(range(500), 4):
            near[at] = word()
        for at in range(0, 500, 12):
            far[at] = word()
        rows += [(3 * d, " ".join(base), "en", "a"), (3 * d + 1, " ".join(near), "en", "a"), (3 * d + 2, " ".join(far), "en", "a")]
        alike.add(3 * d + 1)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_frame(spark, rows)).collect()}
    assert {d for d, *_ in rows} - kept == alike


def test_groups_are_components_of_exact_similarity(spark):
    """Pairs on both sides of 0.8: the 192 bits alone lose some and link others."""
    rng = random.Random(8)
    rows = []
    for d in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        near = list(base)
        for at in rng.sample(range(300), rng.randrange(4, 14)):
            near[at] = "changed"
        rows += [(2 * d, " ".join(base), "en", "a"), (2 * d + 1, " ".join(near), "en", "a")]
    gone = {d for d in range(1, 300, 2) if jaccard(rows[d - 1][1], rows[d][1]) >= 0.8}
    assert 20 < len(gone) < 130
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_frame(spark, rows)).collect()}
    assert set(range(300)) - kept == gone
