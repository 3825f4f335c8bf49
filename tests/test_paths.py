"""Property paths against a plain search."""

import random

import pytest

from codexlake.operators import graph, paths
from codexlake.operators.paths import either, inverse, plus, seq, star


def triples(n, seed):
    draw = random.Random(seed)
    return sorted({(f"n{draw.randrange(14)}", draw.choice(["a", "b", "c"]), f"n{draw.randrange(14)}", "iri") for _ in range(n)})


def frame(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string, kind string")


def walk(rows, path):
    """Pairs of a path, as often as there are ways (repetitions once)."""
    if isinstance(path, str):
        return [(s, o) for s, p, o, _ in rows if p == path]
    of = [walk(rows, p) for p in path.parts]
    if path.kind == "inverse":
        return [(o, s) for s, o in of[0]]
    if path.kind == "either":
        return sum(of, [])
    if path.kind == "seq":
        out = of[0]
        for step in of[1:]:
            out = [(s, o) for s, m in out for x, o in step if x == m]
        return out
    far, new = set(), set(of[0])
    while new:
        far |= new
        new = {(s, o) for s, m in new for x, o in of[0] if x == m} - far
    if path.kind == "star":
        far |= {(x, x) for s, _, o, _ in rows for x in (s, o)}
    return list(far)


PATHS = ["a", seq("a", "b"), inverse("a"), either("a", "c"), plus("a"), star("b"), plus(seq("a", inverse("b"))), seq(plus("a"), "c", star(either("a", "b"))), inverse(plus("c"))]


@pytest.mark.parametrize("path", PATHS, ids=str)
def test_pairs(spark, path):
    rows = triples(40, 2)
    got = sorted(map(tuple, paths.pairs(frame(spark, rows), path).collect()))
    assert got == sorted(walk(rows, path))


def test_pairs_from_and_to_bound_nodes(spark):
    rows = triples(40, 3)
    g = frame(spark, rows)
    some = spark.createDataFrame([("n1",), ("n5",), ("absent",)], "s string")
    for path in (plus("a"), star("b"), seq("a", plus("b")), inverse(plus("c"))):
        want = walk(rows, path)
        assert sorted(map(tuple, paths.pairs(g, path, starts=some).collect())) == sorted(w for w in want if w[0] in ("n1", "n5"))
        assert sorted(map(tuple, paths.pairs(g, path, ends=some.toDF("o")).collect())) == sorted(w for w in want if w[1] in ("n1", "n5"))


def test_match_in_any_order(spark):
    rows = triples(45, 4) + [("n1", "type", "T", "iri"), ("n2", "type", "T", "iri"), ("n3", "type", "U", "iri")]
    g = frame(spark, rows)
    patterns = [("?x", plus("a"), "?y"), ("?y", "b", "?z"), ("?z", "type", "T")]
    want = sorted((x, y, z) for x, y in walk(rows, plus("a")) for y2, z in walk(rows, "b") if y == y2 and z in ("n1", "n2"))
    assert want
    for order in (patterns, patterns[::-1]):
        assert sorted((r.x, r.y, r.z) for r in graph.match(g, *order).collect()) == want
    assert graph.ordered(g, tuple(patterns))[0] == patterns[2]  # two triples of three: the most selective one
    fixed = graph.match(g, ("n1", plus(either("a", "b")), "?y")).collect()
    assert sorted(r.y for r in fixed) == sorted(o for s, o in walk(rows, plus(either("a", "b"))) if s == "n1")
    left = graph.match(g, ("?z", "type", "?t"), optional=(("?z", plus("c"), "?far"),))
    assert {(r.z, r.far) for r in left.collect()} == {(z, o) for z in ("n1", "n2", "n3") for o in ([o for s, o in walk(rows, plus("c")) if s == z] or [None])}
    with pytest.raises(ValueError):
        graph.match(g, ("?a", "a", "?b"), ("?c", "b", "?d"))
    with pytest.raises(ValueError):
        graph.match(g, ("n1", "a", "n2"))
    assert graph.match(g.limit(0), *patterns).collect() == []
