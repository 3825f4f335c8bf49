"""Property paths over a table of triples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from codexlake.sources.scratch import written


@dataclass(frozen=True)
class Path:
    """A way from subjects to objects; made by the functions below from predicates and other paths."""

    kind: str
    parts: tuple

    def predicates(self) -> set[str]:
        return set().union(*[p.predicates() if isinstance(p, Path) else {p} for p in self.parts])


def seq(*parts: str | Path) -> Path:
    """One after the other (a/b)."""
    return Path("seq", parts)


def either(*parts: str | Path) -> Path:
    """Any of them (a|b)."""
    return Path("either", parts)


def inverse(part: str | Path) -> Path:
    """From object to subject (^a)."""
    return Path("inverse", (part,))


def plus(part: str | Path) -> Path:
    """Once or more often (a+)."""
    return Path("plus", (part,))


def star(part: str | Path) -> Path:
    """Any number of times (a*); nodes of the graph lead to themselves."""
    return Path("star", (part,))


def pairs(graph: DataFrame, path: str | Path, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """s, o of a path. Repetitions give each pair once, the rest as many as there are ways.

    starts (s) or ends (o), if given, are distinct nodes that the pairs may be
    restricted to: repetitions then grow from these alone.
    """
    if isinstance(path, str):
        return _within(graph.where(F.col("p") == path).select("s", "o"), starts, ends)
    if path.kind == "inverse":
        turned = pairs(graph, path.parts[0], _renamed(ends, "s"), _renamed(starts, "o"))
        return turned.select(F.col("o").alias("s"), F.col("s").alias("o"))
    if path.kind == "either":
        return reduce(DataFrame.unionByName, [pairs(graph, p, starts, ends) for p in path.parts])
    if path.kind == "seq":
        out = None
        for i, p in enumerate(path.parts):
            step = pairs(graph, p, starts if i == 0 else None, ends if i == len(path.parts) - 1 else None)
            out = step if out is None else out.withColumnRenamed("o", "_m").join(step.withColumnRenamed("s", "_m"), "_m").select("s", "o")
        return out
    edges = pairs(graph, path.parts[0])
    far = repeated(edges, starts, ends)
    if path.kind == "plus":
        return far
    nodes = graph.select(F.col("s").alias("n")).union(graph.where("kind = 'iri'").select("o"))
    own = _within(nodes.distinct().select(F.col("n").alias("s"), F.col("n").alias("o")), starts, ends)
    return far.unionByName(own).distinct()


def _renamed(nodes: DataFrame | None, name: str) -> DataFrame | None:
    return nodes.toDF(name) if nodes is not None else None


def _within(found: DataFrame, starts: DataFrame | None, ends: DataFrame | None) -> DataFrame:
    if starts is not None:
        found = found.join(starts, "s", "left_semi")
    return found.join(ends, "o", "left_semi").select("s", "o") if ends is not None else found


def repeated(edges: DataFrame, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """s, o of all nodes that follow each other over one edge or more, cycles included.

    Semi-naive: a round joins only the pairs that the last one found with the
    edges, and those that are new go on, until none is. Each round is written,
    so its cost is its own. Without starts but with ends it grows backwards.
    """
    edges = written(edges.where("s IS NOT NULL AND o IS NOT NULL").distinct(), "edges")
    back = starts is None and ends is not None
    grown, fixed = ("s", "o") if back else ("o", "s")
    steps = edges.select(F.col(grown).alias("_to"), F.col(fixed).alias("_from"))
    new = written(_within(edges, starts if not back else None, ends if back else None), "reached")
    rounds = [new]
    while not new.isEmpty():
        known = reduce(DataFrame.unionByName, rounds)
        ahead = new.join(steps, F.col(grown) == F.col("_from")).select(F.col(fixed), F.col("_to").alias(grown)).select("s", "o").distinct()
        new = written(ahead.join(known, ["s", "o"], "left_anti"), "reached")
        rounds.append(new)
    return _within(reduce(DataFrame.unionByName, rounds), starts, ends)
