"""Connected components by repeated hooking and contraction.

Every round each node takes its smallest neighbour (or itself) as parent, and
the edges are rewritten onto the parents. A node that is not the smallest of
its surroundings disappears as an endpoint, so the edge set shrinks
geometrically on the graphs met in entity resolution and duplicate search.
No round brings nodes or edges to the driver; only a row count decides when to
stop. Both joins are plain equi-joins on shuffled sides, which adaptive
execution splits when one node (a hub) holds many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codexlake.sources.scratch import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each endpoint of ``edges``; component is the smallest node id reachable.

    Endpoints are any orderable type without nulls (rows with a null endpoint
    are ignored). Self-loops give their node its own component. An empty edge
    table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = written(pairs.distinct(), "edges")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    labels = written(nodes.withColumn("component", F.col("node")), "labels")
    live = written(pairs.where("a <> b"), "live")
    for _ in range(max_rounds):
        if live.isEmpty():
            return labels
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("p"))
        parent = written(parent, "parent")
        # two pointer jumps shorten the chains that hooking leaves behind
        for _ in range(2):
            up = parent.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("n", F.coalesce("pp", "p").alias("p"))
        parent = written(parent, "parent")
        labels = written(
            labels.join(parent.withColumnRenamed("n", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")),
            "labels",
        )
        pa, pb = parent.select(F.col("n").alias("a"), F.col("p").alias("x")), parent.select(F.col("n").alias("b"), F.col("p").alias("y"))
        live = written(
            live.join(pa, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "live",
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
