"""Order folders, point lookups and the catalogue of sources."""

import pytest

from codexlake.operators import providers
from codexlake.sources import readers


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_orders(spark):
    found = readers.orders(paths(spark, "file:/in/a/1.jpg", "file:/in/a/deep/2.jpg", "file:/in/b/1.jpg", "file:/in/loose.jpg", "file:/other/c/1.jpg"), "/in/")
    assert sorted((r.order_id, r.path) for r in found.collect()) == [("a", "file:/in/a/1.jpg"), ("a", "file:/in/a/deep/2.jpg"), ("b", "file:/in/b/1.jpg")]
    alone = readers.orders(paths(spark, "hdfs://host/x/in/1.jpg", "hdfs://host/x/in/2.jpg"), "hdfs://host/x/in")
    assert {(r.order_id, r.path[-5:]) for r in alone.collect()} == {("in", "1.jpg"), ("in", "2.jpg")}
    assert readers.orders(paths(spark), "/in").collect() == []


def test_lookup(spark):
    def get(source, pid):
        if source == "down":
            raise TimeoutError("too slow")
        return {"name": f"{source} {pid}", "n": 1} if pid != "none" else None

    asked = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "none"), ("down", "1"), (None, "1")], "source string, pid string")
    got = {(r.source, r.pid): (r.found and r.found.name, r.error) for r in providers.lookup(asked, get, "name string, n int").collect()}
    assert got == {("a", "1"): ("a 1", None), ("a", "none"): (None, None), ("down", "1"): (None, "too slow")}


@pytest.mark.parametrize("row, faults", [
    (("s", ["person"], ["search"], "https://x", False), set()),
    (("s", ["person"], ["search"], None, True), set()),
    (("", ["person"], ["search"], "https://x", None), {"no name"}),
    (("s", [], None, "http://x", False), {"no kind", "no tool", "no https address"}),
    (("s", ["person", "ghost"], ["search"], "https://x", False), {"unknown kind"}),
])
def test_catalogue(spark, row, faults):
    schema = "name string, kinds array<string>, tools array<string>, url string, external boolean"
    own = spark.createDataFrame([row, ("other", ["place"], ["t"], "https://y", False)], schema)
    assert {r.fault for r in readers.catalogue_faults(own).collect()} == faults
    twice = spark.createDataFrame([row, row], schema)
    assert row[0] == "" or "name is used twice" in {r.fault for r in readers.catalogue_faults(twice).collect()}
