"""Authority records kept by the project itself (persons, places, controlled terms): typed tables, counts, triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codexlake.operators import graph

#: Fixed classes of the exported kinds, and of the nodes that carry a name.
CLASSES = {
    "PERSON": "crm:E21_Person",
    "PLACE": "crm:E53_Place",
    "ORGANISATION": "crm:E40_Legal_Body",
    "SOCIAL_GROUP": "crm:E74_Group",
    "CARE_ACTION": "crm:E7_Activity",
    "ROLE": "sdhss:Role",
    "DATE": "crm:E50_Date",
    "VOCABULARY": "sdhss:Concept",
}
APPELLATIONS = {"PERSON": "crm:E82_Actor_Appellation", "PLACE": "crm:E48_Place_Name"}
#: Kinds that need a name, that are addressed by Wikidata, that link to the GND, and that carry notes.
NAMED = WIKIDATA = ("PERSON", "PLACE", "ORGANISATION", "SOCIAL_GROUP")
GND = ("PERSON", "PLACE", "ORGANISATION")
NOTED = (*NAMED, "CARE_ACTION", "VOCABULARY")
TEXT = "literal@de"
RECORD = {"id": "string", "kind": "string", "name": "string", "wikidata_id": "string", "gnd_id": "string", "notes": "string", "lat": "double", "lon": "double", "canonical_form": "string", "category": "string"}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _record(rows: DataFrame, kind: Column, **columns: Column) -> DataFrame:
    return rows.select(*[columns.get(c, kind if c == "kind" else F.lit(None)).cast(t).alias(c) for c, t in RECORD.items()])


def persons(entries: DataFrame) -> DataFrame:
    """Records of persons from entries with id, name, wikidata, gnd, notes; missing texts are empty."""
    return _record(entries, F.lit("PERSON"), id=F.col("id"), name=_text("name"), wikidata_id=F.col("wikidata"), gnd_id=F.col("gnd"), notes=_text("notes"))


def places(entries: DataFrame) -> DataFrame:
    """Records of places; coordinates (an array) count only as a pair of numbers."""
    pair = F.transform(F.col("coordinates").cast("array<string>"), lambda c: c.try_cast("double"))
    whole = (F.size(pair) == 2) & F.forall(pair, lambda c: c.isNotNull())
    at = lambda i: F.when(whole, F.get(pair, F.lit(i)))
    return _record(entries, F.lit("PLACE"), id=F.col("id"), name=_text("name"), wikidata_id=F.col("wikidata"), gnd_id=F.col("gnd"), notes=_text("notes"), lat=at(0), lon=at(1))


def vocabulary(terms: DataFrame, term: str = "term") -> DataFrame:
    """Records of controlled terms, each its own canonical form, without a category."""
    return _record(terms, F.lit("VOCABULARY"), id=F.col(term), name=F.col(term), canonical_form=F.col(term), category=F.lit(""))


def summary(**tables: DataFrame) -> DataFrame:
    """kind, n: the number of rows of each table, 0 for an empty one."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in tables.items()])


def qid(identifier: Column) -> Column:
    """A Wikidata number with its Q; null if empty."""
    return F.when(F.startswith(identifier, F.lit("Q")), identifier).when(identifier != "", F.concat(F.lit("Q"), identifier))


def record_triples(records: DataFrame) -> DataFrame:
    """The graph of records (columns of RECORD; kinds are upper-cased, unknown ones get a label only).

    A node's address is its Wikidata item or else made from kind and id, so
    that the same records give the same graph; records that share both are
    one node. Names, notes and categories are German literals.
    """
    r = records.withColumn("kind", F.upper(_text("kind"))).withColumn("name", _text("name"))
    r = r.where(~F.col("kind").isin(*NAMED) | (F.col("name") != ""))
    item = F.when(F.col("kind").isin(*WIKIDATA), F.concat(F.lit("wd:"), qid(_text("wikidata_id"))))
    r = r.withColumn("item", item).withColumn("node", F.coalesce("item", F.concat(F.lit("hub:"), F.lower("kind"), F.lit("/"), F.md5(_text("id")))))
    classes, names = (F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) for m in (CLASSES, APPELLATIONS))
    only = lambda kinds, c: F.when(F.col("kind").isin(*kinds), c)
    gnd = F.nullif(F.trim(F.replace(_text("gnd_id"), F.lit("gnd:"), F.lit(""))), F.lit(""))
    name_node = only(APPELLATIONS, F.concat("node", F.lit("/name")))
    term = lambda c: only(["VOCABULARY"], F.col(c))
    return graph.union(
        graph.triples(
            r,
            F.col("node"),
            (graph.TYPE, classes[F.col("kind")], "iri"),
            (graph.LABEL, F.col("name"), TEXT),
            ("crm:P1_is_identified_by", name_node, "iri"),
            (graph.TYPE, F.col("item"), "iri"),
            ("schema:sameAs", only(["PERSON"], F.col("item")), "iri"),
            ("schema:sameAs", only(GND, F.concat(F.lit("gnd:"), gnd)), "iri"),
            ("geo:lat", only(["PLACE"], F.when(F.col("lon").isNotNull(), F.col("lat"))), "literal^^xsd:double"),
            ("geo:long", only(["PLACE"], F.when(F.col("lat").isNotNull(), F.col("lon"))), "literal^^xsd:double"),
            ("rdfs:comment", only(NOTED, F.nullif(_text("notes"), F.lit(""))), TEXT),
            ("sdhss:canonicalForm", term("canonical_form"), TEXT),
            ("sdhss:category", term("category"), TEXT),
        ),
        graph.triples(r, name_node, (graph.TYPE, names[F.col("kind")], "iri"), (graph.LABEL, F.col("name"), TEXT)),
    )
