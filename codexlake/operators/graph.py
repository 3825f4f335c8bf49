"""Provenance graph as a table of triples: s, p, o, kind (iri, literal, literal@language or literal^^type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codexlake.functions import rules as R
from codexlake.operators import paths
from codexlake.sources.telemetry import observed

#: Fixed terms of the vocabularies used.
TYPE, LABEL, SAME_AS = "rdf:type", "rdfs:label", "owl:sameAs"
MENTIONS = "schema:mentions"
DOCUMENT, READING, RUN, MODEL, SELECTION = "crm:E31_Document", "crm:E33_Linguistic_Object", "prov:Activity", "prov:SoftwareAgent", "prov:Entity"


def triples(rows: DataFrame, subject: Column, *statements: tuple[str, Column, str]) -> DataFrame:
    """A triple per row and statement (predicate, object, kind); null objects give none. One pass over the rows."""
    made = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("kind")) for p, o, kind in statements])
    return rows.select(subject.alias("s"), F.explode(made).alias("t")).select("s", "t.*").where("s IS NOT NULL AND o IS NOT NULL")


def union(*parts: DataFrame) -> DataFrame:
    """The graph as a set."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["s", "p", "o", "kind"])


def document_iri(doc: Column) -> Column:
    return F.concat(F.lit("doc:"), doc.cast("string"))


def reading_iri(doc: Column, key: Column) -> Column:
    return F.concat(F.lit("reading:"), doc.cast("string"), F.lit("/"), key.cast("string"))


def readings_of(readings: DataFrame, doc: str, engine: str, order: str, working: DataFrame | None = None) -> DataFrame:
    """Reading keys per document: the engine, numbered where it occurs again.

    ``working`` holds the texts that documents are worked on with; each is a
    reading like the others, under the key ``working``, or ``working-fused``
    where an engine has that name. It has no number.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(doc, engine).orderBy(order))
    keyed = readings.withColumn("nth", nth).withColumn("key", F.when(F.col("nth") > 1, F.concat_ws("-", engine, "nth")).otherwise(F.col(engine).cast("string")))
    if working is None:
        return keyed
    taken = keyed.where("key = 'working'").select(doc, F.lit("working-fused").alias("_taken"))
    own = working.join(taken, doc, "left").withColumn("key", F.coalesce("_taken", F.lit("working"))).drop("_taken")
    return keyed.unionByName(own, allowMissingColumns=True)


def document_triples(docs: DataFrame, doc: str = "doc_id", **about: Column) -> DataFrame:
    iri = document_iri(F.col(doc))
    return triples(docs, iri, (TYPE, F.lit(DOCUMENT), "iri"), (LABEL, F.col(doc), "literal"), *[(f"dc:{k}", c, "literal") for k, c in about.items()])


def reading_triples(readings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Document -> reading -> run -> model; readings come from readings_of() with engine and model_id."""
    iri = reading_iri(F.col(doc), F.col("key"))
    run = F.concat(F.lit("run:"), F.col(doc).cast("string"), F.lit("/"), F.col("key"))
    model = F.concat(F.lit("model:"), F.col("model_id").cast("string"))
    return union(
        triples(readings, iri, (TYPE, F.lit(READING), "iri"), ("prov:wasGeneratedBy", run, "iri")),
        triples(readings, document_iri(F.col(doc)), ("crm:P128_carries", iri, "iri")),
        triples(readings, run, (TYPE, F.lit(RUN), "iri"), ("prov:wasAssociatedWith", model, "iri")),
        triples(readings, model, (TYPE, F.lit(MODEL), "iri"), (LABEL, F.col("model_id"), "literal")),
    )


def selection_triples(selections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Editorial selections: doc, chosen (keys), combined, editor, ts. A combined one derives from its readings, a single one endorses it."""
    iri = F.concat(F.lit("selection:"), F.col(doc).cast("string"))
    each = selections.withColumn("_k", F.explode("chosen"))
    link = lambda p, rows: triples(rows, iri, (p, reading_iri(F.col(doc), F.col("_k")), "iri"))
    return union(
        triples(selections, iri, (TYPE, F.lit(SELECTION), "iri"), ("prov:wasAttributedTo", F.concat(F.lit("agent:"), F.col("editor")), "iri"), ("prov:generatedAtTime", F.col("ts"), "literal")),
        triples(selections, document_iri(F.col(doc)), ("ex:closestReading", iri, "iri")),
        link("prov:wasDerivedFrom", each.where("combined")),
        link("ex:endorses", each.where("NOT combined")),
    )


def entity_triples(entities: DataFrame, doc: str = "doc_id", local: tuple[str, ...] = ()) -> DataFrame:
    """Entity nodes by slug with type, label, authority links, and mentions; entities: doc, slug, name, type, gnd, hls, wikidata.

    Sources without public addresses (the columns ``local``) give identifier
    nodes that carry the value; no address is made up for them.
    """
    iri = F.concat(F.lit("entity:"), F.col("slug"))
    known = [(SAME_AS, R.authority_uri(F.lit(a), F.col(a)), "iri") for a in R.AUTHORITIES]
    ids = []
    for source in local:
        value = F.nullif(F.trim(F.col(source).cast("string")), F.lit(""))
        node = F.concat(F.lit(f"identifier:{source}/"), value)
        ids.append(triples(entities, iri, ("crm:P1_is_identified_by", node, "iri")))
        ids.append(triples(entities, node, (TYPE, F.lit("crm:E42_Identifier"), "iri"), (LABEL, value, "literal"), ("crm:P2_has_type", F.lit(source), "literal")))
    return union(
        *ids,
        triples(entities, iri, (TYPE, F.concat(F.lit("ex:"), F.col("type")), "iri"), (LABEL, F.col("name"), "literal"), *known),
        triples(entities, document_iri(F.col(doc)), (MENTIONS, iri, "iri")),
    )


def fusion_triples(decisions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """How readings were blended, or why not: doc, strategy, cer, arbitrated, judge_skipped; no triples where strategy and cer are both null."""
    d = decisions.where("strategy IS NOT NULL OR cer IS NOT NULL")
    iri = F.concat(F.lit("fusion:"), F.col(doc).cast("string"))
    merged = ~F.contains(F.coalesce("strategy", F.lit("")), F.lit("no-merge"))
    flag = "literal^^xsd:boolean"
    return union(
        triples(d, document_iri(F.col(doc)), ("ex:hasFusionDecision", iri, "iri")),
        triples(
            d,
            iri,
            (TYPE, F.lit(RUN), "iri"),
            (TYPE, F.lit("ex:FusionDecision"), "iri"),
            (LABEL, F.when(merged, "Fusion decision").otherwise("No-merge decision"), "literal"),
            ("ex:fusionStrategy", F.col("strategy"), "literal"),
            ("ex:merged", merged, flag),
            ("ex:agreementCer", F.col("cer"), "literal^^xsd:double"),
            ("ex:decisionReason", F.when(~merged, "readings differ beyond the band in which they may be blended"), "literal"),
            ("ex:arbitrated", F.col("arbitrated"), flag),
            ("ex:judgeSkipped", F.col("judge_skipped"), flag),
        ),
    )


#: Why an entity isn't published, with a short name each.
REASONS = {"flagged": "flagged document", "persons": "person", "without_authority": "person without authority"}


def _marked(entities: DataFrame, flagged: Column, drop_persons: bool, need_authority: bool) -> DataFrame:
    has_id = F.greatest(*[F.length(F.coalesce(F.col(a).cast("string"), F.lit(""))) for a in R.AUTHORITIES]) > 0
    person = F.col("type") == "PERSON"
    reason = F.when(flagged, REASONS["flagged"]).when(person & F.lit(drop_persons), REASONS["persons"]).when(person & ~has_id & F.lit(need_authority), REASONS["without_authority"])
    return entities.withColumn("_reason", reason)


def publication_scope(entities: DataFrame, flagged: Column, drop_persons: bool = False, need_authority: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entities that may be published, withheld counts by reason)."""
    marked = _marked(entities, flagged, drop_persons, need_authority)
    kept = marked.where("_reason IS NULL").drop("_reason")
    return kept, marked.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("withheld"))


def observed_scope(entities: DataFrame, flagged: Column, drop_persons: bool = False, need_authority: bool = True):
    """(entities that may be published, Observation): the first action on them also counts all, kept, and withheld by the names of REASONS."""
    counts = {name: F.count_if(F.col("_reason") == reason) for name, reason in REASONS.items()}
    marked, seen = observed(_marked(entities, flagged, drop_persons, need_authority), all=F.count("*"), kept=F.count_if(F.col("_reason").isNull()), **counts)
    return marked.where("_reason IS NULL").drop("_reason"), seen


def graph_counts(graph: DataFrame) -> DataFrame:
    """Triples and distinct subjects per predicate and class; links by authority for owl:sameAs."""
    authority = F.when(F.lit(False), "")
    for name, base in R.AUTHORITIES.items():
        authority = authority.when(F.startswith("o", F.lit(base)), name)
    what = F.when(F.col("p") == TYPE, F.col("o")).when(F.col("p") == SAME_AS, F.coalesce(authority, F.lit("other"))).otherwise("")
    return graph.groupBy("p", what.alias("what")).agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"))


def _variables(pattern: tuple) -> list[str]:
    return [t[1:] for t in pattern if isinstance(t, str) and t.startswith("?")]


def _estimates(graph: DataFrame, patterns: tuple) -> list[float]:
    """Rows that each pattern gives, from counts of its predicates' triples, subjects and objects (one pass, a row per predicate named)."""
    named = set().union(*[p.predicates() if isinstance(p, paths.Path) else set() if p.startswith("?") else {p} for _, p, _ in patterns])
    rows = graph.where(F.col("p").isin(*named)).groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("o").alias("o")).collect() if named else []
    known = {r.p: r for r in rows}
    out = []
    for s, p, o in patterns:
        if isinstance(p, str) and p.startswith("?"):
            out.append(float("inf"))
            continue
        hits = [known[x] for x in (p.predicates() if isinstance(p, paths.Path) else {p}) if x in known]
        n = float(sum(r.n for r in hits))
        if n and not s.startswith("?"):
            n /= max(r.s for r in hits)
        if n and not o.startswith("?"):
            n /= max(r.o for r in hits)
        out.append(n * (1000 if isinstance(p, paths.Path) and s.startswith("?") and o.startswith("?") else 1))
    return out


def ordered(graph: DataFrame, patterns: tuple) -> list[tuple]:
    """The patterns from the most selective one on, each sharing a variable with those before it; an error if one can't."""
    if not all(map(_variables, patterns)):
        raise ValueError("a pattern needs a variable")
    if len(patterns) < 2:
        return list(patterns)
    left, out, bound = dict(enumerate(_estimates(graph, patterns))), [], set()
    while left:
        linked = [i for i in left if not out or bound & set(_variables(patterns[i]))]
        if not linked:
            raise ValueError("patterns that share no variable would be multiplied")
        i = min(linked, key=lambda i: (left[i], i))
        del left[i]
        out.append(patterns[i])
        bound |= set(_variables(patterns[i]))
    return out


def _rows(graph: DataFrame, pattern: tuple, out: DataFrame | None) -> DataFrame:
    """The bindings of one pattern."""
    s, p, o = pattern
    if isinstance(p, paths.Path):
        ends = {"s": None, "o": None}
        for column, term in (("s", s), ("o", o)):
            if not term.startswith("?"):
                ends[column] = graph.sparkSession.createDataFrame([(term,)], f"{column} string")
            elif out is not None and term[1:] in out.columns:
                ends[column] = out.select(F.col(term[1:]).alias(column)).where(F.col(column).isNotNull()).distinct()
        rows, terms = paths.pairs(graph, p, ends["s"], ends["o"]), (("s", s), ("o", o))
    else:
        rows, terms = graph, tuple(zip("spo", pattern))
    names: dict[str, list[str]] = {}
    for column, term in terms:
        if term.startswith("?"):
            names.setdefault(term[1:], []).append(column)
        else:
            rows = rows.where(F.col(column) == term)
    for same in names.values():
        if len(same) > 1:
            rows = rows.where(F.col(same[0]) == F.col(same[1]))
    return rows.select(*[F.col(c[0]).alias(v) for v, c in names.items()])


def match(graph: DataFrame, *patterns: tuple, optional: tuple = ()) -> DataFrame:
    """Joins of triple patterns; terms that begin with ? are variables, predicates can be paths. Optional patterns keep rows without a match.

    The order of the patterns doesn't matter: they are joined from the most
    selective one on. A repetition grows from the nodes that are bound already.
    """
    out = None
    for kind, todo in (("inner", ordered(graph, patterns)), ("left", list(optional))):
        for pattern in todo:
            rows = _rows(graph, pattern, out)
            if out is None:
                out = rows
            else:
                shared = [v for v in rows.columns if v in out.columns]
                if not shared:
                    raise ValueError("patterns that share no variable would be multiplied")
                out = out.join(rows, shared, kind)
    return out


def n_triples(graph: DataFrame) -> DataFrame:
    """Sorted lines of N-Triples text, the same for the same graph."""
    escaped = F.regexp_replace(F.regexp_replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), '"', '\\\\"'), "\n", "\\\\n")
    mark = F.substring("kind", len("literal") + 1, 100)
    suffix = F.when(F.startswith(mark, F.lit("^^")), F.concat(F.lit("^^<"), F.substring(mark, 3, 100), F.lit(">"))).otherwise(mark)
    o = F.when(F.col("kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), suffix))
    return graph.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value")).orderBy("value")
