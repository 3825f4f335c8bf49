"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: every match must
contain, for each stretch of the regex with a finite set of literal readings,
all trigrams of one of them. The postings of the trigrams that the queries use
are intersected by merge counting: a document is in the intersection of k lists
if it occurs k times among their entries. Only the documents that satisfy a
rule's query are searched with its regex. Rules without mandatory trigrams are
run on every document.
"""

from __future__ import annotations

import re
from itertools import product
from re import _constants as sre, _parser as sre_parse
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from codexlake.llm.common import text_key
from codexlake.llm.quality import let


class Rule(NamedTuple):
    """A match counts if its ``group`` has at least ``least`` code points. The regex has the same meaning in Java and Python."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: In the order in which spans at one place are listed. Fixed patterns; the first three are the base.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
#: Literal readings of a stretch that are worth following.
MAX_READINGS = 64


def _readings(nodes) -> list[set[str] | None]:
    """For each part of a regex its finite set of literal readings, or None for a gap."""
    out: list[set[str] | None] = []
    for op, arg in nodes:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.IN and len(arg) <= 8 and all(x is sre.LITERAL for x, _ in arg):
            out.append({chr(x).lower() for _, x in arg})
        elif op is sre.SUBPATTERN:
            out += _readings(arg[3])
        elif op is sre.BRANCH:
            joined = [_join(_readings(branch)) for branch in arg[1]]
            out.append(set().union(*joined) if all(x is not None for x in joined) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1 and (inner := _join(_readings(arg[2]))) is not None:
            out.append(inner | {""} if arg[0] == 0 else inner)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:  # its first pass is mandatory
            out += [*_readings(arg[2]), None] if arg[0] == 1 else [*_readings(arg[2]) * min(arg[0], 3), None]
        else:
            out.append(None)
    return out


def _join(parts: list[set[str] | None]) -> set[str] | None:
    if any(p is None for p in parts):
        return None
    found = {""}
    for p in parts:
        found = {a + b for a in found for b in p}
        if len(found) > MAX_READINGS:
            return None
    return found


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """An AND of ORs of ANDs: for each clause, one of its trigram sets must be present. Lower case; empty if nothing is mandatory."""
    clauses, run = [], {""}
    for part in [*_readings(sre_parse.parse(regex)), None]:
        if part is not None and len(run) * len(part) <= MAX_READINGS:
            run = {a + b for a, b in product(run, part)}
            continue
        sets = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run}
        least = [s for s in sets if not any(o < s for o in sets)]
        if all(least):
            clauses.append(sorted(least, key=sorted))
        run = {""} if part is None else set(part)
    return clauses


def queries(rules=RULES) -> dict[str, list[list[frozenset[str]]]]:
    return {r.kind: q for r in rules if (q := trigram_query(r.regex))}


def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for ``trigrams``: a row (trigram, doc_id, th) for each document whose lower-cased text contains it."""
    vocabulary = F.array(*map(F.lit, trigrams))
    present = let(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), lambda t: F.filter(vocabulary, lambda g: F.contains(t, g)))
    return docs.select(F.explode(present).alias("trigram"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("th"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, th, kinds: the rules whose trigram query the document's postings satisfy."""
    asked = queries(rules)
    lists = [(g, kind, c, s, len(grams)) for kind, q in asked.items() for c, clause in enumerate(q) for s, grams in enumerate(clause) for g in sorted(grams)]
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(lists, "trigram string, kind string, clause int, alternative int, need int"))  # as many rows as the rules have trigrams
    clauses = F.create_map(*[F.lit(x) for kind, q in asked.items() for x in (kind, len(q))])
    postings = trigram_postings(docs, sorted({x[0] for x in lists}))
    met = postings.dropDuplicates(["trigram", "doc_id", "th"]).join(wanted, "trigram").groupBy("doc_id", "th", "kind", "clause", "alternative", "need").agg(F.count("*").alias("n"))
    met = met.where(F.col("n") == F.col("need")).groupBy("doc_id", "th", "kind").agg(F.count_distinct("clause").alias("n"))
    return met.where(F.col("n") == clauses[F.col("kind")]).groupBy("doc_id", "th").agg(F.collect_set("kind").alias("kinds"))


#: Sums are taken within runs of this many entries, and over the runs.
RUN = 256


def prefix_sums(numbers: Column) -> Column:
    """The running sums of an array of integers, each entry included.

    An accumulator that grows by an entry each step is copied each step, so
    sums are taken in runs: n entries cost n * RUN + (n / RUN) ** 2 steps at most.
    """
    empty = F.array().cast("array<bigint>")
    grown = lambda values, first: F.aggregate(values, F.struct(first.cast("bigint").alias("sum"), empty.alias("all")), lambda acc, x: let(acc["sum"] + x, lambda v: F.struct(v.alias("sum"), F.concat(acc["all"], F.array(v)).alias("all"))), lambda acc: acc["all"])
    runs = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda c: F.slice(a, c * RUN + 1, F.lit(RUN)))
    sums = lambda r: F.concat(F.array(F.lit(0).cast("bigint")), grown(F.transform(r, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda acc, v: acc + v)), F.lit(0)))
    whole = let(runs(numbers), lambda r: let(sums(r), lambda before: F.flatten(F.transform(r, lambda x, i: grown(x, F.get(before, i))))))
    return F.when(F.size(numbers) > 0, whole).otherwise(empty)


def _search_regex(rule: Rule) -> str:
    """For single-class rules a regex that only long enough matches satisfy: those are whole runs of the class in either case."""
    return f"{rule.regex[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^]]*\]\+", rule.regex) and rule.least else rule.regex


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end): the leftmost non-overlapping matches that count, placed by the lengths of matches and of the texts between."""
    regex = _search_regex(rule)
    lengths = lambda x: F.transform(x, lambda v: F.length(v).cast("bigint"))
    between = lengths(F.split(text, regex, -1))
    whole, value = (lengths(F.regexp_extract_all(text, F.lit(regex), F.lit(g))) for g in (0, rule.group))

    def placed(w: Column) -> Column:
        ends = prefix_sums(F.zip_with(F.slice(between, F.lit(1), F.size(w)), w, lambda gap, n: gap + n))
        all_ = F.arrays_zip(ends.alias("end"), w.alias("n"), value.alias("value"))
        return F.transform(F.filter(all_, lambda m: m["value"] >= rule.least), lambda m: F.struct((m["end"] - m["n"]).alias("start"), m["end"].alias("end")))

    return let(whole, placed)


def secret_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, th, kind, start, end (code points, end exclusive) of all secrets, once for rows that agree in doc_id and text.

    The candidates join the documents once; a rule with a trigram query looks
    only at the texts that are candidates for it.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_key(F.col("text").cast("string")).alias("th"))
    asked = queries(rules)
    c, d = candidates(docs, rules).alias("c").hint("shuffle_hash"), slim.alias("d")
    joined = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.th") == F.col("c.th")), "left").select("d.*", "c.kinds")
    found = []
    for rule in rules:
        hit = F.col("text").rlike(_search_regex(rule))
        if rule.kind in asked:  # reads both sides of the join, so no text is searched before it
            hit = F.when(F.array_contains("kinds", rule.kind), hit)
        found.append(F.when(hit, F.struct(F.lit(rule.kind).alias("kind"), _matches(F.col("text"), rule).alias("m"))))
    each = joined.select("doc_id", "th", F.explode(F.array_compact(F.array(*found))).alias("x"))
    return each.select("doc_id", "th", "x.kind", F.inline("x.m")).distinct()


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 and all spans as text.

    A null or empty text has no spans (the digest of the empty string). Rows
    that agree in doc_id and text get the same result; rows without doc_id are
    told apart by their text. An empty table gives an empty result.
    """
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    spans = secret_spans(docs, rules).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", order[F.col("kind")].alias("order"), "kind", "end"))).alias("all"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("th")).alias("d")
    s = spans.alias("s")
    joined = keys.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")), "left")
    found = F.coalesce(F.col("s.all"), F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>"))
    base = F.filter(found, lambda x: x["kind"].isin(*BASE))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select("d.doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(found).alias("spans"))
