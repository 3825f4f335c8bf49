"""Similarity join of names by matching blocks (Ratcliff and Obershelp)."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codexlake.functions import text as T
from codexlake.sources.parallel import spread
from codexlake.sources.scratch import written


def letters(name: Column) -> Column:
    """The letters of a name with their number of occurrence, as an array without repeats: "anna" gives a0 n0 n1 a1."""
    numbered = lambda chars: F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i), lambda x: x == c)).cast("string")))
    return T.let(F.filter(F.split(name, ""), lambda c: c != ""), numbered)


def grams(text: Column, lengths: list[int]) -> Column:
    """The distinct stretches of the lengths given."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(of, lengths)))


def holders(needles: DataFrame, texts: DataFrame, size: int = 4, needle: str = "needle", text: str = "text") -> DataFrame:
    """needle, text: every pair of distinct values where the text holds the needle; empty needles give nothing.

    A needle is looked up by the one of its stretches of ``size`` letters (a
    shorter needle: by itself) that the fewest texts hold, so a stretch that
    many names share isn't met unless the needle has nothing rarer.
    """
    own = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    all_ = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    lengths = sorted(r.n for r in own.select(F.least(F.length("needle"), F.lit(size)).alias("n")).distinct().collect())  # size rows at most
    if not lengths:
        return own.join(all_, F.col("needle") == F.col("text")).limit(0)
    index = written(all_.select("text", F.explode(grams(F.col("text"), lengths)).alias("gram")), "grams")
    # a needle has grams of one length only: its own if it is short
    pieces = own.select("needle", F.explode(F.filter(grams(F.col("needle"), lengths), lambda g: F.length(g) == F.least(F.length("needle"), F.lit(size)))).alias("gram"))
    counts = index.join(pieces.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rarest = pieces.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).select("needle", F.col("g.gram").alias("gram"))
    return rarest.join(index, "gram").where(F.contains("text", "needle")).select("needle", "text")


def _ratio(cutoff: float):
    @F.pandas_udf("double")
    def ratio(queries: pd.Series, names: pd.Series) -> pd.Series:
        out, m, last = [], difflib.SequenceMatcher(), None
        for q, x in zip(queries, names):
            if q != last:
                m.set_seq2(q)
                last = q
            m.set_seq1(x)
            out.append(m.ratio())
        return pd.Series(out, dtype="float64")

    return ratio


def _sided(rows: DataFrame, name: str, rank: DataFrame, cutoff: float, mine: str) -> DataFrame:
    """Distinct names with their letters from rare to common, the number of them that a partner can't avoid, and one row for each of these."""
    own = rows.where(F.col(name).isNotNull()).select(F.col(name).cast("string").alias(mine)).distinct()
    long = own.select(mine, F.posexplode(letters(F.col(mine))).alias("_p", "letter")).join(rank, "letter", "left")
    ordered = long.groupBy(mine).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "letter"))).alias("_l"))
    n = F.size("_l")
    need = F.ceil(cutoff * n / (2 - cutoff) - 1e-9)  # of n letters, with the shortest partner that can still be as like as the cutoff
    return ordered.select(mine, F.transform("_l", lambda x: x["letter"]).alias("letters"), n.alias("n"), F.greatest(F.lit(0), n - need + 1).cast("int").alias("prefix"))


def similar_names(queries: DataFrame, names: DataFrame, cutoff: float = 0.6, query: str = "query", name: str = "name") -> DataFrame:
    """query, name, ratio: every pair of distinct texts whose ratio of matching blocks is ``cutoff`` or more.

    Exact: the ratio is at most 2 * common letters / all letters. So lengths
    within cutoff / (2 - cutoff) of each other and a common letter among the
    rarest ones of both (letters are told apart by their number of occurrence,
    ordered by how few names have them) are necessary; an inverted index of
    these letters by length proposes each pair once, the common letters are counted,
    and only what passes is compared. Null texts are left out, empty ones
    equal each other.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff lies between 0 and 1")
    q0, n0 = queries.select(F.col(query).cast("string").alias("t")), names.select(F.col(name).cast("string").alias("t"))
    both = n0.distinct().select(F.explode(letters(F.col("t"))).alias("letter"))
    rank = written(both.groupBy("letter").agg(F.count("*").alias("df")), "letters")
    left = written(_sided(q0, "t", rank, cutoff, "query"), "queries")
    right = written(_sided(n0, "t", rank, cutoff, "name"), "names")
    # a query meets the lengths that it can be like: they are part of the key, so a frequent letter is split by them
    low, high = F.ceil(F.col("n") * cutoff / (2 - cutoff) - 1e-9).cast("int"), F.floor(F.col("n") * (2 - cutoff) / cutoff + 1e-9).cast("int")
    lengths = written(right.groupBy("n").agg(F.count("*").alias("_c")), "lengths").select(F.col("n").alias("m"))
    reach = left.select("query", "n", low.alias("low"), high.alias("high")).select("query", F.explode(F.sequence("low", "high")).alias("m")).join(lengths, "m", "left_semi")
    asked = left.withColumnsRenamed({"letters": "ql", "n": "qn", "prefix": "qp"}).join(reach, "query").select("query", "ql", "qn", "qp", "m", F.explode(F.expr("slice(ql, 1, qp)")).alias("letter"))
    held = right.withColumnsRenamed({"letters": "nl", "n": "m", "prefix": "np"}).select("name", "nl", "m", "np", F.explode(F.expr("slice(nl, 1, np)")).alias("letter"))
    met = asked.join(held, ["m", "letter"])
    first = F.expr("array_intersect(slice(ql, 1, qp), slice(nl, 1, np))[0]")
    alike = 2 * F.size(F.array_intersect("ql", "nl")) >= cutoff * (F.col("qn") + F.col("m")) - 1e-9
    pairs = met.where((F.col("letter") == first) & alike).select("query", "name")
    compared = spread(pairs, "query", "name").sortWithinPartitions("query").select("query", "name", _ratio(cutoff)("query", "name").alias("ratio"))
    found = compared.where(F.col("ratio") >= cutoff)
    blank = q0.where("t = ''").distinct().join(n0.where("t = ''").distinct(), "t").select(F.col("t").alias("query"), F.col("t").alias("name"), F.lit(1.0).alias("ratio"))
    return found.unionByName(blank)


#: Texts of one length that meet as one block, and cells of the table of a block of queries and a block of names that a task holds at once.
QUERY_BLOCK, NAME_BLOCK, CELLS = 2048, 8192, 1 << 21


def _blocks(rows: DataFrame, size: int, columns: list[str], as_: str) -> DataFrame:
    """n, block, columns as arrays: texts of one length (column n), dealt by their hash into blocks of about ``size``."""
    counts = rows.groupBy("n").agg(F.ceil(F.count("*") / size).alias("_k"))
    dealt = rows.join(counts, "n").withColumn("_b", F.pmod(F.xxhash64(columns[0]), F.col("_k")))
    return dealt.groupBy("n", "_b").agg(F.collect_list(F.struct(*columns)).alias("_x")).select("n", F.concat_ws("/", "n", "_b").alias(f"{as_}_block"), *[F.col(f"_x.{c}").alias(f"{as_}_{c}") for c in columns])


def _numbered(texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each letter: its class (code point modulo 128) with its number of occurrence in the text.

    Classes of several letters only raise what two texts have in common, so bounds stay bounds.
    """
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    row = np.repeat(np.arange(len(texts)), size)
    letter = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64) % 128
    order = np.lexsort((letter, row))
    row, letter = row[order], letter[order]
    at = np.arange(len(row))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (letter[1:] != letter[:-1])
    return row, (at - np.maximum.accumulate(np.where(new, at, 0))) * 128 + letter


class _Asked:
    """A block of queries as a matrix of their letters."""

    def __init__(self, texts) -> None:
        self.texts, self.size = texts, len(texts)
        self.row, feature = _numbered(texts)
        self.features, self.column = np.unique(feature, return_inverse=True)

    def common(self, names) -> np.ndarray:
        """How many letters each query has in common with each name; a product of 0/1 matrices, 512 letters at a time."""
        row, feature = _numbered(names)
        column = np.searchsorted(self.features, feature)
        known = column < len(self.features)
        known[known] = self.features[column[known]] == feature[known]
        row, column = row[known], column[known]
        out = np.zeros((self.size, len(names)), dtype=np.float32)
        for first in range(0, len(self.features), 512):
            width = min(512, len(self.features) - first)
            sides = []
            for r, c, n in ((self.row, self.column, self.size), (row, column, len(names))):
                own = (c >= first) & (c < first + width)
                m = np.zeros((n, width), dtype=np.float32)
                m[r[own], c[own] - first] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
        return out


def _parts(names: np.ndarray, size: int):
    step = max(1, CELLS // max(1, size))
    return (names[i : i + step] for i in range(0, len(names), step))


def _likely(n: int):
    """query, name: the n names of each query with most letters in common for their length; a task sees a block of queries with all it meets, in a row."""

    def run(batches):
        asked, block, bound, best = None, None, None, None

        def done():
            q, k = np.nonzero(bound >= 0)
            return pd.DataFrame({"query": asked.texts[q], "name": best[q, k]})

        for b in batches:
            for own, texts, names, length, other in zip(b["q_block"], b["q_query"], b["n_name"], b["n"], b["m"]):
                if own != block:
                    if asked is not None:
                        yield done()
                    asked, block = _Asked(np.asarray(texts, dtype=object)), own
                    bound, best = np.full((asked.size, n), -1.0), np.full((asked.size, n), "", dtype=object)
                for part in _parts(np.asarray(names, dtype=object), asked.size):
                    found = asked.common(part) * (2.0 / max(1, length + other))
                    if len(part) > n:
                        at = np.argpartition(-found, n - 1, axis=1)[:, :n]
                        found, part = np.take_along_axis(found, at, axis=1), part[at]
                    else:
                        part = np.broadcast_to(part, found.shape)
                    bound, best = np.concatenate([bound, found], axis=1), np.concatenate([best, part], axis=1)
                    at = np.argpartition(-bound, n - 1, axis=1)[:, :n]
                    bound, best = np.take_along_axis(bound, at, axis=1), np.take_along_axis(best, at, axis=1)
        if asked is not None:
            yield done()

    return run


def _possible(batches):
    """query, name: all pairs with so many letters in common that they can be as like as the query's ``least``."""
    for b in batches:
        for texts, least, names, length, other in zip(b["q_query"], b["q_least"], b["n_name"], b["n"], b["m"]):
            least = np.asarray(least, dtype=np.float64)
            near = 2 * min(length, other) >= least * (length + other) - 1e-6
            if near.any():
                asked = _Asked(np.asarray(texts, dtype=object)[near])
                needed = (least[near] * (length + other) / 2 - 1e-6)[:, None]
                for part in _parts(np.asarray(names, dtype=object), asked.size):
                    q, k = np.nonzero(asked.common(part) >= needed)
                    yield pd.DataFrame({"query": asked.texts[q], "name": part[k]})


def closest_of_each(queries: DataFrame, names: DataFrame, n: int = 3, cutoff: float = 0.5, query: str = "query", name: str = "name") -> DataFrame:
    """query, rank, name, ratio: the n names most like each query; of equals the greater text first.

    Exact, without all pairs of similar_names(): the ratios of the names that
    have most letters in common with a query say how like its n-th best is at
    least, and only names that can be as like by their letters are compared.
    Distinct texts meet in blocks of one length, whose common letters are a
    product of matrices, so a pair costs some nanoseconds before it is ruled out.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff lies between 0 and 1")
    text = lambda df, column, as_: df.select(F.col(column).cast("string").alias(as_)).where(F.col(as_).isNotNull()).distinct().withColumn("n", F.length(as_))
    asked = written(text(queries, query, "query"), "queries")
    held = written(_blocks(text(names, name, "name"), NAME_BLOCK, ["name"], "n").withColumnRenamed("n", "m"), "names")
    lengths = held.select("m").distinct()
    low, high = F.ceil(F.col("n") * cutoff / (2 - cutoff) - 1e-9).cast("int"), F.floor(F.col("n") * (2 - cutoff) / cutoff + 1e-9).cast("int")

    def met(rows: DataFrame, columns: list[str]) -> DataFrame:
        q = written(_blocks(rows, QUERY_BLOCK, columns, "q"), "asked")
        reach = q.select("q_block", F.explode(F.sequence(low, high)).alias("m")).join(lengths, "m")
        return q.join(reach, "q_block").join(held, "m")

    pairs = "query string, name string"
    first = spread(met(asked, ["query"]), "q_block").sortWithinPartitions("q_block").mapInPandas(_likely(4 * n), pairs)
    near = spread(first, "query", "name").sortWithinPartitions("query").select("query", _ratio(cutoff)("query", "name").alias("ratio"))
    nth = F.get(F.sort_array(F.collect_list("ratio"), asc=False), F.lit(n - 1))
    least = F.greatest(F.lit(cutoff), F.coalesce(nth, F.lit(cutoff))).alias("least")
    bounded = asked.join(near.groupBy("query").agg(least), "query")
    possible = spread(met(bounded, ["query", "least"]), "q_block", "n_block").mapInPandas(_possible, pairs)
    compared = spread(possible, "query", "name").sortWithinPartitions("query").select("query", "name", _ratio(cutoff)("query", "name").alias("ratio")).where(F.col("ratio") >= cutoff)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ratio"), F.desc("name")))
    return compared.withColumn("rank", rank).where(F.col("rank") <= n).select("query", "rank", "name", "ratio")


def suggest_of_each(queries: DataFrame, names: DataFrame, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """query, rank, name: closest_of_each(); for queries without any the first n names in order that hold them, upper and lower case alike; nothing for empty ones."""
    near = written(closest_of_each(queries, names, n, cutoff), "near")
    open_ = queries.where("query <> ''").select("query", F.lower("query").alias("needle")).distinct().join(near.select("query").distinct(), "query", "left_anti")
    own = names.where("name IS NOT NULL").select("name", F.lower("name").alias("text")).distinct()
    held = open_.join(holders(open_, own), "needle").join(own, "text")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("name"))
    first = held.select("query", "name").withColumn("rank", rank).where(F.col("rank") <= n)
    return near.select("query", "rank", "name").unionByName(first.select("query", "rank", "name"))
