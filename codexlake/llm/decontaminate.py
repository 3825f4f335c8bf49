"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words of benchmark items and documents are hashed; a mask of ones and zeros
lays down which words of a stretch take part in a seed hash, so a substituted
word under a zero doesn't matter. Seed hashes of the documents are joined with
those of the benchmark. Each hit names a diagonal, on which the words of the
document and of the item are compared one by one: the best-scoring stretch, +1
for an equal word and -2 for another, must reach a minimum.

Only seeds, places and ids go through the first join. Words are fetched for the
stretches with hits alone, and items and documents are cut into overlapping
stretches of bounded length, so the work grows linearly with a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codexlake.llm.common import text_key
from codexlake.llm.quality import let
from codexlake.sources.scratch import written

#: Masks of one span. A stretch of any length without a hit scores 4 at most (a test runs through all patterns), less than any item asks for.
MASKS = ("11101",)
SPAN = len(MASKS[0])
#: Longest stretch that is found for certain, the score that counts as a leak, and its share of the words of items too short for that.
REACH, MIN_SCORE, MIN_SHARE = 57, 10, 0.6
#: Items of fewer words are found as a whole, all words equal.
SHORT = 9
#: Words of a stretch of an item or a document, beside the overlap.
PIECE = 256
#: Benchmark seeds that are broadcast; those of a larger benchmark are shuffled.
BROADCAST_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words, letters and digits only."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(words, lambda x: F.xxhash64(x))


def seeded(df: DataFrame, words: str, lengths: list[int], *keep: str) -> DataFrame:
    """A row per seed, and per stretch of one of the ``lengths``: its hash ``seed`` and place ``at`` beside the columns to keep."""
    span = max([SPAN, *lengths])
    ahead = F.arrays_zip(*[F.slice(words, i + 1, F.greatest(F.size(words), F.lit(0))).alias(f"w{i}") for i in range(span)])
    places = df.select(*keep, F.posexplode(ahead).alias("at", "w"))
    of = lambda name, used, n: F.when(F.col(f"w.w{n - 1}").isNotNull(), F.xxhash64(F.lit(name), *[F.col(f"w.w{i}") for i in used]))
    hashes = [of(mask, [i for i, x in enumerate(mask) if x == "1"], SPAN) for mask in MASKS] + [of(str(n), range(n), n) for n in lengths]
    return places.select(*keep, "at", F.explode(F.array(*hashes)).alias("seed")).where(F.col("seed").isNotNull())


def pieces(df: DataFrame, words: str, overlap: int | Column, *keep: str) -> DataFrame:
    """Stretches of PIECE words and the ``overlap`` behind: their number ``piece`` and ``words`` beside the columns to keep."""
    n = F.greatest(F.ceil(F.size(words) / PIECE).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.struct(c.alias("piece"), F.slice(words, c * PIECE + 1, F.lit(PIECE) + overlap).alias("words")))
    return df.select(*keep, F.inline(cut))


def _score(doc: Column, item: Column, at: Column) -> Column:
    """The best stretch of the item's words laid beside the document's from place ``at`` on, which may be negative."""
    first, stop = F.greatest(F.lit(0), -at), F.least(F.size(item), F.size(doc) - at)
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"))

    def step(acc: Column, k: Column) -> Column:
        run = F.greatest(F.lit(0), acc["run"] + F.when(F.get(doc, at + k) == F.get(item, k), 1).otherwise(-2))
        return F.struct(F.greatest(acc["best"], run).alias("best"), run.alias("run"))

    return F.when(stop > first, F.aggregate(F.sequence(first, stop - 1), start, step, lambda acc: acc["best"])).otherwise(0)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE, min_share: float = MIN_SHARE, reach: int = REACH) -> DataFrame:
    """doc_id, th, item_id, score, first_word, n_hits: one row per document and benchmark item that it overlaps.

    An overlap counts if its score reaches ``min_score``, or ``min_share`` of
    the words of an item too short for that; an item of fewer than SHORT words
    counts where all its words are found in a row. Every stretch of up to
    ``reach`` words with such a score is found; the score is that of the best
    stretch of the item's piece on the diagonal. first_word is where the item
    would begin in the document, n_hits counts seeds on diagonals that count.

    Null and empty texts, and texts without letters and digits, overlap
    nothing. Rows of the benchmark without item_id are one item, null. Rows
    that agree in doc_id and text are reported once. An empty table on either
    side gives an empty result; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    least = F.when(F.size("item") < SHORT, F.size("item")).otherwise(F.least(F.lit(min_score), F.floor(min_share * F.size("item")).cast("int")))
    items = items.select("item_id", "item", F.size("item").alias("n_item"), least.alias("least"))
    items = pieces(items, "item", reach, "item_id", "n_item", "least").withColumnRenamed("piece", "item_piece")
    items = items.withColumn("item_key", F.xxhash64("item_id", "n_item", "item_piece", "words"))
    items = written(items, "items")
    short = F.col("n_item") < SHORT
    lengths = sorted(r["n_item"] for r in items.where(short).select("n_item").distinct().collect())
    index = seeded(items.where(~short), "words", [], "item_key")
    for n in lengths:
        index = index.unionByName(items.where(F.col("n_item") == n).select("item_key", F.lit(0).alias("at"), F.xxhash64(F.lit(str(n)), *[F.get("words", F.lit(i)) for i in range(n)]).alias("seed")))
    index = written(index.select("seed", "item_key", F.col("at").alias("item_at")), "seeds")

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    hashed = slim.select("doc_id", "th", word_hashes(F.col("text")).alias("words"))
    found = seeded(hashed, "words", lengths, "doc_id", "th")
    found = found.join(F.broadcast(index) if index.count() <= BROADCAST_SEEDS else index, "seed")
    diagonals = found.groupBy("doc_id", "th", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.count("*").alias("n"))
    diagonals = written(diagonals, "diagonals")

    hit = diagonals.select("doc_id", "th").distinct().withColumnsRenamed({"doc_id": "doc_id_h", "th": "th_h"})
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_h")) & (F.col("th") == F.col("th_h"))
    texts = slim.join(hit, same, "left_semi").dropDuplicates(["doc_id", "th"])
    parts = pieces(texts.select("doc_id", "th", word_hashes(F.col("text")).alias("all")), "all", PIECE + reach, "doc_id", "th").alias("p")
    d = diagonals.withColumn("piece", F.floor(F.greatest(F.col("diagonal"), F.lit(0)) / PIECE).cast("int")).alias("d")
    beside = d.join(parts, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.th") == F.col("p.th")) & (F.col("d.piece") == F.col("p.piece")))
    beside = beside.select("d.*", F.col("p.words").alias("doc_words")).join(items, "item_key")
    beside = beside.withColumn("score", _score(F.col("doc_words"), F.col("words"), F.col("diagonal") - PIECE * F.col("piece")))
    beside = beside.where(F.col("score") >= F.col("least"))
    begin = F.greatest(F.lit(0), F.col("diagonal") - PIECE * F.col("item_piece"))
    return beside.groupBy("doc_id", "th", "item_id").agg(F.max("score").alias("score"), F.min(begin).alias("first_word"), F.sum("n").alias("n_hits"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, all columns as they are."""
    leaked = overlaps(docs, benchmark, **how).select("doc_id", "th").distinct().hint("shuffle_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(leaked["doc_id"]) & (text_key(docs["text"].cast("string")) == leaked["th"])
    return docs.join(leaked, same, "left_anti")
