"""Plain versions of the operators, and hostile rows to hold them against."""

import hashlib
import zlib

import numpy as np
import xxhash

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return (text or "").encode().split()


DOCS = [
    (1, "The same opening line, twenty chars\nbody one two three four five six", "en", "a"),
    (2, "  THE SAME OPENING LINE, TWENTY CHARS\t\nbody one two three four five seven", "en", "a"),
    (3, "the same opening line, twenty chars\nthe same opening line, twenty chars\nother", "de", None),
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, "\n\n \n", "en", "b"),
    (7, "é" * 19 + "\n" + "é" * 20, "fr", "b"),
    (8, "é" * 20 + "\nx", "fr", "b"),
    (9, "É" * 20 + "\n" + "é" * 20, "fr", "b"),
    (10, "one", "en", "c"),
    (11, "one", "en", "c"),
    (11, "one", "en", "c"),
    (11, "another text under the same id, long enough to count", "en", "c"),
    (None, "the same opening line, twenty chars\nno id here", "en", "c"),
    (None, "another text under the same id, long enough to count", "en", "c"),
    (12, "another text under the same id, long enough to count\r\n" * 3, "en", "c"),
    (13, "<|endoftext|> x <|startoftext|> y  z\n\n  tabs\there 's 'tis don't ... 12.5 ½ ǅ", "en", "c"),
    (14, "word " * 3000, "en", "c"),
]


def docs_frame(spark, rows=DOCS):
    """With extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text")).withColumn("th", F.lit("x")).withColumn("keep", F.lit(1)).withColumn("node", F.lit(2)).withColumn("h1", F.lit(None).cast("int"))


def line_dedup(rows, min_chars=20, min_docs=3):
    low = lambda d: -1 if d is None else d
    holders = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(WS).translate(LOWER)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(low(d))
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(x.strip(WS).translate(LOWER), ())) < min_docs or max(h) == low(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def simhash(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, linked):
    """Index of the first member of each value's component."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def rows_of(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)
