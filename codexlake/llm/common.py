"""What the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The white space of every contract here: space and \t \n \v \f \r. bytes.split() and bytes.strip() use just these.
SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a null doc_id inside numpy arrays; sorts below all others.
NO_ID = np.iinfo(np.int64).min


def with_text_key(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``th``, the text's 64-bit hash.

    (doc_id, th) names a row when a doc_id occurs on several rows; rows that
    agree in both hold the same text and so get the same result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("th"), *more)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def ids(column: pa.Array) -> np.ndarray:
    """int64 values with NO_ID for nulls."""
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def nullable(values: np.ndarray) -> pa.Array:
    """The reverse of ids()."""
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def raw_texts(column: pa.Array):
    """UTF-8 bytes of each row; null reads as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""
