"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id, so the parts follow each
other in doc_id order. Each part is three flat little-endian files: ``.bin``
(unsigned ids, 16 or 32 bits wide), ``.off`` (uint64, where each document
starts in the part, plus the end) and ``.doc`` (int64 doc ids). The bases of
the parts are prefix sums over the parts' token counts, one row per part; with
them the manifest is written beside the parts, so that any session can read the
folder. Files that the manifest doesn't name were left by lost attempts.
Files go through Arrow's file systems, so a part can be on shared disk, HDFS or
an object store; on shared disk readers memory-map it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from codexlake.llm.common import ids, nullable
from codexlake.llm.tokens import encoder
from codexlake.sources.scratch import new_path

WRITTEN = "part int, file string, n_docs long, n_tokens long"
#: Tokens held before they are appended to the open file.
FLUSH = 1 << 20


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _write(path: str, tokenizer: str, end_id: int, dtype: str):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"  # another attempt writes other files; only reported ones are read
        fs, root = _open(path)
        encode, end = encoder(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes()
        n_docs = n_tokens = 0
        out: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if not out:
                out = {suffix: fs.open_output_stream(f"{root}/{name}.{suffix}") for suffix in ("bin", "off", "doc")}
                out["off"].write(np.zeros(1, dtype="<u8").tobytes())
            out["doc"].write(ids(batch.column("doc_id")).astype("<i8").tobytes())
            held, size, ends = [], 0, []

            def flush():
                out["bin"].write(np.frombuffer(b"".join(held), dtype="<u4").astype(dtype).tobytes())
                out["off"].write(np.array(ends, dtype="<u8").tobytes())

            for text in batch.column("text"):
                data = encode(text.as_py() or "") + end
                held.append(data)
                n_docs += 1
                n_tokens += len(data) // 4
                size += len(data)
                ends.append(n_tokens)
                if size > 4 * FLUSH:
                    flush()
                    held, size, ends = [], 0, []
            flush()
        if not out:
            return
        for stream in out.values():
            stream.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, dtype: str = "<u2") -> DataFrame:
    """Write ``docs`` as token files below ``path``; return the manifest (part, file, n_docs, n_tokens, base), also written there.

    ``dtype`` must hold the tokenizer's ids, else a ValueError is raised:
    ``<u2`` for vocabularies below 65,536. A null text has only the end id. Rows without doc_id come first;
    equal doc_ids follow each other in the order of their texts' hash. An empty
    table gives an empty manifest. The manifest has one row per part, so the
    prefix sums that give the bases run on the driver.
    """
    largest = max(encoder(tokenizer).whole.get_vocab(with_added_tokens=True).values(), default=0)
    if max(largest, end_id) > np.iinfo(dtype).max or end_id < 0:
        raise ValueError(f"ids up to {max(largest, end_id)} don't fit into {dtype}")
    spark = docs.sparkSession
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    parts = slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_write(path, tokenizer, end_id, dtype), WRITTEN)
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    base, manifest = 0, []
    for r in rows:
        manifest.append((*r, base))
        base += r["n_tokens"]
    table = spark.createDataFrame(manifest, f"{WRITTEN}, base long")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return table


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a folder of token files."""
    return spark.read.schema(f"{WRITTEN}, base long").parquet(f"{path}/manifest")


class TokenFile:
    """One part; ids of a document are a slice of a memory-mapped array where the file system allows it."""

    def __init__(self, path: str, name: str, dtype: str = "<u2"):
        self.fs, root = _open(path)
        self.name, self.dtype = f"{root}/{name}", np.dtype(dtype)
        self.offsets = np.frombuffer(self._all("off"), dtype="<u8")
        self.doc_ids = np.frombuffer(self._all("doc"), dtype="<i8")
        self.map = np.memmap(f"{self.name}.bin", dtype=self.dtype, mode="r") if isinstance(self.fs, pafs.LocalFileSystem) else None
        self.file = None if self.map is not None else self.fs.open_input_file(f"{self.name}.bin")

    def _all(self, suffix: str) -> bytes:
        with self.fs.open_input_stream(f"{self.name}.{suffix}") as f:
            return f.read()

    def __getitem__(self, i: int) -> np.ndarray:
        lo, hi = int(self.offsets[i]), int(self.offsets[i + 1])
        if self.map is not None:
            return self.map[lo:hi]
        return np.frombuffer(self.file.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), dtype=self.dtype)


def _read(path: str, dtype: str):
    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                part = TokenFile(path, name, dtype)
                for lo in range(0, len(part.doc_ids), 10_000):
                    hi = min(lo + 10_000, len(part.doc_ids))
                    start = part.offsets[lo:hi].astype(np.int64) + base
                    n = np.diff(part.offsets[lo : hi + 1]).astype(np.int64)
                    crc = [zlib.crc32(part[i].astype("<u4").tobytes()) for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [nullable(part.doc_ids[lo:hi]), pa.array(start), pa.array(n), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as uint32) from the files that the manifest names."""
    manifest = read_manifest(spark, path)
    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(_read(path, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write token files into the shared scratch area and describe them as read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
