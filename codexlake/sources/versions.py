"""Numbered versions of a folder: small JSON files that are added, never changed.

A writer takes the number after the newest one, and the file is created only if
nobody has it yet, so two writers can't both win. Readers take the newest file
that is whole; what they read stays in place until vacuumed.
"""

from __future__ import annotations

import json

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import SparkSession

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer has added the version first."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions of a folder, newest first."""
    fs, p = _at(spark, f"{root}/{FOLDER}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def read(spark: SparkSession, root: str, number: int) -> dict | None:
    """The content of a version; None if the file isn't there or not whole."""
    try:
        lines = [r.value for r in spark.read.text(f"{root}/{FOLDER}/{number:012d}", wholetext=True).collect()]
        return json.loads("".join(lines))
    except (ValueError, PySparkException):
        return None


def newest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest whole version; (0, {}) before the first."""
    for n in numbers(spark, root):
        found = read(spark, root, n)
        if found is not None:
            return n, found
    return 0, {}


def add(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Create version ``number``; Conflict if it exists."""
    fs, p = _at(spark, f"{root}/{FOLDER}/{number:012d}")
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(p):
            raise Conflict(f"version {number} of {root} exists") from e
        raise
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
