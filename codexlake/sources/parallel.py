"""Spreading rows before work that costs far more than its bytes suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def slots(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitioned by the keys into a fixed number of partitions, which adaptive execution doesn't merge by size."""
    return df.repartition(slots(df), *keys)


def spread_small(df: DataFrame) -> DataFrame:
    """As it is if its scan has a partition for each slot; else dealt out, as one small file would be read by one task."""
    return df if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism else df.repartition(slots(df))


def paired(rows: DataFrame, group: list[str], order: str, size: int) -> DataFrame:
    """group, a_<column> and b_<column> of the other columns: each pair of a group's rows whose ``order`` rises from a to b.

    A group is cut into blocks of ``size`` rows and each two blocks are a key of
    their own, so a task holds few rows and pairs of a group at a time, however
    large it is, and its pairs are dealt to all slots. A row is sent once per
    block, not once per pair. Rows of equal order may change blocks: a pair
    still meets once, where a's block meets b's.
    """
    w = Window.partitionBy(*group)
    placed = rows.dropna(subset=group).withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w)).where("_n > 1")
    block, last = F.floor(F.col("_at") / size).cast("int"), F.floor((F.col("_n") - 1) / size).cast("int")
    rest = [c for c in rows.columns if c not in group]
    left = placed.select(*group, block.alias("_i"), F.explode(F.sequence(block, last)).alias("_j"), *[F.col(c).alias(f"a_{c}") for c in rest])
    right = placed.select(*group, F.explode(F.sequence(F.lit(0), block)).alias("_i"), block.alias("_j"), *[F.col(c).alias(f"b_{c}") for c in rest])
    cell = [*group, "_i", "_j"]
    return spread(left, *cell).join(spread(right, *cell), cell).where(F.col(f"a_{order}") < F.col(f"b_{order}")).drop("_i", "_j")
