"""Places in a total order without one task that holds all rows: range partitions and prefix sums of their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range partition, about.
PART_ROWS = 500_000


def ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """The rows, sorted by range, with their partition `_part`, and how many rows lie before each. The table is written once, so
    that both agree; equal keys share a partition, so the order must be total for parts to stay small."""
    from ..sources.store import fresh_dir

    spark = df.sparkSession
    parts = parts or max(1, -(-df.count() // PART_ROWS))
    to = fresh_dir(spark)
    df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(to)
    kept = spark.read.parquet(to)
    before, at = {}, 0
    for r in kept.groupBy("_part").count().orderBy("_part").collect():
        before[r["_part"]] = at
        at += r["count"]
    return kept, before | {-1: at}


def numbered(df: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds each row's place in the order, from 1."""
    kept, before = ranged(df, order, parts)
    starts = df.sparkSession.createDataFrame([(p, n) for p, n in before.items() if p >= 0], "_part int, _before bigint")
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return kept.join(F.broadcast(starts), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def skipped(df: DataFrame, order: list[Column], n: int, most: int | None = None, parts: int | None = None) -> DataFrame:
    """Rows from the n-th on (n = 0: all), at most so many: whole partitions are dropped or kept by their counts, and only those
    that a bound falls into are numbered."""
    kept, before = ranged(df, order, parts)
    total = before.pop(-1)
    end = total if most is None else min(total, n + most)
    if n >= end:
        return kept.drop("_part").limit(0)
    starts = sorted(before.items(), key=lambda x: x[1])
    spans = [(p, a, starts[k + 1][1] if k + 1 < len(starts) else total) for k, (p, a) in enumerate(starts)]
    whole = [p for p, a, z in spans if n <= a and z <= end]
    cut = [(p, a) for p, a, z in spans if z > n and a < end and not (n <= a and z <= end)]
    out = kept.where(F.col("_part").isin(whole)).drop("_part")
    for p, a in cut:  # two at most
        place = F.row_number().over(W.orderBy(*order)) + F.lit(a)
        out = out.unionByName(kept.where(F.col("_part") == p).drop("_part").withColumn("_place", place).where((F.col("_place") > n) & (F.col("_place") <= end)).drop("_place"))
    return out
