"""Ranks and first rows of groups, none of which has to fit into a task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.streaming.streams import shared_root

#: Parts that a group is dealt into before its first rows meet.
PARTS = 32
#: What monotonically_increasing_id() leaves for the rows of a partition.
ROW_BITS = 33


def first_rows(df: DataFrame, by: list[str], order: list[str | Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order: those of its parts first, so that at most PARTS * k rows of it meet."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
    part = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
    some = df.withColumn("_salt", salt).withColumn("_r", part).filter(F.col("_r") <= k).drop("_salt", "_r")
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with `rank` (from 1) and `size` within its groups, in ascending order; rows that tie are ranked as they come.

    All rows are sorted over ranges of (group, order), where a group may lie in many; a row's place among all, less that
    of its group's first row, is its rank. The sorted rows are written once, as they are read for the places and the ranks.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/ranked-{uuid.uuid4().hex}"
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", ROW_BITS))
    # one row a partition
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    groups = rows.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("size"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(F.col(f"_by{i}"))
    return rows.join(groups, same).select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias("rank"), "size")


def running_sums(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """df with `total`: the sum of `value` over the rows of a group up to this one, in a total order.

    Rows are sorted over ranges of (group, order) that are written once; a range's rows are summed in its task, and what
    the group's ranges before hold, a row each, is added.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/running-{uuid.uuid4().hex}"
    placed = df.repartitionByRange(*[F.asc_nulls_first(c) for c in by], *order).withColumn("_part", F.spark_partition_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    own = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_part").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(own), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_of"), "_before")
    same = rows["_part"] == parts["_of"]
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(parts[f"_by{i}"])
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(parts, same).withColumn("total", F.coalesce(F.sum(value).over(within), F.lit(0)) + F.col("_before")).select(*df.columns, "total")
