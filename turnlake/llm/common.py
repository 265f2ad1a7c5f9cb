"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most this many keys can each hold a thousandth of all rows, so a table of them has a proven bound.
HOT_KEYS = 1000
#: Whether an execution's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnlake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    # once the table is written, nobody needs the shuffles that made it
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of `df` is called so in any case."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        free.append(name)
    return free


def whole_text(col: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lookup(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of `rows` with `keyed`, which has one row a key and how many rows hold it in `count`.

    Keys that hold a thousandth of the rows or more are at most HOT_KEYS, so they are broadcast;
    the others are sort-merge joined and no task gets a hot key.
    """
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).first()["t"]
    least = max(HOT_KEYS, total // HOT_KEYS)
    hot = keyed.filter(F.col(count) >= least)
    cold = keyed.filter(F.col(count) < least)
    if total < least:
        return rows.join(cold.hint("merge"), key)
    marked = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(marked.join(cold.hint("merge"), key))
