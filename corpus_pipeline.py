"""From raw documents to tokens: quality filter, exact dedup, near dedup, source mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. Rows with null doc_ids or texts, repeated rows and further columns pass through as the operators say;
empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.bpe import digested
from turnlake.llm.common import stored, unused, whole_text
from turnlake.llm.exact_dedup import exact_dedup, keep_first
from turnlake.llm.mixing import mix
from turnlake.llm.near_dedup import near_dedup
from turnlake.llm.quality import good_rows

#: Passes over any source that the mixture may ask for; with the covering budget no document is lost.
MAX_REPEATS = 1.5


def _of(docs: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of `docs`, all columns, for the `doc_id` of `ids`, as often as it stands there."""
    (key,) = unused(docs, "_id")
    own = ids.select(F.col("doc_id").alias(key))
    return docs.join(own, docs["doc_id"].eqNullSafe(own[key]), how).drop(key)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 9) predicts to be good."""
    return good_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each normalised text (operator 8)."""
    return keep_first(docs, exact_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 10); an id that several rows have is judged by each row's text."""
    key, other = unused(docs, "_key", "_id")
    several = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias(other))
    if several.isEmpty():
        return _of(docs, near_dedup(docs).filter("NOT kept"), "left_anti")
    # such rows go by 62 bits of a hash, above usual ids, so that those stay before them
    own = F.shiftrightunsigned(F.xxhash64("doc_id", whole_text()), 2) + F.lit(1 << 62)
    rows = stored(docs.join(several, docs["doc_id"] == several[other], "left").withColumn(
        key, F.when(F.col(other).isNull(), F.col("doc_id")).otherwise(own)).drop(other), "near-rows")
    dropped = near_dedup(rows.select(F.col(key).alias("doc_id"), "text")).filter("NOT kept").select(F.col("doc_id").alias(other))
    return rows.join(dropped, rows[key] == dropped[other], "left_anti").drop(key)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the tempered mixture deals them out (operator 6): all at least once, some twice."""
    dealt = mix(docs, target_entropy=None, max_repeats=MAX_REPEATS, cover=True)
    copies = dealt.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # a repeated row of docs was dealt out for itself; each row takes its share of the copies
    rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    more = copies.join(rows, copies["doc_id"].eqNullSafe(rows["doc_id"])).select(
        copies["doc_id"], F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / F.col("rows")).cast("int"))).alias("copy"))
    return _of(docs, stored(more, "mixture"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mixture (operator 1): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digested(docs)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encode_stage),
]

#: A classifier, near-duplicate groups and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
