"""Audit of how filters interact, kept by an incremental stream with retractions (operator 12).

The files of a corpus pass as available-now micro-batches. Each text is reduced to a digest and a mask of the filters
that it fails; the state of a digest is its least id so far with the rows that hold it. Only the holder of a text's
least id passes filter E, so when a smaller id arrives the earlier holder's mask is retracted from its part's counter
and counted again with E. Counters, state and rows of a batch lie in folders of its number: a batch that runs again
after a failure writes the same once more.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.bpe import Batches
from turnlake.llm.common import CLEANUP, shared_dir, whole_text

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 50, 65, 5
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
INNER = bytes(range(0x80, 0xC0))
#: Micro-batches that a whole corpus is cut into; each reads the state, a hundredth of the texts, once or twice.
BATCHES = 4

ROWS = "doc_id bigint, part string, digest binary, mask int"
STATE = "digest binary, doc_id bigint, part string, mask int, good boolean, toxic boolean, n bigint"
COUNTS = "part string, mask int, good boolean, toxic boolean, n bigint"


def failed(text: bytes) -> int:
    """The mask of A to D for a whole text; words are runs of bytes other than ASCII white space."""
    words = text.split()
    points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, INNER)))
    upper = len(text) - len(text.translate(None, UPPER))
    return ((A if len(words) < MIN_WORDS else 0) | (B if 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words) else 0)
            | (C if 100 * upper > MAX_UPPER_PERCENT * points else 0) | (D if len(text.translate(None, SYMBOLS)) < len(text) else 0))


def _masking(batches: Batches) -> Batches:
    for batch in batches:
        texts = [x.as_buffer() for x in batch.column(2)]
        digests, masks = [], []
        for t in texts:
            raw = t.to_pybytes() if t is not None and t.size else b""
            digests.append(hashlib.sha256(raw).digest())
            masks.append(failed(raw))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                                         names=["doc_id", "part", "digest", "mask"])


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask of A to D for each row of `docs` (doc_id, text, source); nulls of text and source are empty."""
    return docs.select("doc_id", whole_text("source").alias("part"), whole_text().alias("text")).mapInArrow(_masking, ROWS)


class FilterAudit:
    """Counters by part and mask that a stream of documents keeps, in a folder that outlives its runs."""

    def __init__(self, spark: SparkSession, labels: DataFrame, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/filter-audit-{uuid.uuid4().hex}"
        self.labels = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))

    def _read(self, kind: str, schema: str, before: int | None = None) -> DataFrame:
        """What the batches, or those before one, have written; nothing when there was none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if before == 0 or not files.exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.folder}/{kind}")
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        held = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")
        finally:
            self.spark.conf.set(CLEANUP, held)

    def ingest(self, docs: DataFrame, batch: int) -> None:
        """Takes a micro-batch into state and counters; the same batch again changes nothing."""
        # the texts are read once, by the stream's own session; all that follows works on narrow rows, re-planned at run time
        docs.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        rows = self.spark.read.schema(ROWS).parquet(f"{self.folder}/rows/batch={batch}")
        rows = rows.join(self.labels, rows["doc_id"] == F.col("label_id"), "left").drop("label_id").na.fill(False, ["good", "toxic"])
        state = self._read("state", STATE, batch)
        old = state.groupBy("digest").agg(F.min("doc_id").alias("old_id"))
        least = rows.groupBy("digest").agg(F.min("doc_id").alias("new_id")).filter("new_id IS NOT NULL")
        least = least.join(old, "digest", "left")
        # rows that hold the least id now; several may, where an id is repeated
        holding = least.filter("old_id IS NULL OR new_id <= old_id")
        held = rows.join(holding.select("digest", F.col("new_id").alias("doc_id")), ["digest", "doc_id"]).groupBy(
            "digest", "doc_id", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
        self._write(held, "state", batch)
        held = self.spark.read.schema(STATE).parquet(f"{self.folder}/state/batch={batch}")
        replaced = holding.filter("new_id < old_id").select("digest", F.col("old_id").alias("doc_id"))
        retracted = state.join(replaced, ["digest", "doc_id"])

        def change(df: DataFrame, mask: Column, n: Column) -> DataFrame:
            return df.select("part", mask.cast("int").alias("mask"), "good", "toxic", n.cast("long").alias("n"))

        mask, n, as_copy = F.col("mask"), F.col("n"), F.col("mask").bitwiseOR(F.lit(E))
        # every row counts as a copy at first, but for ids that aren't known; holders are then taken back from there
        every = change(rows, F.when(F.col("doc_id").isNull(), mask).otherwise(as_copy), F.lit(1))
        parts = [every, change(held, as_copy, -n), change(held, mask, n), change(retracted, mask, -n), change(retracted, as_copy, n)]
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        self._write(total.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0"), "counts", batch)

    def run(self, path: str, batches: int = BATCHES) -> FilterAudit:
        """Streams the files of `path` that no earlier run has seen, about `batches` micro-batches for all of them."""
        whole = self.spark.read.parquet(path)
        files = max(1, -(-len(whole.inputFiles()) // batches))
        # as a pattern, the path may also name a single file
        stream = self.spark.readStream.schema(whole.select("doc_id", "text", "source").schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")
        query = masked(stream).writeStream.foreachBatch(lambda df, batch: self.ingest(df, batch)).option(
            "checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def counters(self) -> DataFrame:
        """part, mask (bits of A to E that rows fail), good, toxic, n: the sum of all changes so far."""
        return self._read("counts", COUNTS).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def positions(spark: SparkSession) -> DataFrame:
    """For each of the 120 orders, step and 31 masks and none: what a row of that mask means there (19,200 rows, always)."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = spark.range(len(orders) * 5 * 32).select(
        F.element_at(F.array(*map(F.lit, orders)), (F.col("id") / 160 + 1).cast("int")).alias("filter_order"),
        (F.col("id") / 32 % 5 + 1).cast("int").alias("step"), (F.col("id") % 32).cast("int").alias("mask"))
    bits = F.expr("transform(sequence(1, 5), i -> shiftleft(1, ascii(substring(filter_order, i, 1)) - 65))")
    own = F.element_at("bits", F.col("step"))
    earlier = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda s, b: s + b)
    return steps.withColumn("bits", bits).withColumns({"own": own, "earlier": earlier}).select(
        "filter_order", "step", "mask", (F.col("mask").bitwiseAND(F.col("own")) != 0).alias("fails"), (F.col("mask").bitwiseAND(F.col("earlier")) != 0).alias("gone"),
        (F.col("mask") == F.col("own")).alias("only"), F.bit_count("mask").alias("size"))


def report(counters: DataFrame) -> DataFrame:
    """One row for each part, order and step, with the long counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    shapley is what the step's filter removes, summed over all orders: of the 120, a row that fails s filters is
    removed by each of them in 120 / s. No counters give no rows.
    """
    n = F.sum("n")
    per = counters.groupBy("part", "mask").agg(n.alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
                                               F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"))
    at = per.join(F.broadcast(positions(counters.sparkSession)), "mask")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0)))
    fails, gone = F.col("fails"), F.col("gone")
    return at.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("only")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * (120 / F.col("size")).cast("long")).otherwise(F.lit(0))).alias("shapley"))


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None, batches: int = BATCHES) -> DataFrame:
    """report() of all documents (doc_id, text, source) under `path`; with a folder, of those of earlier runs too.

    Nulls of text and source are empty. A row without doc_id never fails E and is nobody's smaller id; rows that repeat
    the least id of a text all pass E. A label counts when any row of its id says so. An empty table gives no rows.
    """
    return report(FilterAudit(spark, labels, folder).run(path, batches).counters())


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         doc_id > min(doc_id) OVER (PARTITION BY text) AS e,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND toxic = 1) AS toxic FROM t),
f AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c
    WHEN 'D' THEN d ELSE coalesce(e, false) END) AS fails FROM m),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT v.x || w.x || x.x || y.x || z.x AS filter_order FROM l v, l w, l x, l y, l z
  WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, string_split(left(filter_order, step - 1), '') AS earlier
  FROM o, generate_series(1, 5) AS k(step)),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, list_contains(fails, own) AS hit,
         step > 1 AND list_has_any(fails, earlier) AS gone, fails = [own] AS alone FROM g, s),
q AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM q
"""
