"""Benchmark decontamination by winnowing (operator 11).

Of every PICKED consecutive runs of GRAM words the one of least hash is a fingerprint, so each run of SPAN words has
one that depends on its words alone, the same in documents and items. Fingerprints of documents are joined with those
of the items and extended left and right, by comparing words, to the windows of SPAN words that hold them. No pair of
a document and an item is made before a whole window is shared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.bpe import Batches
from turnlake.llm.common import documents, stored, whole_text
from turnlake.llm.passages import _sliding
from turnlake.llm.words import NOT_ALPHANUMERIC, Words, chunks, grams, list_array, long_array

SPAN, GRAM = 10, 5
PICKED = SPAN - GRAM + 1
#: Bits of the filter of the items' fingerprints, whatever their number: 8 MB. More items let more through to the join.
FILTER_BITS = 26

SCANNED = "doc_id bigint, text_key binary, n_words bigint, hits array<struct<gram: bigint, start: int, size: int, words: string>>"
ITEMS = "item_id string, size int, grams array<bigint>, windows array<string>"


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place among its words) of the runs of GRAM words that are least in some PICKED runs of one text."""
    h, begin = grams(words, GRAM)
    n = len(h)
    if n < PICKED:
        return h[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    least = _sliding(h, PICKED, np.minimum)
    # only runs inside one text
    least[of[: len(least)] != of[PICKED - 1 :]] = 0
    padded = np.concatenate([np.zeros(PICKED - 1, np.uint64), least, np.zeros(PICKED - 1, np.uint64)])
    at = np.flatnonzero(h == _sliding(padded, PICKED, np.maximum))
    return h[at], of[at], at - begin[of[at]]


def whole_runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for all runs of `size` words, where that is less than SPAN; sizes don't share hashes."""
    h, begin = grams(words, size)
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    long_enough = np.diff(words.first)[of] >= size
    at = np.flatnonzero(long_enough)
    return h[at] * np.uint64(2 * size + 1), of[at], at - begin[of[at]]


def spoken(words: Words, first: int, last: int) -> str:
    """Words first..last of the chunk, lower-cased, with single spaces."""
    return b" ".join([words.data[words.start[i] : words.end[i]].tobytes() for i in range(first, last)]).decode("utf-8", "replace")


def _reading_items(batches: Batches) -> Batches:
    for batch in batches:
        for at, to, words in chunks(batch.column(1), lower=True, between=NOT_ALPHANUMERIC):
            counts = np.diff(words.first)
            h, of, _ = fingerprints(words)
            by = [h[of == i] if counts[i] >= SPAN else None for i in range(to - at)]
            for size in {int(c) for c in counts if 0 < c < SPAN}:
                g, own, _ = whole_runs(words, size)
                for i in np.flatnonzero(counts == size):
                    by[i] = g[own == i]
            sizes = np.minimum(counts, SPAN)
            windows = [[spoken(words, j, j + int(n)) for j in range(int(f), int(f + c - n + 1))] if n else [] for f, c, n in zip(words.first, counts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), pa.array(sizes, pa.int32()), pa.array([[] if g is None else np.unique(g).view(np.int64) for g in by], pa.list_(pa.int64())),
                 pa.array(windows, pa.list_(pa.string()))], names=["item_id", "size", "grams", "windows"])


def _scanning(shared):
    def run(batches: Batches) -> Batches:
        held, sizes = shared.value
        bits = np.frombuffer(held, np.uint64)
        shift = np.uint64(64 - FILTER_BITS)

        def passing(found):
            h, of, at = found
            slot = h >> shift
            kept = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
            return h[kept], of[kept], at[kept]

        for batch in batches:
            texts = batch.column(1)
            for at, to, words in chunks(texts, lower=True, between=NOT_ALPHANUMERIC):
                counts, found = np.diff(words.first), []
                h, of, place = passing(fingerprints(words))
                # words of the windows that may hold a fingerprint
                found.append((h, of, np.maximum(place - SPAN + GRAM, 0), np.minimum(place + SPAN, counts[of]), SPAN))
                for size in sizes:
                    h, of, place = passing(whole_runs(words, size))
                    found.append((h, of, place, place + size, size))
                of = np.concatenate([x[1] for x in found])
                order = np.argsort(of, kind="stable")
                gram, low, high = (np.concatenate([x[k] for x in found])[order] for k in (0, 2, 3))
                size = np.concatenate([np.full(len(x[0]), x[4], np.int32) for x in found])[order]
                base = words.first[of[order]]
                said = [spoken(words, a, b) for a, b in zip((base + low).tolist(), (base + high).tolist())]
                hits = pa.StructArray.from_arrays([long_array(gram), pa.array(low, pa.int32()), pa.array(size), pa.array(said, pa.string())], names=["gram", "start", "size", "words"])
                keys = [hashlib.blake2b(x.as_buffer() or b"", digest_size=16).digest() for x in texts.slice(at, to - at)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                     list_array(hits, np.searchsorted(of[order], np.arange(to - at + 1)))], names=["doc_id", "text_key", "n_words", "hits"])

    return run


def read_items(benchmark: DataFrame) -> DataFrame:
    """item_id (as text, null: empty), size, grams, windows of each item that has words; equal items are read alike."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), whole_text().alias("text"))
    return rows.mapInArrow(_reading_items, ITEMS).filter("size > 0")


def _filter(prints: DataFrame) -> bytes:
    """FILTER_BITS of the fingerprints' hashes: at most 2^(FILTER_BITS - 6) rows of two numbers, whatever the items."""
    slot = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    words = prints.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - FILTER_BITS}) & 63 AS int))").alias("bit"))
    rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


class Matches:
    """Documents held against a benchmark: `scanned` has a row for each document, `windows` the shared windows."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame):
        items = stored(read_items(benchmark), "items")
        prints = stored(items.select(F.explode("grams").alias("gram")).distinct(), "item-prints")
        sizes = sorted(r["size"] for r in items.filter(F.col("size") < SPAN).select("size").distinct().collect())
        shared = docs.sparkSession.sparkContext.broadcast((_filter(prints), sizes))
        self.scanned = stored(docs.select("doc_id", whole_text().alias("text")).mapInArrow(_scanning(shared), SCANNED), "scanned")
        # items of the same windows are one class, so that copies of an item cost nothing more
        classed = items.withColumn("class", F.unhex(F.sha2(F.array_join("windows", "\n"), 256)))
        self.members = classed.select("class", "item_id").distinct()
        self.item_windows = stored(classed.dropDuplicates(["class"]).select("class", F.explode("windows").alias("window")).distinct(), "item-windows")
        hits = self.scanned.select("doc_id", "text_key", F.explode("hits").alias("h")).select("doc_id", "text_key", "h.*")
        met = hits.join(prints, "gram", "left_semi")
        words = F.split("words", " ")
        extended = met.select("doc_id", "text_key", "size", "start", words.alias("w")).filter(F.size("w") >= F.col("size")).select(
            "doc_id", "text_key", "size", "start", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("by")).select(
            "doc_id", "text_key", (F.col("start") + F.col("by")).alias("start"), "size", F.array_join(F.expr("slice(w, by + 1, size)"), " ").alias("window"))
        windows = self.item_windows.select("window").distinct()
        # a window is met from each fingerprint in it
        self.windows = stored(extended.distinct().join(windows, "window", "left_semi"), "shared-windows")

    def spans(self) -> DataFrame:
        """doc_id, text_key, start, stop: the longest runs of words that shared windows cover, in words from 0."""
        one = Window.partitionBy("doc_id", "text_key").orderBy("start", "stop")
        reached = F.max("stop").over(one.rowsBetween(Window.unboundedPreceding, -1))
        rows = self.windows.select("doc_id", "text_key", "start", (F.col("start") + F.col("size")).alias("stop")).distinct()
        new = rows.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
        return new.withColumn("run", F.sum("new").over(one)).groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")

    def items(self) -> DataFrame:
        """doc_id, text_key, item_id: the items of which a window occurs in a document."""
        met = self.windows.select("doc_id", "text_key", "window").distinct().join(self.item_windows, "window")
        return met.select("doc_id", "text_key", "class").distinct().join(self.members, "class").select("doc_id", "text_key", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs` (doc_id, text).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window is SPAN consecutive
    words of an item, or all of an item with fewer. Null texts have no words and meet nothing; rows are told apart by
    id and text, so repeated and null ids are judged by their own text; items that share an id count once; other
    columns are ignored; empty tables give no rows, or rows without hits.
    """
    found = Matches(docs, benchmark)
    key = ["doc_id", "text_key"]
    hit = found.spans().groupBy(*key).agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"))
    # the list of one document's items is its result, nothing larger is gathered
    items = found.items().groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    per = hit.alias("h").join(items.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.text_key") == F.col("i.text_key"))).select(
        F.col("h.doc_id").alias("hit_id"), F.col("h.text_key").alias("hit_key"), "n_hit", F.size("ids").alias("n"), F.sha2(F.array_join("ids", ","), 256).alias("sha"))
    docs_ = found.scanned.select("doc_id", "text_key", "n_words")
    joined = docs_.join(per, docs_["doc_id"].eqNullSafe(F.col("hit_id")) & (docs_["text_key"] == F.col("hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS said
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS said
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
o AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, said)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
