"""Exact deduplication against a persistent digest index (operator 8).

The index is a table bucketed and sorted by digest. A batch of documents is reduced to digests,
pre-aggregated, sort-merge anti-joined with the index, and what is new is appended.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import documents, lookup, stored, unused, whole_text

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(whole_text(text), WHITE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) for every row; a null text has the digest of the empty text."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))


class DigestIndex:
    """Table (digest, keep_id), bucketed and sorted by digest, that outlives the job that fills it.

    With a folder in `path` it outlives the session, too: a later one finds the folder's newest whole generation, and the
    number of its buckets, and its entries stay before those of new batches. Every batch adds a file to a bucket; from
    MOST_FILES files a bucket on, a new generation with one file each is written beside the old one, which goes only then.
    One job at a time may write an index.
    """

    #: Files that a bucket holds at most before they are made one.
    MOST_FILES = 8

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.path = spark, table, path and path.rstrip("/")
        self.buckets, self.generation = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        # a folder is whole when its write was committed, and Spark marks that
        found = [(g, n) for g, n in self._generations() if self._exists(f"{self._folder(g, n)}/_SUCCESS")]
        if found:
            self.generation, self.buckets = max(found)
        self.table = self._registered(self.generation)
        if path and not found:
            self._write(self.spark.createDataFrame([], "digest BINARY, keep_id BIGINT"), self.table)

    def _folder(self, generation: int, buckets: int) -> str:
        return f"{self.path}/g{generation:06d}-b{buckets}"

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        store, where = self._files(path)
        return store.exists(where)

    def _generations(self) -> list[tuple[int, int]]:
        if not self.path or not self._exists(self.path):
            return []
        store, where = self._files(self.path)
        names = [f.getPath().getName() for f in store.listStatus(where)]
        return [(int(m[1]), int(m[2])) for m in (re.fullmatch(r"g(\d+)-b(\d+)", n) for n in names) if m]

    def _registered(self, generation: int) -> str:
        """The name of a generation's table, known to the session's catalog from then on."""
        table = f"{self.name}_g{generation}"
        place = f"LOCATION '{self._folder(generation, self.buckets)}'" if self.path else ""
        if self.path:
            # the folder decides, not what a catalog says of an older one
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {place}"
        )
        return table

    def _write(self, rows: DataFrame, table: str) -> None:
        (
            rows.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, batch: DataFrame) -> None:
        """Appends the digests of `batch` (doc_id, digest) that the index lacks, with their smallest doc_id.

        An entry of an earlier batch always stays; running a batch again appends nothing.
        """
        # partial aggregation meets hot digests before the shuffle
        per = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        self._write(per.join(self.read().select("digest").hint("merge"), "digest", "left_anti"), self.table)
        if len(self.read().inputFiles()) > self.MOST_FILES * self.buckets:
            self.compact()

    def compact(self) -> None:
        """Rewrites the index with one file a bucket; until the new generation is whole the old one is the index."""
        old, oldest = self.table, self._folder(self.generation, self.buckets)
        # what a broken run left behind is not whole, and its number isn't taken again
        fresh = max([self.generation, *(g for g, _ in self._generations())]) + 1
        table = self._registered(fresh)
        # grouped bucket by bucket, as they lie: nothing is shuffled, and a task writes one file
        self._write(self.read().groupBy("digest").agg(F.min("keep_id").alias("keep_id")), table)
        self.table, self.generation = table, fresh
        self._remove(old, oldest)

    def drop(self) -> None:
        """Removes the index."""
        self._remove(self.table, self.path)

    def _remove(self, table: str, folder: str | None) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        if self.path and folder:
            store, where = self._files(folder)
            store.delete(where, True)


def resolve(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row for each of `rows` (doc_id, digest).

    Rows that repeat a doc_id and a text are told apart by count: the first copy of the kept one stays.
    """
    per = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    sizes = per.groupBy("digest").agg(F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("ids"))
    keyed = sizes.join(index.read().hint("merge"), "digest")
    keyed = stored(keyed, "digest-groups")
    found = lookup(per, keyed, "digest", "ids")
    return found.select(
        "doc_id", "keep_id", "group_size", "digest",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest",
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """Decisions of exact deduplication for all rows of `docs` (doc_id, text, others ignored).

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null and empty texts are one group; null
    doc_ids come last and stay only when no other row has the text; an empty table gives no rows.
    The batches are ranges of ascending doc_id, so the smallest doc_id of a text reaches the index first.
    With an `index` of earlier batches a text it has is no longer kept, unless under the same doc_id, and keep_id is that
    of the entry; group_size counts rows of `docs`. Without one an index is made for this call and dropped with it.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs), "digests")
    own = index or DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    step = max(1, -(-(high - low + 1) // batches))
    turn = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(step)), F.lit(batches - 1))
    for i in range(batches):
        own.ingest(rows.filter(turn == i))
    # written, as an index may be dropped, made one or go on before the decisions are read
    out = stored(resolve(rows, own), "decisions")
    if index is None:
        own.drop()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that the decisions keep; of a repeated row one copy stays.

    Decisions are found by doc_id and digest, so rows that share an id, or have none, but differ in text are told apart.
    """
    (sha,) = unused(docs, "_sha")
    kept = decisions.groupBy("doc_id", "text_sha256").agg(
        F.max(F.col("kept").cast("int")).alias("stays"), F.count(F.lit(1)).alias("rows")
    ).filter("stays = 1").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"), "rows")
    own = docs.withColumn(sha, F.sha2(normalised(), 256))
    same = own["doc_id"].eqNullSafe(kept["kept_id"]) & (own[sha] == kept["kept_sha"])
    once = own.join(kept.filter(kept["rows"] == 1), same, "left_semi")
    more = own.join(kept.filter(kept["rows"] > 1), same, "left_semi").dropDuplicates(["doc_id", sha])
    return once.unionByName(more).drop(sha)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
