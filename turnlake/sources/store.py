"""Archive tables that change together: buckets are written anew beside the old ones, then one manifest is swapped in."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnlake.operators.archive import prune_counts
from turnlake.operators.assemble import assemble_exchanges
from turnlake.operators.review import remove_derived
from turnlake.operators.text_index import build_postings

#: The column by which each table is dealt into buckets and changed; those of an exchange share its bucket.
KEYS = {"exchanges": "id", "tool_calls": "exchange_id", "vectors": "id", "postings": "id", "notes": "id", "messages": "path"}
BUCKETS = 32

#: A change of a table: rows whose key is among the keys go, the new rows come. Either may be None.
Change = tuple[DataFrame | None, DataFrame | None]


class Conflict(RuntimeError):
    """Another commit came first; the change must be made again from what it left."""


class Archive:
    """Tables in a folder. A commit writes the touched buckets of all its tables and then one manifest, or changes nothing.

    A manifest names the folder of each bucket, so readers see all tables at one version. It also names the last batch of
    each stream that was taken in, so that a batch which runs again after a failure is left out.
    """

    #: Tables whose new rows come from exchanges among a change's keys, so that they need not be made to find their buckets.
    DERIVED = ("postings",)

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{below}" if below else self.folder)

    def _versions(self) -> list[int]:
        place = self._path("manifests")
        names = [x.getPath().getName() for x in self._files.listStatus(place)] if self._files.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version, or the current one, consists of."""
        found = self._versions()
        if not found:
            return {"version": 0, "tables": {}, "batches": {}}
        stream = self._files.open(self._path(f"manifests/{version or found[-1]:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        draft = self._path(f"manifests/draft-{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path(f"manifests/{manifest['version']:010d}.json"), never_over)
        except Exception as e:
            raise Conflict(f"version {manifest['version']} of {self.folder} exists") from e

    def _rows(self, manifest: dict, table: str, buckets: set[int] | None = None) -> DataFrame | None:
        held = manifest["tables"].get(table)
        if held is None:
            return None
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.folder}/{table}/{at}/bucket={b}" for b, at in held["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as it is now or was at a version; None if it has never been written."""
        return self._rows(self.manifest(version), table)

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def commit(self, changes: Callable[[dict], dict[str, Change]] | dict[str, Change], batch: tuple[str, int] | None = None) -> bool:
        """Makes all changes at once; False if the batch (stream, number) is in already. Readers see the old state until it ends.

        Only buckets that hold a changed key are read and written, and the keys themselves are joined, never collected.
        """
        now = self.manifest()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return False
        tables = dict(now["tables"])
        for table, (keys, rows) in (changes(now) if callable(changes) else changes).items():
            key, at = KEYS[table], uuid.uuid4().hex
            if rows is None and table not in tables:
                continue
            both = [x.select(key) for x in (keys, None if table in self.DERIVED and keys is not None else rows) if x is not None]
            touched = both[0] if len(both) == 1 else both[0].unionByName(both[1])
            buckets = {r["b"] for r in touched.select(self._bucket(key).alias("b")).distinct().collect()}
            old = self._rows(now, table, buckets)
            if old is not None and keys is not None:
                old = old.join(keys.select(key).distinct(), key, "left_anti").select(*old.columns)
            new = rows if old is None else old if rows is None else old.unionByName(rows, allowMissingColumns=True)
            new.withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{table}/{at}")
            there = {x.getPath().getName() for x in self._files.listStatus(self._path(f"{table}/{at}"))}
            if not {f"bucket={b}" for b in buckets} >= {x for x in there if x.startswith("bucket=")}:
                raise ValueError(f"{table}: new rows lie in other buckets than their keys")
            held = {b: v for b, v in tables.get(table, {"buckets": {}})["buckets"].items() if int(b) not in buckets}
            tables[table] = {"schema": new.schema.jsonValue(), "buckets": held | {str(b): at for b in sorted(buckets) if f"bucket={b}" in there}}
        self._swap({"version": now["version"] + 1, "tables": tables, "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})})
        return True

    def clean(self, keep: int = 2) -> int:
        """Deletes folders that none of the last `keep` versions names, and the manifests before; how many folders went."""
        last = self._versions()[-keep:]
        named = {(t, at) for v in last for t, held in self.manifest(v)["tables"].items() for at in held["buckets"].values()}
        gone = 0
        for table in KEYS:
            place = self._path(table)
            for x in self._files.listStatus(place) if self._files.exists(place) else ():
                if (table, x.getPath().getName()) not in named:
                    gone += bool(self._files.delete(x.getPath(), True))
        for v in self._versions():
            if v not in last:
                self._files.delete(self._path(f"manifests/{v:010d}.json"), False)
        return gone


def _last(batch: DataFrame, seq: str | None) -> DataFrame:
    """One row an id: the last by `seq`."""
    if seq is None:
        return batch
    columns = [c for c in batch.columns if c not in ("id", seq)]
    return batch.groupBy("id").agg(F.max_by(F.struct(*columns), seq).alias("_r")).select("id", "_r.*")


def exchange_postings(exchanges: DataFrame) -> DataFrame:
    return build_postings(exchanges, "id", ["user_message", "assistant_message"])


def upsert_exchanges(archive: Archive, exchanges: DataFrame, vectors: DataFrame, tool_calls: DataFrame, width: int, seq: str | None = None, batch: tuple[str, int] | None = None) -> bool:
    """Exchanges by id, the last by `seq`; the tool calls, vectors and postings of replaced ids go, the new ones come.

    A vector (id, embedding) of another width than the archive's stops the commit before anything is written.
    """
    if not vectors.filter(F.coalesce(F.size("embedding") != width, F.lit(True))).isEmpty():
        raise ValueError(f"vectors must hold {width} numbers")
    rows = _last(exchanges, seq).persist()
    ids = rows.select("id")
    # what comes is made once, for its buckets and itself
    own = lambda df, key: df.join(ids.withColumnRenamed("id", key), key, "left_semi").persist()
    found, calls = own(vectors, "id"), own(tool_calls, "exchange_id")
    try:
        return archive.commit({
            "exchanges": (ids, rows), "vectors": (ids, found), "tool_calls": (ids.withColumnRenamed("id", "exchange_id"), calls),
            "postings": (ids, exchange_postings(rows))}, batch)
    finally:
        for df in (rows, found, calls):
            df.unpersist()


def _without(archive: Archive, gone: Callable[[DataFrame], DataFrame]) -> Callable[[dict], dict[str, Change]]:
    def changes(now: dict) -> dict[str, Change]:
        exchanges, notes = archive._rows(now, "exchanges"), archive._rows(now, "notes")
        if exchanges is None:
            return {}
        ids = gone(exchanges).select("id")
        out: dict[str, Change] = {t: (ids.withColumnRenamed("id", KEYS[t]), None) for t in ("exchanges", "vectors", "tool_calls", "postings")}
        if notes is not None:
            left = remove_derived(notes, ids)
            kept = notes.drop("text", "superseded_by").join(left, "id")
            # only notes that are not as before are written
            same = notes.alias("a").join(left.alias("b"), F.expr("a.id = b.id AND a.text = b.text AND a.superseded_by <=> b.superseded_by"), "left_semi").select("id")
            out["notes"] = (notes.join(same, "id", "left_anti").select("id"), kept.join(same, "id", "left_anti"))
        return out

    return changes


def delete_exchanges(archive: Archive, ids: DataFrame) -> bool:
    """Exchanges by id with their vectors, postings, tool calls and the lines of notes that cite them (D9), in one commit."""
    return archive.commit(_without(archive, lambda ex: ex.join(ids.select("id"), "id", "left_semi")))


def delete_for_archive(archive: Archive, paths: DataFrame) -> bool:
    """All exchanges of the given archive paths, as delete_exchanges()."""
    return archive.commit(_without(archive, lambda ex: ex.join(paths.select("archive_path"), "archive_path", "left_semi")))


def prune_projects(archive: Archive, projects: DataFrame, dry_run: bool = False) -> DataFrame:
    """Exchanges, chars_freed, bytes_freed, tool_calls and vectors of the given projects; unless it is a dry run they go.

    The counts are of the version before. No projects, or none that is known, change nothing.
    """
    now = archive.manifest()
    exchanges = archive._rows(now, "exchanges")
    ids = exchanges.join(projects.select("project"), "project", "left_semi").select("id")

    def counted(table: str) -> DataFrame:
        rows = archive._rows(now, table)
        own = None if rows is None else rows.join(ids.withColumnRenamed("id", KEYS[table]), KEYS[table], "left_semi")
        return archive.spark.range(1).select(F.lit(0).cast("long").alias(table)) if own is None else own.agg(F.count(F.lit(1)).alias(table))

    counts = prune_counts(exchanges, projects).crossJoin(counted("tool_calls")).crossJoin(counted("vectors"))
    if not dry_run and not ids.isEmpty():
        archive.commit(_without(archive, lambda ex: ex.join(projects.select("project"), "project", "left_semi")))
    return counts


def unseen_lines(lines: DataFrame, spool: DataFrame | None) -> DataFrame:
    """Lines (path, line_no, …) behind the last one of their path that `spool` holds: what has been appended since."""
    if spool is None:
        return lines
    marks = spool.groupBy("path").agg(F.max("line_no").alias("_mark"))
    return lines.join(marks, "path", "left").filter("_mark IS NULL OR line_no > _mark").drop("_mark")


def ingest_messages(archive: Archive, messages: DataFrame, batch: tuple[str, int]) -> bool:
    """R1, one micro-batch: messages (path, line_no, …) come in by path and line, and the exchanges of their paths are built anew.

    Exchanges that a longer transcript ends elsewhere have other ids, so those of a touched path are all replaced.
    """
    fresh, made = messages.persist(), []
    try:
        def changes(now: dict) -> dict[str, Change]:
            paths = fresh.select("path").distinct()
            held = archive._rows(now, "messages")
            lines = fresh if held is None else held.join(paths, "path", "left_semi").join(fresh.select("path", "line_no"), ["path", "line_no"], "left_anti").unionByName(fresh)
            # the exchanges are put together once, for their ids, themselves and their postings
            rows = assemble_exchanges(lines).persist()
            made.append(rows)
            out: dict[str, Change] = {"messages": (paths, lines), "exchanges": (rows.select("id"), rows), "postings": (rows.select("id"), exchange_postings(rows))}
            before = archive._rows(now, "exchanges")
            if before is not None:
                old = before.join(paths.withColumnRenamed("path", "archive_path"), "archive_path", "left_semi").select("id")
                out |= {t: (old.unionByName(rows.select("id")), out[t][1]) for t in ("exchanges", "postings")}
            return out

        return archive.commit(changes, batch)
    finally:
        for df in (fresh, *made):
            df.unpersist()


def stream_ingest(stream: DataFrame, archive: Archive, name: str) -> None:
    """Takes in what a stream of messages has, from its last batch on. Batches that run twice or fail half-way leave no trace."""
    def take(df: DataFrame, batch: int) -> None:
        ingest_messages(archive, df, (name, batch))

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{archive.folder}/progress-{name}").trigger(availableNow=True).start().awaitTermination()
