"""Keyed state over the event stream: one row a session, status folds from a batch table, and rows that come late."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnlake.streaming.streams import shared_root

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed processors need, for the streams that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class _Sessions(StatefulProcessor):
    """State of a key: its session so far, the events ahead of the watermark, and whether its row is out. Times in microseconds."""

    def __init__(self, quiet: int, keep: int):
        self.quiet, self.keep = quiet, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "started bigint, ended bigint, n bigint, done boolean")
        self.ahead = handle.getMapState("ahead", "ts bigint", "n bigint")

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-at // 1000))

    def _go_on(self, key, passed: int) -> Iterator[pd.DataFrame]:
        """Takes events up to the watermark in their order; a row is out when the quiet time behind its last event has passed."""
        at = self.session.get()
        started, ended, n, done = at if at else (None, None, 0, False)
        waiting, out = sorted((k[0], v[0]) for k, v in self.ahead.iterator()), []
        for ts, count in waiting:
            if ts > passed:
                break
            self.ahead.removeKey((ts,))
            if started is not None and not done and ts - ended >= self.quiet:
                out.append((started, ended, n))
                done = True
            if done:
                if ts < ended + self.quiet + self.keep:
                    continue
                started, n, done = None, 0, False
            started, ended, n = ts if started is None else started, ts, n + count
        if started is not None and not done and ended + self.quiet <= passed:
            out.append((started, ended, n))
            done = True
        wake = [t for t, _ in waiting if t > passed][:1]
        if started is not None:
            wake.append(ended + self.quiet + (self.keep if done else 0))
        if done and wake[-1] <= passed:
            # its time to live is over
            wake.pop()
            self.session.clear()
        elif started is not None:
            self.session.update((started, ended, n, done))
        if wake:
            self._wake(min(wake))
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["key", "started", "ended", "n"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, count in part["us"].value_counts().items():
                k = (int(ts),)
                held = self.ahead.getValue(k) if self.ahead.containsKey(k) else (0,)
                self.ahead.updateValue(k, (held[0] + int(count),))
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def session_state(events: DataFrame, key: str, quiet_s: int, delay: str, keep_s: int) -> DataFrame:
    """Key, started, ended, n (times in microseconds): one row a key, once its first session has been quiet for `quiet_s`.

    Events are taken in the order of their times, however they come in within `delay`; a gap of `quiet_s` ends the session.
    Events of the next `keep_s` change nothing; then the key's state goes, and it may begin anew. Rows without key or time
    are left out. Start it inside keyed_state().
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"))
    return timed.filter("key IS NOT NULL AND ts IS NOT NULL").groupBy("key").transformWithStateInPandas(
        _Sessions(quiet_s * 1_000_000, keep_s * 1_000_000), "key string, started bigint, ended bigint, n bigint", outputMode="Append", timeMode="EventTime")


class _Status(StatefulProcessor):
    """State of a session: its status and failed attempts; done and rejected are final."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string, attempts bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.status.update((str(initialState["status"].iloc[0]), int(initialState["attempts"].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.status.get()
        status, attempts = before or ("pending", 0)
        for ok in pd.concat(list(rows)).sort_values("seq")["ok"]:
            if status != "pending":
                break
            if ok:
                status = "done"
            else:
                attempts += 1
                status = "rejected" if attempts >= self.most else status
        if before is None or before != (status, attempts):
            self.status.update((status, attempts))
            yield pd.DataFrame({"session": [key[0]], "status": [status], "attempts": [attempts]})

    def close(self) -> None:
        pass


class StatusFold:
    """The statuses that a stream of events (session, seq, ok) leads to from a batch table, kept in a folder."""

    def __init__(self, spark: SparkSession, initial: DataFrame, folder: str | None = None, most: int = 3):
        """initial: session, status, attempts of sessions that are known."""
        self.spark, self.most = spark, most
        self.folder = folder or f"{shared_root(spark)}/status-{uuid.uuid4().hex}"
        self.initial = initial.select(F.col("session").cast("string").alias("session"), "status", F.col("attempts").cast("bigint").alias("attempts"))

    def run(self, stream: DataFrame) -> StatusFold:
        """Folds what the stream has that earlier runs have not seen."""
        rows = stream.select(F.col("session").cast("string").alias("session"), "seq", "ok").filter("session IS NOT NULL")
        folded = rows.groupBy("session").transformWithStateInPandas(
            _Status(self.most), "session string, status string, attempts bigint", outputMode="Update", timeMode="None", initialState=self.initial.groupBy("session"))

        def take(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")

        with keyed_state(self.spark):
            query = folded.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def current(self) -> DataFrame:
        """session, status, attempts as they are now, of the batch table and the stream."""
        changes = self.spark.read.schema("session string, status string, attempts bigint, batch bigint").parquet(f"{self.folder}/changes")
        last = changes.groupBy("session").agg(F.max_by(F.struct("status", "attempts"), "batch").alias("s")).select("session", "s.status", "s.attempts")
        return last.unionByName(self.initial.join(last, "session", "left_anti"))


class LateRows:
    """Counts by period and type of a stream of events (ts, event_type), with the rows that come behind the watermark told apart."""

    def __init__(self, spark: SparkSession, period: str, delay: str, folder: str | None = None):
        self.spark, self.period, self.delay = spark, period, delay
        self.folder = folder or f"{shared_root(spark)}/late-{uuid.uuid4().hex}"

    def _all(self, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.folder}/{kind}")

    def take(self, events: DataFrame, batch: int) -> None:
        """One micro-batch; taken again it writes the same. The watermark is the largest time of earlier batches less the delay."""
        spark = self.spark
        seen = self._all("marks", "top timestamp").filter(F.col("batch") < batch).agg(F.max("top")).first()[0] if batch else None
        limit = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {self.delay}")
        rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").filter("ts IS NOT NULL")
        rows = rows.withColumn("late", F.coalesce(F.col("ts") <= limit, F.lit(False))).withColumn("start", F.window("ts", self.period)["start"])
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        rows = spark.read.schema("ts timestamp, event_type string, late boolean, start timestamp").parquet(f"{self.folder}/rows/batch={batch}")
        rows.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch}")
        rows.groupBy("start", "event_type", "late").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch}")

    def run(self, stream: DataFrame) -> LateRows:
        stream.writeStream.foreachBatch(lambda df, batch: self.take(df, batch)).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start().awaitTermination()
        return self

    def _counts(self) -> DataFrame:
        return self._all("counts", "start timestamp, event_type string, late boolean, n bigint")

    def on_time(self) -> DataFrame:
        """start, event_type, n of the rows that came in time: what the stream alone has told."""
        return self._counts().filter("NOT late").groupBy("start", "event_type").agg(F.sum("n").alias("n"))

    def late(self) -> DataFrame:
        """start, event_type, n of the rows that came late."""
        return self._counts().filter("late").groupBy("start", "event_type").agg(F.sum("n").alias("n"))

    def reconciled(self) -> DataFrame:
        """start, event_type, n with the periods that late rows touch counted anew from the kept rows; the others stay as told."""
        touched = self.late().select("start").distinct()
        rows = self._all("rows", "ts timestamp, event_type string, late boolean, start timestamp")
        mended = rows.join(touched, "start", "left_semi").groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n"))
        return self.on_time().join(touched, "start", "left_anti").unionByName(mended)
