"""Keyed state: sessions once, restarts, time to live; statuses from a batch table; late rows and what mends them."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from turnlake.operators.review import fold_session_status
from turnlake.streaming import keyed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "user_id int, ts timestamp, event_type string"


def at(minutes):
    return START + timedelta(minutes=minutes)


class Sink:
    """A stream over a folder of events, whose rows and progress outlive its runs."""

    def __init__(self, spark, tmp_path, keep_s):
        self.spark, self.base, self.keep_s = spark, str(tmp_path), keep_s

    def run(self, rows, files=1):
        for k in range(files):
            self.spark.createDataFrame(rows[k::files], EVENTS).coalesce(1).write.mode("append").parquet(f"{self.base}/in")
        stream = self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")
        with keyed.keyed_state(self.spark):
            out = keyed.session_state(stream, "user_id", 30 * 60, "60 minutes", self.keep_s)
            out.writeStream.format("parquet").option("path", f"{self.base}/out").option("checkpointLocation", f"{self.base}/state").outputMode("append").trigger(
                availableNow=True).start().awaitTermination()
        got = self.spark.read.schema(out.schema).parquet(f"{self.base}/out").collect()
        minute = lambda us: (us // 1_000_000 - int(START.timestamp())) // 60
        return sorted((r["key"], minute(r["started"]), minute(r["ended"]), r["n"]) for r in got)


def test_a_session_comes_once_and_survives_a_restart(spark, tmp_path):
    sink = Sink(spark, tmp_path, keep_s=10 * 86400)
    # the first run ends while session 1 is open
    assert sink.run([(1, at(0), "x"), (1, at(20), "x"), (2, at(5), "x"), (None, at(1), "x"), (9, at(70), "x")]) == []
    first = sink.run([(1, at(15), "x"), (9, at(100), "x")])
    assert ("2", 5, 5, 1) in first and not [r for r in first if r[0] == "1"]
    second = sink.run([(9, at(200), "x"), (1, at(50), "x")])
    assert [r for r in second if r[0] == "1"] == [("1", 0, 20, 3)]
    # late rows, and rows of the same key after its quiet time, change nothing
    third = sink.run([(1, at(21), "x"), (1, at(400), "x"), (2, at(6), "x"), (9, at(900), "x")])
    assert [r for r in third if r[0] in "12"] == [("1", 0, 20, 3), ("2", 5, 5, 1)]


def test_state_goes_after_its_time_to_live(spark, tmp_path):
    sink = Sink(spark, tmp_path, keep_s=3600)
    sink.run([(1, at(0), "x"), (2, at(500), "x")])
    got = sink.run([(1, at(600), "x"), (2, at(1200), "x"), (3, at(2000), "x")])
    assert [r for r in got if r[0] == "1"] == [("1", 0, 0, 1), ("1", 600, 600, 1)]


@pytest.mark.parametrize("files", [1, 4])
def test_sessions_equal_the_batch_result(spark, tmp_path, files):
    rnd = random.Random(files)
    rows = [(k, at(t), "x") for k in range(8) for t in (rnd.randint(0, 600) for _ in range(rnd.randint(1, 9)))]
    # in order of time but for less than the delay, so that no row is late
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rnd.randint(0, 50)))
    size = -(-len(rows) // files)
    sink = Sink(spark, tmp_path, keep_s=10 * 86400)
    for k in range(files):
        got = sink.run(rows[k * size : (k + 1) * size])
    top, want = max(r[1] for r in rows), []
    for k in range(8):
        times = sorted(r[1] for r in rows if r[0] == k)
        n = next((i for i in range(1, len(times)) if times[i] - times[i - 1] >= timedelta(minutes=30)), len(times))
        if times[n - 1] + timedelta(minutes=30) <= top - timedelta(minutes=60):
            want.append((str(k), (times[0] - START).seconds // 60, (times[n - 1] - START).seconds // 60, n))
    assert got == want and want


def test_status_fold_over_two_runs_equals_the_batch_fold(spark, tmp_path):
    rnd = random.Random(5)
    events = [(f"s{rnd.randint(0, 9)}", seq, rnd.random() < 0.2) for seq in range(60)]
    schema = "session string, seq int, ok boolean"
    whole = {r["session"]: (r["status"], r["attempts"]) for r in fold_session_status(spark.createDataFrame(events, schema)).collect()}
    known = fold_session_status(spark.createDataFrame(events[:15], schema))
    extra = known.unionByName(spark.createDataFrame([("old", "rejected", 3), ("half", "pending", 2)], "session string, status string, attempts long"))
    fold = keyed.StatusFold(spark, extra.persist(), str(tmp_path / "fold"))
    for k, part in enumerate((events[15:40], events[40:] + [("old", 90, True), ("half", 91, False)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        fold.run(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
        fold = keyed.StatusFold(spark, extra, str(tmp_path / "fold"))
    now = {r["session"]: (r["status"], r["attempts"]) for r in fold.current().collect()}
    assert now == whole | {"old": ("rejected", 3), "half": ("rejected", 3)}


def test_late_rows_are_told_apart_and_mended(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, at(rnd.randint(0, 6000)), rnd.choice("ab")) for i in range(300)] + [(0, None, "a")]
    for k in range(5):
        spark.createDataFrame(rows[k::5], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = keyed.LateRows(spark, "1 hour", "2 HOURS", str(tmp_path / "state"))
    late.run(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    late.take(spark.createDataFrame(rows[:1], EVENTS).filter("false"), 5)
    df = spark.createDataFrame(rows, EVENTS).filter("ts IS NOT NULL")
    want = sorted(map(tuple, df.groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").count().collect()))
    assert sorted(map(tuple, late.reconciled().collect())) == want
    told, behind = late.on_time().agg(F.sum("n")).first()[0], late.late().agg(F.sum("n")).first()[0]
    assert told + behind == 300 and behind > 50 and sorted(map(tuple, late.on_time().collect())) != want
    # a batch that runs again writes the same
    late.take(spark.createDataFrame([(1, at(1), "a")], EVENTS), 6)
    one = late.late().agg(F.sum("n")).first()[0]
    late.take(spark.createDataFrame([(1, at(1), "a")], EVENTS), 6)
    assert late.late().agg(F.sum("n")).first()[0] == one == behind + 1
