"""Tables that change together: failures before the swap, repeated batches, conflicts, growing transcripts."""

import pytest
from pyspark.sql import functions as F

from turnlake.operators.assemble import assemble_exchanges
from turnlake.sources import store

EX = "id string, archive_path string, project string, user_message string, assistant_message string"


def exchanges(spark, ids, project="p"):
    return spark.createDataFrame([(i, f"/{i[0]}", project, f"ask {i}", "the answer") for i in ids], EX)


def vectors(spark, ids, width=2):
    return spark.createDataFrame([(i, [0.5] * width) for i in ids], "id string, embedding array<float>")


def calls(spark, pairs):
    return spark.createDataFrame([(c, i, "t") for c, i in pairs], "id string, exchange_id string, tool_name string")


def state(archive):
    out = {t: sorted(r[k] for r in archive.read(t).collect()) for t, k in (("exchanges", "id"), ("vectors", "id"), ("tool_calls", "id"))}
    return out | {"postings": sorted({r["id"] for r in archive.read("postings").collect()}), "notes": sorted((r["id"], r["text"], r["superseded_by"]) for r in archive.read("notes").collect())}


@pytest.fixture
def archive(spark, tmp_path):
    a = store.Archive(spark, str(tmp_path / "archive"), buckets=4)
    ids = [f"{x}{'0' * 31}" for x in "abcd"]
    store.upsert_exchanges(a, exchanges(spark, ids), vectors(spark, ids), calls(spark, [("c1", ids[0]), ("c2", ids[0]), ("c3", ids[1])]), 2)
    a.commit({"notes": (None, spark.createDataFrame([("n1", f"x [#{ids[0]}]\ny [#{ids[1]}]", "n2"), ("n2", f"z [#{ids[0]}]", None)], "id string, text string, superseded_by string"))})
    return a


def test_upsert_and_delete(spark, archive):
    a, b, c, d = (f"{x}{'0' * 31}" for x in "abcd")
    again = exchanges(spark, [a]).withColumns({"project": F.lit("old"), "seq": F.lit(1)}).unionByName(exchanges(spark, [a]).withColumns({"project": F.lit("new"), "seq": F.lit(2)}))
    store.upsert_exchanges(archive, again, vectors(spark, [a, c]), calls(spark, [("c9", a), ("c8", c)]), 2, seq="seq")
    now = state(archive)
    assert now["exchanges"] == now["vectors"] == now["postings"] == [a, b, c, d] and now["tool_calls"] == ["c3", "c9"]
    assert {r["id"]: r["project"] for r in archive.read("exchanges").collect()}[a] == "new"
    with pytest.raises(ValueError):
        store.upsert_exchanges(archive, exchanges(spark, [a]), vectors(spark, [a], 3), calls(spark, []), 2)
    assert state(archive) == now
    # its line goes, the note without lines goes, and what that superseded is active again
    store.delete_exchanges(archive, spark.createDataFrame([(a,)], "id string"))
    now = state(archive)
    assert now["exchanges"] == now["vectors"] == now["postings"] == [b, c, d] and now["tool_calls"] == ["c3"] and now["notes"] == [("n1", f"y [#{b}]", None)]
    store.delete_for_archive(archive, spark.createDataFrame([("/b",), ("/unknown",)], "archive_path string"))
    assert state(archive)["exchanges"] == [c, d] and state(archive)["notes"] == []
    assert archive.read("exchanges", 1).count() == 4


def test_prune(spark, archive):
    asked = spark.createDataFrame([("p",), ("none",)], "project string")
    before = state(archive)
    assert store.prune_projects(archive, asked.filter("false")).first().asDict() == {"exchanges": 0, "chars_freed": 0, "bytes_freed": 0, "tool_calls": 0, "vectors": 0}
    assert store.prune_projects(archive, asked, dry_run=True).first()["tool_calls"] == 3 and state(archive) == before
    assert store.prune_projects(archive, asked).first().asDict() == {"exchanges": 4, "chars_freed": 4 * 46, "bytes_freed": 4 * 46, "tool_calls": 3, "vectors": 4}
    assert not any(state(archive).values())


def test_a_failure_before_the_swap_changes_nothing(spark, archive, monkeypatch):
    before, fresh = state(archive), ["e" + "0" * 31]
    monkeypatch.setattr(store.Archive, "_swap", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert_exchanges(archive, exchanges(spark, fresh), vectors(spark, fresh), calls(spark, []), 2, batch=("s", 0))
    monkeypatch.undo()
    assert state(archive) == before
    assert store.upsert_exchanges(archive, exchanges(spark, fresh), vectors(spark, fresh), calls(spark, []), 2, batch=("s", 0))
    assert not store.upsert_exchanges(archive, exchanges(spark, ["f" + "0" * 31]), vectors(spark, []), calls(spark, []), 2, batch=("s", 0))
    after = state(archive)
    assert len(after["exchanges"]) == 5
    assert archive.clean(keep=1) > 0 and state(archive) == after


def test_two_writers_conflict(spark, archive):
    rows = exchanges(spark, ["g" + "0" * 31])
    stale = archive.manifest()
    archive.commit({"exchanges": (None, rows)})
    other = store.Archive(spark, archive.folder, 4)
    other.manifest = lambda version=None: stale
    with pytest.raises(store.Conflict):
        other.commit({"exchanges": (None, rows)})
    assert archive.read("exchanges").count() == 5


LINES = "path string, project string, session_id string, line_no int, role string, text string, ts_raw string, is_sidechain boolean"


def test_ingest_of_growing_transcripts(spark, tmp_path, monkeypatch):
    said = [(f"/p/{p}", "p", f"s{p}", n, "user" if n % 3 == 1 else "assistant", f"{p}-{n}", f"2024-01-01T00:00:{n:02}Z", False) for p in "abc" for n in range(1, 11)]
    lines, spool = spark.createDataFrame(said, LINES), str(tmp_path / "spool")
    archive = store.Archive(spark, str(tmp_path / "archive"), buckets=4)
    for k, most in enumerate((2, 5, 5, 10)):
        held = spark.read.schema(lines.schema).parquet(spool) if k else None
        # the last file only appears in the second trigger
        now = lines.filter((F.col("line_no") <= most) & ((F.col("path") != "/p/c") | F.lit(k > 0)))
        store.unseen_lines(now, held).write.mode("append").parquet(spool)
        stream = spark.readStream.schema(lines.schema).parquet(spool)
        if k == 1:
            # fails half-way, after the tables were written
            swap = store.Archive._swap
            monkeypatch.setattr(store.Archive, "_swap", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(Exception):
                store.stream_ingest(stream, archive, "t")
            monkeypatch.setattr(store.Archive, "_swap", swap)
        store.stream_ingest(stream, archive, "t")
        want = sorted(map(tuple, assemble_exchanges(now).collect()))
        assert sorted(map(tuple, archive.read("exchanges").collect())) == want
        assert {r["id"] for r in archive.read("postings").collect()} == {r[0] for r in want}
    # a batch that had been taken in before its commit was noted
    assert not store.ingest_messages(archive, lines.limit(3), ("t", 0))
    assert sorted(map(tuple, archive.read("messages").select(lines.columns).collect())) == sorted(said)


def test_a_batch_puts_its_exchanges_together_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda i: seen.add(1) or i, "string").asNondeterministic()
    monkeypatch.setattr(store, "assemble_exchanges", lambda lines: assemble_exchanges(lines).withColumn("id", counted("id")))
    rows = [(f"/{p}", "p", p, n, "user" if n % 2 else "assistant", f"text {n}", "2024-01-01T00:00:00Z", False) for p in "abcde" for n in range(1, 9)]
    lines = spark.createDataFrame(rows, "path string, project string, session_id string, line_no int, role string, text string, ts_raw string, is_sidechain boolean")
    archive = store.Archive(spark, str(tmp_path / "archive"), buckets=4)
    store.ingest_messages(archive, lines, ("s", 0))
    assert archive.read("exchanges").count() == seen.value == 20
    assert archive.read("postings").select("id").distinct().count() == 20


def test_postings_of_other_buckets_stop_a_commit(spark, archive):
    rows = spark.createDataFrame([(f"{i}", "user_message", 0, "x") for i in range(40)], "id string, field string, pos int, term string")
    with pytest.raises(ValueError):
        archive.commit({"postings": (rows.limit(1).select("id"), rows)})
