"""Registered queries over streams and over archive tables that change together, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnlake.plans import adapters as V
from turnlake.queries import query
from turnlake.review_queries import NOTES, notes
from turnlake.sources import store
from turnlake.streaming import keyed, streams


def events(spark, d):
    return streams.event_stream(spark, f"{d}/events.parquet")


@query("""SELECT strftime(w, '%Y-%m-%d') AS week, event_type, count(*) AS n FROM (SELECT date_trunc('week', ts) AS w, event_type FROM events)
  GROUP BY w, event_type HAVING w + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def r4_stream_week_counts(spark, d):
    return streams.drained(streams.tier_counts(events(spark, d), "week", "30 minutes"), "weeks").select(F.date_format("period_start", "yyyy-MM-dd").alias("week"), "event_type", "n")


@query("""WITH v_gap AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
v_s AS (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM v_gap)
SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM v_s WHERE s = 0 GROUP BY user_id
HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def r3_stream_session_state(spark, d):
    with keyed.keyed_state(spark):
        return streams.drained(keyed.session_state(events(spark, d), "user_id", 12 * 3600, "1 hour", 3650 * 86400), "session-state")


@query("""SELECT session, CASE WHEN stop IS NULL THEN 'pending' WHEN stop_ok THEN 'done' ELSE 'rejected' END AS status, coalesce(stop_failed, total) AS attempts FROM (
  SELECT session, min(CASE WHEN ok OR failed >= 3 THEN seq END) AS stop, arg_min(ok, seq) FILTER (ok OR failed >= 3) AS stop_ok, arg_min(failed, seq) FILTER (ok OR failed >= 3) AS stop_failed, max(failed) AS total
  FROM (SELECT CAST(task_id AS VARCHAR) AS session, id AS seq, turns > 80 AS ok, count(*) FILTER (NOT turns > 80) OVER (PARTITION BY task_id ORDER BY id) AS failed FROM v_attempts) GROUP BY 1)""")
def r6_stream_status_fold(spark, d):
    """What came before the 2,000th event is the batch table, from which the stream goes on."""
    from turnlake.operators.review import fold_session_status

    def told(rows):
        return rows.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("long") > 80).alias("ok"))

    before = fold_session_status(told(V.table(spark, d, "events").filter("event_id < 2000")))
    return keyed.StatusFold(spark, before).run(told(events(spark, d).filter("event_id >= 2000"))).current()


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def r7_late_and_reconciled(spark, d):
    """The events come in three triggers that are not in the order of time, so that many are late."""
    rows = V.table(spark, d, "events").select("event_id", "ts", "event_type")
    late = keyed.LateRows(spark, "1 day", "6 HOURS")
    for k in range(3):
        late.take(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), k)
    return late.reconciled().select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT id, archive_path, project, user_message, assistant_message, line_start, line_end FROM v_exchanges")
def r1_stream_ingest(spark, d):
    """Transcripts that grow between three triggers: each spools the lines behind the last ones, and the stream takes them in."""
    base = f"{streams.shared_root(spark)}/ingest-{uuid.uuid4().hex}"
    lines, archive = V.messages(spark, d), store.Archive(spark, f"{base}/archive")
    for most in (2, 5, None):
        spool = spark.read.schema(lines.schema).parquet(f"{base}/spool") if most != 2 else None
        now = lines if most is None else lines.filter(F.col("line_no") <= most)
        store.unseen_lines(now, spool).write.mode("append").parquet(f"{base}/spool")
        store.stream_ingest(spark.readStream.schema(lines.schema).parquet(f"{base}/spool"), archive, "spool")
    return archive.read("exchanges").select("id", "archive_path", "project", "user_message", "assistant_message", "line_start", "line_end")


def calls(ex):
    """A call for each exchange and one more for each with an even start."""
    return ex.select(F.col("id").alias("exchange_id"), F.explode(F.sequence(F.lit(0), F.when(F.col("line_start") % 2 == 0, 1).otherwise(0))).alias("k")).select(
        F.concat("exchange_id", F.lit("-"), "k").alias("id"), "exchange_id", F.concat(F.lit("tool"), "k").alias("tool_name"))


def vectors(ex):
    return ex.select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("line_start") + i).cast("float")).alias("embedding"))


CALLS = """(SELECT id AS exchange_id, id || '-' || k AS id, 'tool' || k AS tool_name FROM v_exchanges, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR line_start % 2 = 0)"""
TERMS = """(SELECT id, field, len(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+')) AS n FROM (
  SELECT id, 'user_message' AS field, user_message AS t FROM v_exchanges UNION ALL SELECT id, 'assistant_message', assistant_message FROM v_exchanges))"""


def filled(spark, d):
    """An archive of all exchanges with their calls, vectors, postings and the notes that cite them."""
    archive, ex = store.Archive(spark, f"{streams.shared_root(spark)}/archive-{uuid.uuid4().hex}"), V.exchanges(spark, d)
    store.upsert_exchanges(archive, ex, vectors(ex), calls(ex), 4)
    archive.commit({"notes": (None, notes(spark, d).select("id", "text", F.lit(None).cast("string").alias("superseded_by")))})
    return archive


def told(archive):
    """table, id, what: the rows of all tables."""
    t = archive.read
    part = lambda df, name, key, what: df.select(F.lit(name).alias("table"), F.col(key).alias("id"), what.cast("string").alias("what"))
    terms = t("postings").groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"))
    out = part(t("exchanges"), "exchanges", "id", F.col("project"))
    for more in (part(t("tool_calls"), "tool_calls", "id", F.col("tool_name")), part(t("vectors"), "vectors", "id", F.col("embedding")[0].cast("int")),
                 part(terms, "postings", "id", F.concat("field", F.lit(" "), "n")), part(t("notes"), "notes", "id", F.md5("text"))):
        out = out.unionByName(more)
    return out


def told_sql(gone, project="project", cited=None):
    """SQL of told(), without the exchanges whose id is in `gone`; notes lose the lines that cite `cited`."""
    cited = cited or gone
    return f"""SELECT 'exchanges' AS "table", id, {project} AS what FROM v_exchanges WHERE id NOT IN ({gone})
  UNION ALL SELECT 'tool_calls', id, tool_name FROM {CALLS} WHERE exchange_id NOT IN ({gone})
  UNION ALL SELECT 'vectors', id, CAST(line_start AS VARCHAR) FROM v_exchanges WHERE id NOT IN ({gone})
  UNION ALL SELECT 'postings', id, field || ' ' || n FROM {TERMS} WHERE n > 0 AND id NOT IN ({gone})
  UNION ALL SELECT 'notes', id, md5(string_agg(line, chr(10) ORDER BY pos)) FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {NOTES})
    WHERE regexp_extract(line, '#([0-9a-f]{{32}})', 1) NOT IN ({cited}) GROUP BY id"""


NONE = "SELECT ''"


@query(f"""SELECT * FROM ({told_sql(NONE, "CASE WHEN project = 'p2' THEN 'moved' ELSE project END")}) t
  WHERE NOT ("table" = 'tool_calls' AND id LIKE '%-1' AND id[:32] IN (SELECT id FROM v_exchanges WHERE project = 'p2'))""")
def s8_upsert_all_tables(spark, d):
    """A project's exchanges come again twice in a batch, with one call each: the last rows stay and their second calls go."""
    archive = filled(spark, d)
    own = V.exchanges(spark, d).filter("project = 'p2'")
    batch = own.withColumns({"project": F.lit("lost"), "seq": F.lit(1)}).unionByName(own.withColumns({"project": F.lit("moved"), "seq": F.lit(2)}))
    store.upsert_exchanges(archive, batch, vectors(own), calls(own).filter("id LIKE '%-0'"), 4, seq="seq")
    return told(archive)


@query(told_sql("SELECT id FROM v_exchanges WHERE archive_path IN (SELECT archive_path FROM v_exchanges WHERE line_end >= 6)"))
def s9_delete_all_tables(spark, d):
    archive = filled(spark, d)
    store.delete_for_archive(archive, archive.read("exchanges").filter("line_end >= 6").select("archive_path"))
    return told(archive)


@query(f"""SELECT count(*) AS exchanges, coalesce(sum(length(user_message || assistant_message)), 0)::BIGINT AS chars_freed,
  coalesce(sum(octet_length(encode(user_message || assistant_message))), 0)::BIGINT AS bytes_freed, (SELECT count(*) FROM {CALLS} c JOIN v_exchanges e ON e.id = c.exchange_id WHERE project IN ('p1', 'p4')) AS tool_calls,
  count(*) AS vectors, (SELECT count(*) FROM v_exchanges WHERE project NOT IN ('p1', 'p4')) AS left_over FROM v_exchanges WHERE project IN ('p1', 'p4')""")
def s10_prune_all_tables(spark, d):
    archive = filled(spark, d)
    counts = store.prune_projects(archive, spark.createDataFrame([("p1",), ("p4",), ("none",)], "project string"))
    return counts.crossJoin(archive.read("exchanges").agg(F.count(F.lit(1)).alias("left_over")))
