"""Registered queries over states of summaries, tasks and attempts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import state as T
from turnlake.plans import adapters as V
from turnlake.queries import query


def summaries(spark, d):
    """A summary for each labelled conversation: empty for toxic ones, long for good ones."""
    n = F.col("doc_id")
    text = F.when(F.col("toxic") == 1, "").when(F.col("quality") == 1, F.repeat(F.lit("good "), 9)).otherwise("text")
    path = F.concat(F.lit("/archive/p"), n % 7, F.lit("/"), n, F.lit(".jsonl"))
    return V.table(spark, d, "labels").select(
        path.alias("path"), text.alias("text"), F.when(n % 3 > 0, n % 4).alias("attempts"), F.when(n % 5 == 0, "skipped: short").alias("reason"), (n % 11 == 0).alias("gave_up"))


SUMMARIES = """(SELECT '/archive/p' || (doc_id % 7) || '/' || doc_id || '.jsonl' AS path, CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN repeat('good ', 9) ELSE 'text' END AS text,
  CASE WHEN doc_id % 3 > 0 THEN doc_id % 4 END AS attempts, CASE WHEN doc_id % 5 = 0 THEN 'skipped: short' END AS reason, doc_id % 11 = 0 AS gave_up FROM labels)"""
STATES = f"""(SELECT m.path, project, session_id, CASE WHEN s.path IS NULL THEN 'pending' WHEN coalesce(trim(s.text), '') <> '' THEN 'done' WHEN attempts IS NULL THEN 'unexplained'
  WHEN gave_up OR coalesce(reason, '') <> '' THEN 'terminal' ELSE 'retrying' END AS state
  FROM (SELECT DISTINCT path, project, CASE WHEN session_id NOT LIKE '%3' THEN session_id END AS session_id FROM v_messages) m LEFT JOIN {SUMMARIES} s ON s.path = m.path)"""


def states(spark, d):
    m = V.messages(spark, d).select("path", "project", F.when(~F.col("session_id").like("%3"), F.col("session_id")).alias("session_id")).distinct()
    return T.summary_state(m, summaries(spark, d))


@query(f"""SELECT id, e.archive_path, CASE WHEN length(s.text) > 20 THEN substr(s.text, 1, 20) || '…' ELSE s.text END AS summary
  FROM v_exchanges e LEFT JOIN {SUMMARIES} s ON s.path = e.archive_path""")
def f6_with_summary(spark, d):
    return T.with_summary(V.exchanges(spark, d).select("id", "archive_path"), summaries(spark, d).withColumnRenamed("path", "archive_path"), 20)


@query(r"""SELECT item_id, CASE WHEN n < 1 THEN 'no query' WHEN s < 2 THEN 'query too short' WHEN n > 5 THEN 'too many concepts' WHEN lim < 1 OR lim > 50 THEN 'bad limit' END AS error, coalesce(lim, 10) AS "limit" FROM (
  SELECT item_id, len(c) AS n, list_min(list_transform(c, lambda x: length(x))) AS s, CASE WHEN item_id % 4 > 0 THEN item_id % 60 END AS lim FROM (
    SELECT item_id, string_split(text, ' ')[1:item_id % 7] AS c FROM benchmark))""")
def f8_validate_queries(spark, d):
    q = V.table(spark, d, "benchmark").select("item_id", F.slice(F.split("text", " "), F.lit(1), (F.col("item_id") % 7).cast("int")).alias("concepts"),
                                              F.when(F.col("item_id") % 4 > 0, F.col("item_id") % 60).alias("limit"))
    return T.query_status(q).select("item_id", "error", "limit")


@query("""SELECT task_id FROM v_tasks WHERE task_id % 2 = 1 AND task_id % 5 <> 2 AND kind IN ('locate', 'recall', 'when') AND tier IN (2, 3)""")
def f10_list_tasks(spark, d):
    own = V.tasks(spark, d).withColumn("split", F.when(F.col("task_id") % 2 == 1, "test").otherwise("train")).withColumn("status", F.when(F.col("task_id") % 5 == 2, "stale"))
    return T.list_tasks(own, "test", ["locate", "recall", "when"], [2, 3]).select("task_id")


@query("""SELECT id FROM v_attempts WHERE run_id = 1 AND event_type = (SELECT min(event_type) FROM events)""")
def f11_list_attempts(spark, d):
    role = V.table(spark, d, "events").agg(F.min("event_type")).first()[0]
    return T.list_attempts(V.attempts(spark, d).withColumnRenamed("event_type", "role"), run=1, role=role).select("id")


@query("""SELECT task_id, round(list_reduce(list_prepend(0.5::DOUBLE, es), lambda c, e: CASE WHEN e > 0 THEN c + (1 - c) * 0.1 ELSE c - c * 0.2 END), 6) AS confidence,
  len(list_filter(es, lambda e: e > 0)) AS support, len(list_filter(es, lambda e: e = 0)) AS contradictions FROM (
  SELECT task_id, list(CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY id) AS es FROM v_attempts GROUP BY 1)""")
def g16_fold_heuristic(spark, d):
    return T.fold_heuristic(V.attempts(spark, d).select("task_id", F.col("id").alias("seq"), F.lit(0.5).alias("start"), F.col("passed").alias("reinforces")), "task_id")


@query(f"SELECT path, state FROM {STATES}")
def g18_summary_state(spark, d):
    return states(spark, d).select("path", "state")


@query(f"""SELECT project, path, state FROM {STATES} WHERE state IN ('pending', 'unexplained', 'retrying') AND session_id IS NOT NULL AND project <> 'p2'
  AND path NOT IN (SELECT path FROM v_messages WHERE contains(text, 'tion'))""")
def e14_backfill_candidates(spark, d):
    m = V.messages(spark, d)
    return T.backfill_candidates(states(spark, d), m.filter(F.contains("text", F.lit("tion"))).select("path").distinct(), m.filter("project = 'p2'").select("project").distinct())


@query("""SELECT task_id, seq, CASE WHEN seq % 17 = 0 THEN 'deferred' WHEN remaining = 0 THEN 'done' WHEN turns >= 3 AND NOT passed THEN 'backend-down'
  WHEN remaining >= lag(remaining) OVER (PARTITION BY task_id ORDER BY seq) THEN 'no-progress' ELSE 'continue' END AS verdict FROM (
  SELECT task_id, id AS seq, turns, passed, (id // 3) % 10 AS remaining FROM v_attempts)""")
def g19_batch_verdict(spark, d):
    runs = V.attempts(spark, d).select("task_id", F.col("id").alias("seq"), (F.col("id") % 17 == 0).alias("deferred"), F.col("turns").alias("attempted"),
                                       F.col("passed").cast("int").alias("succeeded"), (F.floor(F.col("id") / 3) % 10).alias("remaining"))
    return T.batch_verdict(runs, "task_id")


@query("""SELECT DISTINCT task_id FROM (SELECT t AS task_id, CASE WHEN t % 9 > 0 THEN unnest(generate_series(1, t % 3 + 1)) END AS i FROM (SELECT conv_id AS t FROM conversations GROUP BY 1)) r
  WHERE i IS NULL OR NOT EXISTS (SELECT 1 FROM v_exchanges e WHERE e.archive_path = '/archive/p' || (task_id % 7) || '/' || task_id || '.jsonl' AND greatest(line_start, i * 2) <= least(line_end, i * 2 + 1))""")
def e11_stale_tasks(spark, d):
    t = F.col("task_id")
    ref = lambda i: F.struct(F.concat(F.lit("/archive/p"), t % 7, F.lit("/"), t, F.lit(".jsonl")).alias("path"), (i * 2).alias("line_start"), (i * 2 + 1).alias("line_end"))
    refs = F.when(t % 9 > 0, F.transform(F.sequence(F.lit(1).cast("long"), t % 3 + 1), ref))
    return T.stale_tasks(V.table(spark, d, "conversations").select(F.col("conv_id").alias("task_id")).distinct().withColumn("refs", refs), V.exchanges(spark, d))


@query("""SELECT o_orderkey AS group_id, o_orderkey % 4 > 0 AND o_orderkey % 4 + o_custkey * 10 - 1 <= (SELECT max(event_id) FROM events) AND o_custkey * 10 >= (SELECT min(event_id) FROM events) AS found FROM orders""")
def e15_attempts_exist(spark, d):
    first = F.col("o_custkey") * 10
    ids = F.when(F.col("o_orderkey") % 4 > 0, F.sequence(first, first + F.col("o_orderkey") % 4 - 1))
    return T.attempts_exist(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("group_id"), ids.alias("ids")), V.attempts(spark, d))


@query(r"""SELECT doc_id, CASE WHEN line <> '' THEN CASE WHEN length(line) > 500 THEN substr(line, 1, 497) || '...' ELSE line END END AS note FROM (
  SELECT doc_id, trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')) AS line FROM documents)""")
def d10_normalize_handoff(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.normalize_handoff(F.col("text")).alias("note"))
