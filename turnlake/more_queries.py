"""Registered queries over rates, checks, times and texts in their further forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.functions import text as T
from turnlake.learning_queries import _redacted
from turnlake.operators import archive as A
from turnlake.operators import assemble as M
from turnlake.operators import review as R
from turnlake.operators import screens
from turnlake.operators import search as S
from turnlake.operators.learning import redact_secrets
from turnlake.plans import adapters as V
from turnlake.queries import NEWEST, query


def priced(spark, d):
    return V.attempts(spark, d).withColumn("usd", F.col("turns") * F.lit(0.25))


@query("""SELECT run_id, snapshot_id, kind, tier, count(*) FILTER (WHERE passed) AS passed, count(*) AS total, round(coalesce(avg(turns), 0), 6) AS mean_turns, round(coalesce(sum(turns * 0.25::DOUBLE), 0), 6) AS usd
  FROM (SELECT task_id, run_id, snapshot_id, arg_max(passed, id) AS passed, arg_max(turns, id) AS turns FROM v_attempts GROUP BY 1, 2, 3) JOIN v_tasks USING (task_id)
  WHERE task_id % 7 <> 3 AND task_id % 2 = 1 AND kind IN ('locate', 'when', 'multi') AND tier IN (2, 3) GROUP BY GROUPING SETS ((run_id, snapshot_id), (run_id, snapshot_id, kind, tier))""")
def g6_signal_pass_rate(spark, d):
    tasks = V.tasks(spark, d).withColumns({"status": F.when(F.col("task_id") % 7 == 3, "stale").otherwise("ok"), "split": F.when(F.col("task_id") % 2 == 1, "test").otherwise("train")})
    return A.pass_rate(tasks, priced(spark, d), split="test", signal_only=True)


@query("""SELECT task_id, snapshot_id FROM (SELECT task_id, snapshot_id, arg_max(passed, id) AS ok FROM v_attempts GROUP BY 1, 2) WHERE NOT ok""")
def w3_failing_across_runs(spark, d):
    return A.failing_tasks(V.attempts(spark, d), across_runs=True)


@query("""SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS tasks FROM (SELECT task_id, arg_max(passed, id) AS ok FROM v_attempts WHERE run_id IN (0, 2) AND task_id % 3 > 0 GROUP BY 1)""")
def w3_post_leaf_passed(spark, d):
    a = V.attempts(spark, d)
    own = a.filter("task_id % 3 > 0 AND run_id IN (0, 2)").select("task_id").distinct()
    return A.post_leaf_passed(a, a.filter("run_id IN (0, 2)").select("run_id"), own).crossJoin(own.agg(F.count(F.lit(1)).alias("tasks")))


@query("""SELECT id, kind, CASE WHEN shared = 1 THEN '*' ELSE project END AS project, slug, CASE kind WHEN 'instruction' THEN 0 ELSE 1 END AS kind_order, shared, row_number() OVER (ORDER BY shared, kind = 'skill', slug, id) AS place
  FROM (SELECT *, (id % 4 = 0)::INT AS shared FROM v_entries WHERE status = 'active' AND id % 11 <> 3 AND kind IN ('skill', 'instruction')) WHERE shared = 1 OR project = 'Brand#12'""")
def e9_project_entries(spark, d):
    e = V.entries(spark, d).withColumns({"project": F.when(F.col("id") % 4 == 0, "*").otherwise(F.col("project")), "superseded_by": F.when(F.col("id") % 11 == 3, F.col("id"))})
    from turnlake.operators.ranking import ranked

    own = A.list_active(e, ["skill", "instruction"], "Brand#12").withColumn("one", F.lit(1))
    return ranked(own, ["one"], ["shared", "kind_order", "project", "slug", "id"]).select("id", "kind", "project", "slug", "kind_order", "shared", F.col("rank").alias("place"))


@query("""WITH v_m AS (SELECT path, max(line_no) AS mtime, path LIKE '%3.jsonl' AS bad FROM v_messages GROUP BY 1), v_x AS (SELECT archive_path AS path, max(line_end) AS last FROM v_exchanges GROUP BY 1)
SELECT path, CASE WHEN bad THEN 'corrupted' WHEN path LIKE '%5.jsonl' THEN 'missing' ELSE 'outdated' END AS issue FROM v_m LEFT JOIN v_x USING (path) WHERE bad OR path LIKE '%5.jsonl' OR mtime > coalesce(last, 0)""")
def e1_corrupted_files(spark, d):
    files = V.messages(spark, d).groupBy("path").agg(F.max("line_no").alias("mtime"))
    ex = V.exchanges(spark, d).select(F.col("archive_path").alias("path"), F.col("line_end").alias("last_indexed"))
    return R.verify_index(files, ex, files.filter("path NOT LIKE '%5.jsonl'"), files.limit(0), files.filter("path LIKE '%3.jsonl'"))


@query(f"""WITH v_b AS (SELECT DISTINCT run_id, task_id FROM ({NEWEST}) WHERE passed AND snapshot_id = 0),
v_t AS (SELECT run_id, task_id, arg_max(CASE WHEN id % 5 > 0 THEN passed END, id) FILTER (true) AS p, max(id) AS last, sum(turns) AS turns, count(turns) AS n, sum(turns * 0.25::DOUBLE) AS usd FROM v_attempts WHERE snapshot_id = 1 GROUP BY 1, 2),
v_k AS (SELECT t.*, CASE WHEN last % 5 > 0 THEN a.passed END AS ok, b.task_id IS NOT NULL AS was FROM v_t t JOIN v_attempts a ON a.id = last LEFT JOIN v_b b ON b.run_id = t.run_id AND b.task_id = t.task_id)
SELECT run_id, count(*) AS sample, count(*) FILTER (was) AS passed_before, count(*) FILTER (ok) AS passed_after, count(*) FILTER (was AND NOT coalesce(ok, false)) AS regressions, count(ok) AS graded_after,
  round(sum(turns) / sum(n), 6) AS mean_turns_after, round(sum(usd), 6) AS usd_after FROM v_k GROUP BY 1""")
def g11_merge_evidence(spark, d):
    a = priced(spark, d)
    before = A.newest_attempt(a.filter("snapshot_id = 0")).filter("passed").select("run_id", "task_id")
    # a null that is the last attempt's must stay the last: max_by passes over no null
    after = a.filter("snapshot_id = 1").withColumn("passed", F.when(F.col("id") % 5 > 0, F.col("passed")))
    return R.merge_evidence(before, after)


@query("""SELECT project, leaf, CAST(sum(n) AS BIGINT) AS n FROM (SELECT project, n, CASE WHEN sum(n) OVER (PARTITION BY project) > 900 THEN category END AS leaf FROM (
  SELECT project, 'c' || (task_id % 3) AS category, count(*) AS n FROM v_attempts JOIN v_tasks USING (task_id) WHERE NOT passed GROUP BY 1, 2)) GROUP BY 1, 2
  UNION ALL SELECT 'broken ' || project, NULL, count(*) FROM v_attempts JOIN v_tasks USING (task_id) WHERE NOT passed GROUP BY 1""")
def g13_assigned_failures(spark, d):
    """By an assignment that is a partition, and by one that names a task twice."""
    failed = V.attempts(spark, d).filter("NOT passed").join(V.tasks(spark, d), "task_id")
    assigned = failed.select("task_id").distinct().withColumn("category", F.concat(F.lit("c"), F.col("task_id") % 3))
    good, broken = R.split_failures(failed, 900, assigned), R.split_failures(failed, 900, assigned.unionByName(assigned.limit(1)))
    return good.unionByName(broken.withColumn("project", F.concat(F.lit("broken "), "project")))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') ELSE 'no time at' END AS day FROM events""")
def x5_day_of(spark, d):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(t, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(t, F.lit("+05:00"))).otherwise("no time at all")
    return V.table(spark, d, "events").select("event_id", T.day_of(said).alias("day"))


TIMES = "lpad((1900 + l_partkey % 200)::VARCHAR, 4, '0') || CASE l_orderkey % 3 WHEN 0 THEN '' ELSE '-' || lpad((l_suppkey % 14)::VARCHAR, 2, '0') END || CASE l_orderkey % 3 WHEN 2 THEN '-' || lpad((l_partkey % 33)::VARCHAR, 2, '0') ELSE '' END"


@query(f"""SELECT t, n, v, CASE WHEN v THEN b >= '1950-02-01' AND a <= '1999-12-31' END AS met FROM (SELECT t, count(*) AS n, any_value(CASE length(t) WHEN 4 THEN true WHEN 7 THEN substr(t, 6) BETWEEN '01' AND '12' ELSE try_cast(t AS DATE) IS NOT NULL END) AS v,
  any_value(CASE length(t) WHEN 4 THEN t || '-01-01' WHEN 7 THEN t || '-01' ELSE t END) AS a, any_value(CASE length(t) WHEN 4 THEN t || '-12-31' WHEN 7 THEN t || '-31' ELSE t END) AS b FROM (SELECT {TIMES} AS t FROM lineitem) GROUP BY t)""")
def x6_valid_times(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = F.col("l_orderkey") % 3
    time = F.concat((1900 + F.col("l_partkey") % 200).cast("string"), F.when(k > 0, F.concat(F.lit("-"), two(F.col("l_suppkey") % 14))).otherwise(""), F.when(k == 2, F.concat(F.lit("-"), two(F.col("l_partkey") % 33))).otherwise(""))
    times = V.table(spark, d, "lineitem").groupBy(time.alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn("v", T.is_valid_time(F.col("t")))
    return times.withColumn("met", F.when(F.col("v"), T.overlaps(F.col("t"), F.lit("1950-02"), F.lit("1999"))))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')), lambda w: NOT list_contains({T.STOP_WORDS}, w))), ' ') AS tokens FROM documents""")
def x7_without_stop_words(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.content_tokens(F.col("text"), T.STOP_WORDS)), " ").alias("tokens"))


@query("""SELECT p_partkey, substr(regexp_replace(regexp_replace(lower('fifi ' || p_name || '! ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM part""")
def x19_reflection_slug(spark, d):
    """Ligatures and full-width letters before the names become plain ones."""
    return V.table(spark, d, "part").select("p_partkey", screens.reflection_slug(F.concat(F.lit("ﬁＦＩ "), "p_name", F.lit("! "), "p_type")).alias("slug"))


@query(f"""SELECT id, substr('User: ' || cut(u) || chr(10) || chr(10) || 'Assistant: ' || cut(a) || CASE WHEN line_start % 2 = 0 THEN chr(10) || chr(10) || 'Tools: Read, Write' ELSE '' END, 1, 900) AS text
  FROM (SELECT id, line_start, {_redacted('user_message')} AS u, {_redacted('assistant_message')} AS a FROM v_exchanges)""".replace("cut(u)", "CASE WHEN length(u) > 300 THEN substr(u, 1, 300) || chr(10) || '[... cut for the index; whole length ' || length(u) || ']' ELSE u END").replace(
    "cut(a)", "CASE WHEN length(a) > 300 THEN substr(a, 1, 300) || chr(10) || '[... cut for the index; whole length ' || length(a) || ']' ELSE a END"))
def a9_embedding_text_with_tools(spark, d):
    tools = F.when(F.col("line_start") % 2 == 0, F.array(F.lit("Read"), F.lit("Write"))).otherwise(F.array().cast("array<string>"))
    return V.exchanges(spark, d).select("id", M.embedding_text(F.col("user_message"), F.col("assistant_message"), 900, tools, 300, redact_secrets).alias("text"))


@query("""SELECT v.id, query_id, round(list_distance(embedding, query), 6) AS distance FROM v_vectors v JOIN v_queries q ON v.project = 'p' || (q.query_id % 7) AND v.archive_path = '/archive/' || (q.query_id // 5)""")
def u1_sql_distance(spark, d):
    """The SQL function over the vectors of each query's own archive path."""
    S.register_functions(spark)
    V.vectors(spark, d).createOrReplaceTempView("u1_vectors")
    V.vector_queries(spark, d).createOrReplaceTempView("u1_queries")
    return spark.sql("""SELECT v.id, query_id, round(vec_distance_l2(embedding, query), 6) AS distance FROM u1_vectors v JOIN u1_queries q
      ON v.project = concat('p', q.query_id % 7) AND v.archive_path = concat('/archive/', q.query_id div 5)""")
