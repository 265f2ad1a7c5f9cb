"""Registered queries over the learning operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnlake.operators import learning as L
from turnlake.plans import adapters as V
from turnlake.queries import query

#: The shapes of secrets as the SQL has them, written out apart from the operator's.
SHAPES = r"""
\bgh[pousr]_[A-Za-z0-9_]{20,}\b
\bgithub_pat_[A-Za-z0-9_]{20,}\b
\bsk-[A-Za-z0-9_-]{20,}\b
\bsk-ant-[A-Za-z0-9_-]{20,}\b
\bnpm_[A-Za-z0-9]{20,}\b
\b(AKIA|ASIA)[A-Z0-9]{16}\b
\bxox[baprs]-[A-Za-z0-9-]{10,}\b
\bAIza[0-9A-Za-z_-]{20,}\b
\b(sk|rk|pk)_(live|test)_[A-Za-z0-9]{16,}\b
\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b
(?i)\bBearer[ \t]+[A-Za-z0-9\-._~+/]+=*
""".split("\n")[1:-1]


def _redacted(col):
    for shape in SHAPES:
        col = f"regexp_replace({col}, '{shape}', '[redacted]', 'g')"
    return col


@query(f"SELECT doc_id, md5({_redacted('text')}) AS redacted FROM documents")
def x1_redact_secrets(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(L.redact_secrets(F.col("text"))).alias("redacted"))


@query(f"SELECT id, '[#' || id || ',@' || line_start || '] ' || {_redacted('user_message')} || ' #' || id || ' [redacted]' AS text FROM v_exchanges")
def x3_redact_keeping_marks(spark, d):
    secret = "npm_" + "a" * 24
    text = F.concat(F.lit("[#"), "id", F.lit(",@"), "line_start", F.lit("] "), "user_message", F.lit(" #"), "id", F.lit(f" {secret}"))
    return V.exchanges(spark, d).select("id", L.redact_keeping_marks(text).alias("text"))


@query("""SELECT event_id, user_id % 5 = event_id % 5 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-01' + CAST(user_id % 9 AS INTEGER) - 1 AND DATE '2024-01-01' + CAST(user_id % 9 AS INTEGER) + 3 AS passed FROM events""")
def x13_grade_when(spark, d):
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 9).cast("int"))
    return V.table(spark, d, "events").select("event_id", L.grade_when(F.col("user_id") % 5, F.col("event_id") % 5, F.to_date("ts"), first, F.date_add(first, 2)).alias("passed"))


@query("""SELECT task_id, bool_and(hit) AS passed, avg(CAST(hit AS DOUBLE)) AS score FROM (SELECT session_id AS task_id, id, project = 'p2' OR EXISTS (SELECT 1 FROM v_exchanges o
  WHERE o.archive_path = e.archive_path AND o.line_start % 4 = 1 AND o.line_start + 1 BETWEEN e.line_start AND e.line_end) AS hit FROM v_exchanges e) GROUP BY 1""")
def x14_grade_multi(spark, d):
    ex = V.exchanges(spark, d).withColumnRenamed("session_id", "task_id")
    near = ex.filter("line_start % 4 = 1").select("task_id", F.col("archive_path").alias("path"), (F.col("line_start") + 1).alias("line"))
    whole = ex.filter("project = 'p2'").select("task_id", F.col("archive_path").alias("path"), F.lit(None).cast("int").alias("line")).distinct()
    return L.grade_multi(ex.select("task_id", F.col("archive_path").alias("path"), "line_start", "line_end"), near.unionByName(whole))


@query("""SELECT event_id, coalesce(s, 0) AS score, coalesce(s, 0) >= 0.7 AS passed FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN CASE event_id % 3 WHEN 0 THEN (event_id % 100) / 100.0 WHEN 1 THEN 0.5 END END AS s FROM events)""")
def x15_grade_recall(spark, d):
    n = F.col("event_id")
    reply = F.when(n % 3 == 0, F.concat(F.lit("it is <score> 0."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("</score>"))).when(n % 3 == 1, "about 0.5 or so").otherwise("none at all")
    g = L.grade_recall(F.col("user_id") % 2 == 0, reply)
    return V.table(spark, d, "events").select("event_id", g["score"].alias("score"), g["passed"].alias("passed"))


@query(r"""SELECT id, regexp_matches(p, '(?i)\.jsonl\b') OR regexp_matches(p, '(?:^|\s)(?:/|\\|[A-Za-z]:[\\/])\S+') OR (length(session_id) >= 3 AND contains(p, session_id)) OR regexp_matches(p, '\bsession[-_][A-Za-z0-9]')
  AS leaks FROM (SELECT *, user_message || CASE line_start % 4 WHEN 0 THEN ' in session-4' WHEN 1 THEN ' at /tmp/x' WHEN 2 THEN ' by ' || session_id ELSE '' END AS p FROM v_exchanges)""")
def x16_leaks_answer_key(spark, d):
    n = F.col("line_start") % 4
    more = F.when(n == 0, " in session-4").when(n == 1, " at /tmp/x").when(n == 2, F.concat(F.lit(" by "), "session_id")).otherwise("")
    return V.exchanges(spark, d).select("id", L.leaks_answer_key(F.concat("user_message", more), F.col("session_id"), F.col("archive_path")).alias("leaks"))


@query("""SELECT context_id, failure_id, score FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, failure_id) AS place FROM (
  SELECT context_id, p_partkey AS failure_id, sum(3 * CAST(contains(lower(p_name), w) AS INTEGER) + 2 * CAST(contains(lower(p_type), w) AS INTEGER) + CAST(contains(lower(p_brand), w) AS INTEGER)) AS score
  FROM (SELECT DISTINCT p_name AS context_id, unnest(string_split(p_name || ' eco', ' ')) AS w FROM part), part WHERE p_partkey % 2 = 1 AND length(w) > 1 GROUP BY 1, 2) WHERE score > 0) WHERE place <= 5""")
def j15_lookup_failures(spark, d):
    p = V.table(spark, d, "part")
    contexts = p.select("p_name").distinct().select(F.col("p_name").alias("context_id"), F.concat("p_name", F.lit(" eco")).alias("text"))
    status = F.when(F.col("p_partkey") % 2 == 0, "resolved").otherwise("open")
    return L.lookup_failures(contexts, p.select(F.col("p_partkey").alias("failure_id"), status.alias("status"), F.col("p_name").alias("hint"), F.col("p_type").alias("context"), F.col("p_brand").alias("attempted")))


@query(r"""WITH v_h AS (SELECT id, user_message AS c, CASE WHEN line_start % 4 = 1 THEN 'never ' ELSE '' END || 'run ' || project AS action FROM v_exchanges
  UNION ALL SELECT id || 'x', 'again ' || user_message, CASE WHEN line_end % 3 = 0 THEN 'walk ' ELSE 'never run ' END || project FROM v_exchanges),
v_k AS (SELECT id, action, list_distinct(list_filter(regexp_split_to_array(lower(c), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS k FROM v_h)
SELECT a, b, CASE WHEN starts_with(x, 'never ') AND y = substr(x, 7) OR starts_with(y, 'never ') AND x = substr(y, 7) THEN 'contradiction' ELSE 'overlap' END AS kind, n / greatest(s, t) AS overlap FROM (
  SELECT l.id AS a, r.id AS b, l.action AS x, r.action AS y, len(list_intersect(l.k, r.k)) AS n, len(l.k) AS s, len(r.k) AS t FROM v_k l JOIN v_k r ON l.id < r.id AND l.action <> r.action) WHERE n > 0 AND n / greatest(s, t) >= 0.5""")
def j16_heuristic_conflicts(spark, d):
    run = F.concat(F.lit("run "), "project")
    own = V.exchanges(spark, d).select("id", F.col("user_message").alias("condition"), F.concat(F.when(F.col("line_start") % 4 == 1, "Never  ").otherwise(""), run).alias("action"), "line_end", "project")
    more = own.select(F.concat("id", F.lit("x")).alias("id"), F.concat(F.lit("again "), "condition").alias("condition"), F.concat(F.when(F.col("line_end") % 3 == 0, "walk ").otherwise("Never  run "), "project").alias("action"))
    return L.heuristic_conflicts(own.select("id", "condition", "action").unionByName(more))


@query("""SELECT entry_id, line, condition, action, priority, confidence FROM (SELECT id AS entry_id, project AS condition, CASE version % 2 WHEN 0 THEN 8 ELSE 3 END AS priority, CASE version % 2 WHEN 0 THEN 0.8 ELSE 0.3 END AS confidence,
  unnest([0, 2]) AS line, unnest([body, slug]) AS action FROM v_entries WHERE kind = 'instruction')""")
def k4_entry_heuristics(spark, d):
    body = F.concat("body", F.lit("\n \n"), "slug")
    return L.entry_heuristics(V.entries(spark, d).withColumns({"scope": F.col("project"), "confidence": F.when(F.col("version") % 2 == 0, "high").otherwise("low"), "body": body}))


@query("""SELECT run_id, count(*) AS calls, CAST(sum(turns) AS DOUBLE) AS usd, run_id = 1 AND count(*) >= 10 OR run_id = 2 AND sum(turns) >= 1000000000 AS over FROM v_attempts GROUP BY 1""")
def k5_run_budget(spark, d):
    a = V.attempts(spark, d).withColumn("usd", F.col("turns").cast("double"))
    limits = F.when(F.col("run_id") == 1, '{"calls": 10}').when(F.col("run_id") == 2, '{"usd": 1000000000}').otherwise("{}")
    return L.run_budget(a, a.select("run_id").distinct().withColumn("limits", limits))


@query("""WITH v_use AS (SELECT *, turns * 0.25::DOUBLE AS usd FROM v_attempts WHERE id % 7 > 0 OR snapshot_id = 0),
v_new AS (SELECT task_id, run_id, snapshot_id, arg_max(passed, id) AS passed, arg_max(turns, id) AS turns, arg_max(usd, id) AS usd FROM v_use WHERE passed IS NOT NULL GROUP BY 1, 2, 3),
v_ends AS (SELECT run_id, min(snapshot_id) AS f, max(snapshot_id) AS l, count(*) AS calls, sum(usd) AS used_usd FROM v_use GROUP BY 1),
v_cell AS (SELECT run_id, CASE task_id % 2 WHEN 0 THEN 'train' ELSE 'test' END AS split, snapshot_id, kind, tier, count(*) FILTER (passed) AS p, count(*) AS t, coalesce(avg(turns), 0) AS m, coalesce(sum(usd), 0) AS u
  FROM v_new JOIN v_tasks USING (task_id) WHERE task_id % 5 > 0 GROUP BY GROUPING SETS ((1, 2, 3), (1, 2, 3, 4, 5)))
SELECT run_id, split, kind, tier, coalesce(max(p) FILTER (snapshot_id = f), 0) AS passed_first, coalesce(max(t) FILTER (snapshot_id = f), 0) AS total_first, round(coalesce(max(m) FILTER (snapshot_id = f), 0), 6) AS mean_turns_first, coalesce(max(u) FILTER (snapshot_id = f), 0) AS usd_first,
  coalesce(max(p) FILTER (snapshot_id = l), 0) AS passed_last, coalesce(max(t) FILTER (snapshot_id = l), 0) AS total_last, round(coalesce(max(m) FILTER (snapshot_id = l), 0), 6) AS mean_turns_last, coalesce(max(u) FILTER (snapshot_id = l), 0) AS usd_last,
  max(calls) AS calls, max(used_usd) AS used_usd FROM v_cell JOIN v_ends USING (run_id) GROUP BY 1, 2, 3, 4""")
def g7_run_report(spark, d):
    status = F.when(F.col("task_id") % 5 > 0, "ok").otherwise("bad")
    tasks = V.tasks(spark, d).withColumn("status", status).withColumn("split", F.when(F.col("task_id") % 2 == 0, "train").otherwise("test"))
    used = V.attempts(spark, d).filter("id % 7 > 0 OR snapshot_id = 0").withColumn("usd", F.col("turns") * 0.25)
    out = L.run_report(tasks, used)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("mean") else c for c in out.columns])


@query("""SELECT *, gained >= 1 AND regressions = 0 AS keep FROM (SELECT task_id AS candidate, count(*) FILTER (id % 4 > 0 AND passed AND turns % 2 = 1) AS gained, count(*) FILTER (id % 4 = 0 AND turns % 2 = 0 AND NOT passed) AS regressions,
  count(*) FILTER (turns % 2 = 0) AS passed_before, count(*) FILTER (passed) AS passed_after, count(passed) AS graded_after, avg(turns) AS mean_turns FROM v_attempts GROUP BY 1)""")
def g10_validation_verdict(spark, d):
    return L.validation_verdict(V.attempts(spark, d).select(
        F.col("task_id").alias("candidate"), F.when(F.col("id") % 4 == 0, "sample").otherwise("targeted").alias("role"), (F.col("turns") % 2 == 0).alias("before"), F.col("passed").alias("after"), "turns"))


@query("""SELECT path, id, arg_min(output, i) AS output FROM (SELECT c.path, c.path || ':' || c.line_no AS id, 'r' || r.line_no AS output, r.i FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS i FROM v_messages) c
  JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS i FROM v_messages) r ON r.path = c.path AND r.line_no - c.line_no IN (3, 4, 7) AND r.i BETWEEN c.i + 1 AND c.i + 5 WHERE c.role = 'assistant') GROUP BY 1, 2""")
def w8_tool_result_lookahead(spark, d):
    m = V.messages(spark, d)
    name = lambda back: F.concat("path", F.lit(":"), F.col("line_no") - back)
    calls = m.filter("role = 'assistant'").select("path", "line_no", name(0).alias("id"))
    results = m.select("path", "line_no", F.explode(F.array(*[name(b) for b in (3, 4, 7)])).alias("id"), F.concat(F.lit("r"), "line_no").alias("output"))
    return L.tool_result_lookahead(m, calls, results)


@query("""SELECT path, tier FROM (SELECT *, CASE WHEN n = 0 THEN 0 WHEN t IS NULL THEN 1 WHEN t = '' THEN 2 END AS tier FROM (SELECT path, max(line_no) % 3 AS n, CASE max(line_no) % 2 WHEN 0 THEN '' END AS t,
  path LIKE '%9.jsonl' AS g FROM v_messages GROUP BY 1)) WHERE NOT g AND tier IS NOT NULL ORDER BY tier, n, path LIMIT 10""")
def w10_summary_queue(spark, d):
    s = V.messages(spark, d).groupBy("path").agg(F.max("line_no").alias("n"))
    return L.summary_queue(s.select("path", (F.col("n") % 3).alias("attempts"), F.when(F.col("n") % 2 == 0, "").alias("text"), F.col("path").like("%9.jsonl").alias("gave_up")))


@query("""SELECT session_id AS "group", line_start AS line, 'x [1] y [' || (1 + row_number() OVER (PARTITION BY session_id ORDER BY line_start)) || '] z' AS text FROM v_exchanges""")
def w6_renumber_marks(spark, d):
    text = F.concat(F.lit("x [#"), F.md5("project"), F.lit("] y [#"), "id", F.lit("] z"))
    return L.renumber_marks(V.exchanges(spark, d).select(F.col("session_id").alias("group"), F.col("line_start").alias("line"), text.alias("text")))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 3 ELSE 0 END AS embedding_version FROM v_vectors")
def e4_mark_all_stale(spark, d):
    v = V.vectors(spark, d).select("id", F.lit(3).alias("embedding_version"))
    return L.mark_all_stale(v, F.when(F.col("id") % 2 == 0, "m2").when(F.col("id") % 3 == 0, "m1"), "m2")


@query("SELECT id, len(embedding) AS n, CASE WHEN id % 3 = 0 THEN -embedding[1] ELSE embedding[1] END AS first FROM v_vectors")
def e5_apply_reembedded(spark, d):
    v = V.vectors(spark, d)
    return L.apply_reembedded(v, v.filter("id % 3 = 0").select("id", F.transform("embedding", lambda x: -x).alias("embedding"))).select("id", F.size("embedding").cast("long").alias("n"), F.get("embedding", F.lit(0)).alias("first"))


@query("SELECT min(id) AS id FROM v_entries GROUP BY project, slug, body")
def e6_dedup_reflections(spark, d):
    e = V.entries(spark, d).select("id", F.col("slug").alias("scope"), "project", F.array(F.lit("b"), F.lit("a")).alias("evidence"), F.col("body").alias("summary"))
    return L.dedup_reflections(e).select("id")


@query("""SELECT CAST(NULL AS BIGINT) AS candidate, id, 1 AS sign FROM v_entries WHERE status = 'active' UNION ALL SELECT id, id, 1 FROM v_entries WHERE status = 'candidate' AND id % 10 = 1
  UNION ALL SELECT c.id, e.id, -1 FROM v_entries c JOIN v_entries e ON c.kind = e.kind AND c.project = e.project AND c.slug = e.slug AND e.status = 'active' AND e.id <> c.id WHERE c.status = 'candidate' AND c.id % 10 = 1""")
def e12_evaluation_snapshot(spark, d):
    e = V.entries(spark, d)
    return L.evaluation_snapshot(e, e.filter("status = 'candidate' AND id % 10 = 1"), ["kind", "project", "slug"])


@query("""WITH v_one AS (SELECT * FROM v_entries WHERE id = (SELECT min(id) FROM v_entries WHERE status = 'candidate'))
SELECT id FROM v_one UNION ALL SELECT id FROM v_entries e WHERE status = 'active' AND id % 4 > 0 AND NOT EXISTS (SELECT 1 FROM v_one o WHERE o.kind = e.kind AND o.project = e.project AND o.slug = e.slug)""")
def e12_snapshot_ids(spark, d):
    e = V.entries(spark, d).withColumn("superseded_by", F.when(F.col("id") % 4 == 0, F.col("id") + 1))
    return L.snapshot_ids(e, e.filter("status = 'candidate'").agg(F.min("id")).first()[0], ["kind", "project", "slug"])


@query("""SELECT q.id, CASE WHEN project = 'p3' THEN 'hidden' WHEN e.id IS NULL THEN 'missing' ELSE 'found' END AS status, CASE WHEN project <> 'p3' THEN archive_path END AS archive_path, CASE WHEN project <> 'p3' THEN line_start END AS line_start
  FROM (SELECT CASE WHEN line_start % 4 = 1 THEN md5(id) ELSE id END AS id FROM v_exchanges) q LEFT JOIN v_exchanges e USING (id)""")
def j9_expand_citation(spark, d):
    ex = V.exchanges(spark, d)
    ids = ex.select(F.when(F.col("line_start") % 4 == 1, F.md5("id")).otherwise(F.col("id")).alias("id"))
    return L.expand_citation(ids, ex, ex.filter("project = 'p3'").select("id")).select("id", "status", "archive_path", "line_start")


LINKS = "(SELECT l_orderkey % 50 AS a, l_partkey % 60 AS b, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2 HAVING b < 55 AND a > 4 AND b > 4)"


@query(f"SELECT a AS unit_id, 'out' AS direction, b AS other_id, seq FROM {LINKS} UNION ALL SELECT b, 'back', a, seq FROM {LINKS}")
def j12_topic_links(spark, d):
    li = V.table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("source"), (F.col("l_partkey") % 60).alias("target"), F.col("l_linenumber").alias("seq"))
    units = V.table(spark, d, "part").select((F.col("p_partkey") % 55).alias("unit_id")).distinct().filter("unit_id > 4")
    return L.topic_links(units, li)


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 7 WHEN id % 6 = 1 THEN -id END AS superseded_by FROM v_entries")
def d5_apply_compression(spark, d):
    e = V.entries(spark, d).select("id", F.when(F.col("id") % 4 == 0, F.lit(7).cast("bigint")).alias("superseded_by"))
    return L.apply_compression(e, e.filter("id % 6 = 1 OR id % 4 = 0").select("id", (-F.col("id")).alias("merged_into")))


@query("SELECT session_id, id, row_number() OVER (PARTITION BY project ORDER BY line_start = 1 DESC, ts_raw DESC, id DESC) AS place FROM v_exchanges")
def q6_digest_order(spark, d):
    e = V.exchanges(spark, d).withColumns({"handoff": F.col("line_start") == 1, "period_end": F.col("ts_raw")})
    return e.select("session_id", "id", F.row_number().over(Window.partitionBy("project").orderBy(*L.digest_order())).alias("place"))


@query("SELECT n_name AS slug, lower(n_name) AS title, count(c_custkey) AS n_units FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 9 = 0 GROUP BY 1, 2")
def t7_list_topics(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_name").alias("slug"), F.lower("n_name").alias("title"), "n_nationkey")
    units = V.table(spark, d, "customer").filter("c_custkey % 9 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("slug")
    return L.list_topics(n, units)


@query("SELECT id FROM (SELECT DISTINCT task_id AS id FROM v_tasks) ORDER BY md5('s:' || id), id LIMIT 20")
def q5_sample_ids(spark, d):
    return L.sample_ids(V.tasks(spark, d).select(F.col("task_id").alias("id")), 20, "s")
