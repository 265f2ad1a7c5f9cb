"""Registered queries over the archive operators, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import text as T
from turnlake.operators import archive as A
from turnlake.operators import assemble as M
from turnlake.operators import search as S
from turnlake.plans import adapters as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def joined(sql: str) -> str:
    """The adapter views, and those of a query's own behind them."""
    return f"WITH {V.SQL.strip()}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {V.SQL.strip()} {sql}"


def query(sql: str):
    """Registers a query by its function's name, with its SQL over the adapter views."""

    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"{joined(sql.strip())}"
        return f

    return keep


@query("SELECT * FROM v_exchanges")
def a1_exchanges(spark, d):
    return V.exchanges(spark, d)


@query("""SELECT id, CASE WHEN length(user_message) > 100 THEN substr(user_message, 1, 100) || chr(10) || '[... cut for the index; whole length '
  || length(user_message) || ']' ELSE user_message END AS cut FROM v_exchanges""")
def a8_truncate_for_index(spark, d):
    return V.exchanges(spark, d).select("id", M.truncate_for_index(F.col("user_message"), 100).alias("cut"))


@query("""SELECT id, substr('User: ' || user_message || chr(10) || chr(10) || 'Assistant: ' || assistant_message, 1, 2000) AS text FROM v_exchanges""")
def a9_embedding_text(spark, d):
    return V.exchanges(spark, d).select("id", M.embedding_text(F.col("user_message"), F.col("assistant_message")).alias("text"))


@query("""SELECT e.id FROM v_exchanges e LEFT JOIN (SELECT archive_path, max(line_end) AS mark FROM v_exchanges WHERE line_start <= 2 GROUP BY 1) m
  USING (archive_path) WHERE mark IS NULL OR line_start > mark""")
def a11_filter_incremental(spark, d):
    ex = V.exchanges(spark, d)
    return M.filter_incremental(ex, ex.filter("line_start <= 2")).select("id")


@query("""SELECT archive_path, CAST(floor((rn - 1) / size) AS BIGINT) AS chunk, string_agg('User: ' || user_message || chr(10) || chr(10) || 'Agent: ' || assistant_message,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY line_start) AS text
  FROM (SELECT *, CASE WHEN n > 2 THEN greatest(2, ceil(n / 20.0)) ELSE n END AS size FROM (SELECT *, row_number() OVER (PARTITION BY archive_path ORDER BY line_start) AS rn,
  count(*) OVER (PARTITION BY archive_path) AS n FROM v_exchanges)) GROUP BY 1, 2""")
def a12_conversation_chunks(spark, d):
    return M.conversation_chunks(V.exchanges(spark, d), whole=2, least=2)


@query("""SELECT archive_path, line_start FROM (SELECT archive_path, line_start, CASE WHEN line_end % 3 = 0 THEN ' /exit ' ELSE user_message END AS u, assistant_message AS a, line_start % 4 = 1 AS twice FROM v_exchanges)
  WHERE NOT twice AND (trim(u) = '/exit' OR length(u) + length(a) < 100)""")
def a13_trivial_sessions(spark, d):
    # each exchange is a session of its own here, some of them of two
    e = V.exchanges(spark, d).withColumn("user_message", F.when(F.col("line_end") % 3 == 0, " /exit ").otherwise(F.col("user_message")))
    return M.trivial_sessions(e.unionByName(e.filter("line_start % 4 = 1")), ["archive_path", "line_start"])


@query("""SELECT id FROM v_exchanges WHERE project = 'p3' AND ts_raw >= '2024-01-02' AND ts_raw <= '2024-01-05'""")
def f1_metadata_filter(spark, d):
    return S.metadata_filter(V.exchanges(spark, d), "2024-01-02", "2024-01-05", project="p3").select("id")


@query("SELECT id FROM v_exchanges WHERE id NOT IN (SELECT id FROM v_exchanges WHERE project = 'p1')")
def f2_exclude_ids(spark, d):
    ex = V.exchanges(spark, d)
    return S.exclude_ids(ex, ex.filter("project = 'p1'")).select("id")


@query("SELECT id FROM v_exchanges WHERE NOT coalesce(is_sidechain, false)")
def f3_main_thread(spark, d):
    return S.main_thread(V.exchanges(spark, d)).select("id")


@query("""SELECT o_orderkey, regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(x AS DATE) IS NOT NULL AS valid FROM (
  SELECT o_orderkey, '2023-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS x FROM orders)""")
def f4_valid_iso_date(spark, d):
    two = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    x = F.concat(F.lit("2023-"), two(14), F.lit("-"), two(33))
    return V.table(spark, d, "orders").select("o_orderkey", T.valid_iso_date(x).alias("valid"))


@query(r"""SELECT id, regexp_replace(regexp_replace(substr(user_message, 1, 200), '\s+', ' ', 'g'), '^ +| +$', '', 'g')
  || CASE WHEN length(user_message) > 200 THEN '...' ELSE '' END AS snippet FROM v_exchanges""")
def f5_snippet(spark, d):
    return V.exchanges(spark, d).select("id", T.snippet(F.col("user_message")).alias("snippet"))


@query(r"""SELECT doc_id, regexp_replace(source || '/' || lang || '.x y', '[^A-Za-z0-9]', '-', 'g') AS key FROM documents""")
def f9_project_key(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.project_key(F.concat("source", F.lit("/"), "lang", F.lit(".x y"))).alias("key"))


@query("SELECT line_no, path, replace(regexp_extract(path, '([^/]*)$', 1), '.jsonl', '') AS session FROM v_messages")
def s4_session_id_from_path(spark, d):
    return V.messages(spark, d).select("line_no", "path", T.session_id_from_path(F.col("path")).alias("session"))


@query("""SELECT coalesce(s.path, a.path) AS path, CASE WHEN s.path IS NULL THEN 'archived only' WHEN a.path IS NULL OR a.mtime < s.mtime THEN 'copied' ELSE 'skipped' END AS action
  FROM (SELECT path, max(line_no) AS mtime FROM v_messages WHERE project <> 'p0' GROUP BY 1) s
  FULL JOIN (SELECT path, max(line_no) - CASE WHEN path LIKE '%3.jsonl' THEN 1 ELSE 0 END AS mtime FROM v_messages WHERE project <> 'p1' GROUP BY 1) a USING (path)""")
def s5_diff_manifest(spark, d):
    m = V.messages(spark, d)
    s = m.filter("project <> 'p0'").groupBy("path").agg(F.max("line_no").alias("mtime"))
    a = m.filter("project <> 'p1'").groupBy("path").agg((F.max("line_no") - F.first(F.col("path").like("%3.jsonl").cast("int"))).alias("mtime"))
    return A.diff_manifest(s, a)


@query("""SELECT req_id, CAST(coalesce(sum(CASE WHEN line_no BETWEEN 2 AND stop THEN octet_length(encode(text)) + 1 END), 0) AS BIGINT) AS bytes,
  CASE WHEN stop < 2 THEN 'bad range' WHEN coalesce(sum(CASE WHEN line_no BETWEEN 2 AND stop THEN octet_length(encode(text)) + 1 END), 0) > 900 THEN 'too large' ELSE 'ok' END AS status
  FROM (SELECT session_id AS req_id, path, count(*) - 2 AS stop FROM v_messages GROUP BY 1, 2) r JOIN v_messages m USING (path) GROUP BY req_id, stop""")
def s7_slice_lines(spark, d):
    m = V.messages(spark, d)
    asked = m.groupBy(F.col("session_id").alias("req_id"), "path").agg(F.lit(2).alias("start"), (F.count(F.lit(1)) - 2).alias("stop"))
    return A.slice_lines(asked, m, 900)


@query("""SELECT id, project FROM v_exchanges WHERE project NOT IN ('p2') UNION ALL SELECT id, 'moved' FROM v_exchanges WHERE project = 'p2'""")
def s8_upsert(spark, d):
    ex = V.exchanges(spark, d).select("id", "project")
    own = ex.filter("project = 'p2'")
    batch = own.select("id", F.lit("lost").alias("project"), F.lit(1).alias("seq")).unionByName(own.select("id", F.lit("moved").alias("project"), F.lit(2).alias("seq")))
    return A.upsert(ex, batch)


@query("SELECT id FROM v_exchanges WHERE archive_path NOT IN (SELECT archive_path FROM v_exchanges WHERE line_end >= 6)")
def s9_delete_for_archive(spark, d):
    ex = V.exchanges(spark, d)
    return A.delete_for_archive(ex, ex.filter("line_end >= 6").select("archive_path").distinct()).select("id")


@query("""SELECT count(*) AS exchanges, coalesce(sum(length(user_message || assistant_message)), 0)::BIGINT AS chars_freed,
  coalesce(sum(octet_length(encode(user_message || assistant_message))), 0)::BIGINT AS bytes_freed FROM v_exchanges WHERE project IN ('p1', 'p4')""")
def s10_prune_counts(spark, d):
    ex = V.exchanges(spark, d)
    return A.prune_counts(ex, ex.filter("project IN ('p1', 'p4')").select("project").distinct())


@query("""SELECT query_id, id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
  SELECT query_id, v.id, list_distance(embedding, query) AS distance FROM v_vectors v, v_queries WHERE project <> 'p2')) WHERE rank <= 10""")
def j1_knn_search(spark, d):
    return S.knn_search(V.vector_queries(spark, d), V.vectors(spark, d).filter("project <> 'p2'"), 10).select("query_id", "id", "distance", "rank")


WORDS = "SELECT item_id AS query_id, text FROM benchmark"


def word_queries(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"""SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank
  FROM documents d, ({WORDS}) q WHERE len(list_filter(list_distinct(regexp_split_to_array(lower(q.text), '\\s+')), lambda w: w <> '' AND NOT contains(lower(d.text), w))) = 0) WHERE rank <= 20""")
def j3_text_search_contains(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return S.text_search_contains(word_queries(spark, d), docs, ["text"], [F.desc("doc_id")], 20).select("query_id", "doc_id", "rank")


@query("""SELECT query_id, id, pos, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) AS rank FROM (
  SELECT query_id, id, min(pos) AS pos, max(distance) AS distance FROM (
    SELECT query_id, id, 2 * rank AS pos, distance FROM (SELECT query_id, v.id, round(list_distance(embedding, query), 6) AS distance,
      row_number() OVER (PARTITION BY query_id ORDER BY list_distance(embedding, query), v.id) AS rank FROM v_vectors v, v_queries) WHERE rank <= 8
    UNION ALL SELECT query_id, id, 2 * rank + 1, NULL FROM (SELECT query_id, v.id, row_number() OVER (PARTITION BY query_id ORDER BY v.id DESC) AS rank
      FROM v_vectors v, v_queries WHERE v.id % 7 = query_id % 7) WHERE rank <= 8) GROUP BY 1, 2)) WHERE rank <= 8""")
def j4_hybrid_search(spark, d):
    q, v = V.vector_queries(spark, d), V.vectors(spark, d)
    # the newest of each class once, then those of a query's class
    newest = S.top_k(v.select("id", (F.col("id") % 7).alias("class")), ["class"], [F.desc("id")], 8)
    text = q.select("query_id", (F.col("query_id") % 7).alias("class")).join(newest, "class").drop("class")
    return S.hybrid_search(S.knn_search(q, v, 8), text, 8)


@query("""SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY average DESC, archive_path) AS rank FROM (
  SELECT query_id // 100 AS group_id, archive_path, round(avg(best), 6) AS average, max(id) FILTER (query_id = first_id) AS representative FROM (
    SELECT query_id, archive_path, max(greatest(-1, least(1, 1 - distance * distance / 2))) AS best, arg_min(id, (distance, id)) AS id FROM (
      SELECT query_id, id, archive_path, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
        SELECT query_id, v.id, archive_path, list_distance(embedding, query) AS distance FROM v_vectors v, v_queries)) WHERE rank <= 150) GROUP BY 1, 2)
  JOIN (SELECT query_id // 100 AS g, count(*) AS concepts, min(query_id) AS first_id FROM v_queries GROUP BY 1) ON g = query_id // 100
  GROUP BY query_id // 100, archive_path, concepts HAVING count(*) = concepts)""")
def j5_multi_concept_search(spark, d):
    q = V.vector_queries(spark, d)
    concepts = q.select(F.floor(F.col("query_id") / 100).alias("group_id"), "query_id")
    return S.multi_concept_search(S.knn_search(q, V.vectors(spark, d), 5 * 30), concepts)


@query("""SELECT r.o_orderkey AS ref_id, x.l_linenumber AS id FROM (SELECT o_orderkey, o_orderkey % 3 + 2 AS a, o_orderkey % 3 + 4 AS b FROM orders) r
  JOIN lineitem x ON x.l_orderkey = r.o_orderkey AND greatest(a, l_linenumber) <= least(b, l_linenumber + CAST(l_quantity AS BIGINT))""")
def j6_address_join(spark, d):
    refs = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 3 + 2).alias("line_start"), (F.col("o_orderkey") % 3 + 4).alias("line_end"))
    ranges = V.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("line_start"),
                                                  (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("line_end"))
    return S.address_join(refs, ranges)


ENTRY_QUERIES = "SELECT p_partkey AS query_id, p_name AS text FROM part WHERE p_partkey % 50 = 0"


@query(f"""SELECT query_id, id, points, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, hits DESC, id) AS rank FROM (
  SELECT query_id, id, count(*) FILTER (WHERE c > 0) AS points, CAST(sum(c) AS BIGINT) AS hits FROM (
    SELECT query_id, id, (length(x) - length(replace(x, w, ''))) // length(w) AS c FROM (
      SELECT query_id, id, lower(slug || ' ' || kind || ' ' || body || ' ' || project) AS x, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM v_entries, ({ENTRY_QUERIES}) WHERE status = 'active' AND id % 7 <> 3)) GROUP BY 1, 2) WHERE points > 0) WHERE rank <= 5""")
def j13_search_entries(spark, d):
    e = V.entries(spark, d).withColumn("superseded_by", F.when(F.col("id") % 7 == 3, F.col("id") + 1)).withColumn("title", F.col("kind"))
    q = e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("body").alias("text"))
    return S.search_entries(q, e, 5).select("query_id", "id", "points", "hits", "rank")


@query("""SELECT id, min(ts_raw) OVER w AS start_ts, max(ts_raw) OVER w AS end_ts, CASE WHEN id <> first_value(id) OVER w THEN first_value(id) OVER w ELSE nth_value(id, 2) OVER w END AS sibling
  FROM v_exchanges WINDOW w AS (PARTITION BY project, session_id ORDER BY ts_raw, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def j18_session_siblings(spark, d):
    return A.session_siblings(V.exchanges(spark, d))


SUMMARIES = "SELECT '/archive/p' || (doc_id % 7) || '/' || doc_id || '.jsonl' AS archive_path, CASE WHEN toxic = 1 THEN '' ELSE 'text' END AS text FROM labels"


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "labels").select(
        F.concat(F.lit("/archive/p"), F.col("doc_id") % 7, F.lit("/"), "doc_id", F.lit(".jsonl")).alias("archive_path"), F.when(F.col("toxic") == 1, "").otherwise("text").alias("text"))


@query(f"""SELECT *, conversations - with_summary AS without_summary FROM (SELECT count(DISTINCT archive_path) AS conversations, count(*) AS exchanges, min(ts_raw) AS first_ts,
  max(ts_raw) AS last_ts, count(DISTINCT project) AS projects, count(DISTINCT archive_path) FILTER (WHERE archive_path IN (SELECT archive_path FROM ({SUMMARIES}) WHERE text <> '')) AS with_summary FROM v_exchanges)""")
def g1_index_stats(spark, d):
    return A.index_stats(V.exchanges(spark, d), summaries(spark, d))


@query("SELECT project, count(DISTINCT archive_path) AS conversations FROM v_exchanges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def g2_top_projects(spark, d):
    return A.top_projects(V.exchanges(spark, d))


@query("""SELECT project, count(*) AS exchanges, count(DISTINCT session_id) AS sessions, min(ts_raw) AS first_ts, max(ts_raw) AS last_ts FROM v_exchanges
  WHERE NOT is_sidechain GROUP BY 1 HAVING count(*) >= 20""")
def g3_eligible_projects(spark, d):
    return A.eligible_projects(V.exchanges(spark, d))


@query("SELECT project, session_id, min(ts_raw) AS start_ts, max(ts_raw) AS end_ts FROM v_exchanges GROUP BY 1, 2")
def g4_session_rollup(spark, d):
    return A.session_rollup(V.exchanges(spark, d))


@query("""SELECT exchange_id, string_agg(tool_name || '(' || n || ')', ', ' ORDER BY f, tool_name) AS tools FROM (
  SELECT user_id AS exchange_id, event_type AS tool_name, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1""")
def g5_tool_usage(spark, d):
    calls = V.table(spark, d, "events").select(F.col("user_id").alias("exchange_id"), F.col("event_type").alias("tool_name"), F.col("event_id").alias("seq"))
    return A.tool_usage(calls)


NEWEST = "SELECT task_id, run_id, snapshot_id, max(id) AS id, arg_max(passed, id) AS passed, arg_max(turns, id) AS turns FROM v_attempts WHERE passed IS NOT NULL GROUP BY 1, 2, 3"


@query(f"""SELECT run_id, snapshot_id, kind, tier, CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS passed, count(*) AS total, round(coalesce(avg(turns), 0), 6) AS mean_turns
  FROM ({NEWEST}) JOIN v_tasks USING (task_id) GROUP BY GROUPING SETS ((run_id, snapshot_id), (run_id, snapshot_id, kind, tier))""")
def g6_pass_rate(spark, d):
    return A.pass_rate(V.tasks(spark, d), V.attempts(spark, d))


@query("SELECT kind, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'candidate') AS candidate, count(*) FILTER (WHERE status = 'retired') AS retired FROM v_entries GROUP BY 1")
def g9_entry_counts(spark, d):
    return A.entry_counts(V.entries(spark, d))


@query("SELECT task_id, count(*) AS failed, count(DISTINCT lower(event_type)) AS places FROM v_attempts WHERE NOT passed GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT lower(event_type)) >= 2")
def g12_suspect_tasks(spark, d):
    return A.suspect_tasks(V.attempts(spark, d))


@query("""SELECT task_id, round(list_reduce(list_prepend(0.5::DOUBLE, os), lambda r, x: r + (x - r) * 0.2::DOUBLE), 6) AS rate, len(os) AS n FROM (
  SELECT task_id, list(CASE WHEN passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY id) AS os FROM v_attempts GROUP BY 1)""")
def g15_fold_success_rate(spark, d):
    return A.fold_success_rate(V.attempts(spark, d))


@query(f"SELECT * FROM ({NEWEST})")
def w1_newest_attempt(spark, d):
    return A.newest_attempt(V.attempts(spark, d))


@query("SELECT kind, project, slug, max(version) AS version, arg_max(id, version) AS id FROM v_entries GROUP BY 1, 2, 3")
def w2_latest_version(spark, d):
    return A.latest_version(V.entries(spark, d))


@query(f"SELECT task_id, run_id, snapshot_id FROM ({NEWEST}) WHERE NOT passed")
def w3_failing_tasks(spark, d):
    return A.failing_tasks(V.attempts(spark, d))


@query("""SELECT path, line_no FROM (SELECT path, line_no, sum(length(text)) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS used FROM v_messages) WHERE used <= 600""")
def w4_pack_until_full(spark, d):
    return A.pack_until_full(V.messages(spark, d), ["path"], ["line_no"], 600).select("path", "line_no")


@query("""SELECT path, CAST(run AS BIGINT) AS run, is_sidechain, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line_no) AS run FROM (SELECT path, line_no, role = 'assistant' AS is_sidechain,
  CASE WHEN lag(role = 'assistant') OVER (PARTITION BY path ORDER BY line_no) IS NOT DISTINCT FROM (role = 'assistant') THEN 0 ELSE 1 END AS new FROM v_messages)) GROUP BY path, run, is_sidechain""")
def w7_sidechain_segments(spark, d):
    return A.sidechain_segments(V.messages(spark, d).withColumn("is_sidechain", F.col("role") == "assistant"))


@query("""SELECT id, project FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY md5('q2|' || id), id) AS r FROM (
  SELECT id, project, count(*) OVER (PARTITION BY project) AS n FROM v_exchanges WHERE NOT is_sidechain AND length(user_message) >= 80 AND length(assistant_message) >= 200) WHERE n >= 5) WHERE r <= 4""")
def q2_select_source_exchanges(spark, d):
    return A.select_source_exchanges(V.exchanges(spark, d), 4, "q2", least=5)


@query("""SELECT task_id, project, tier FROM (SELECT *, row_number() OVER (PARTITION BY project, tier ORDER BY md5('q3|' || task_id), task_id) AS r FROM v_tasks) JOIN (
  SELECT project, tier, 40 // n + CASE WHEN place <= 40 % n THEN 1 ELSE 0 END AS quota FROM (
  SELECT project, tier, row_number() OVER (ORDER BY project, tier) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT project, tier FROM v_tasks))) USING (project, tier) WHERE r <= quota""")
def q3_stratified_quota(spark, d):
    return A.stratified_quota(V.tasks(spark, d), 40, "q3")


@query("""SELECT task_id, CASE WHEN row_number() OVER (PARTITION BY project, tier ORDER BY kind, task_id) <= floor(count(*) OVER (PARTITION BY project, tier) * 0.6::DOUBLE + 0.5) THEN 'train' ELSE 'test' END AS split FROM v_tasks""")
def q4_split_train_test(spark, d):
    return A.split_train_test(V.tasks(spark, d))


@query("SELECT id FROM (SELECT id, project, id % 3 AS v, id % 4 = 0 AS missing FROM v_vectors) WHERE missing OR v < 2")
def e3_stale_vectors(spark, d):
    v = V.vectors(spark, d)
    return A.stale_vectors(v.select("id", (F.col("id") % 3).alias("embedding_version")), v.filter("id % 4 <> 0"), 2)


@query("""SELECT id, CASE WHEN id = winner THEN 'active' WHEN winner IS NOT NULL AND status = 'active' THEN 'superseded' ELSE status END AS status
  FROM v_entries LEFT JOIN (SELECT kind, project, slug, max(id) AS winner FROM v_entries WHERE id % 10 = 0 GROUP BY 1, 2, 3) USING (kind, project, slug)""")
def e8_activate(spark, d):
    e = V.entries(spark, d)
    return A.activate(e, e.filter("id % 10 = 0").select("id"))


@query("""SELECT id, kind, project, slug, CASE kind WHEN 'instruction' THEN 0 WHEN 'skill' THEN 1 WHEN 'reflection' THEN 2 ELSE 3 END AS kind_order
  FROM v_entries WHERE status = 'active' AND kind IN ('skill', 'instruction')""")
def e9_list_active(spark, d):
    return A.list_active(V.entries(spark, d), ["skill", "instruction"])


DIGEST = """SELECT 'session' AS tier, project, session_id, min(ts_raw) AS period_start, max(ts_raw) AS period_end FROM v_exchanges WHERE session_id NOT LIKE '%4' GROUP BY 2, 3"""
TRIVIAL = """SELECT project, session_id FROM v_exchanges GROUP BY 1, 2 HAVING count(*) = 1 AND (max(trim(user_message)) = '/exit' OR max(length(user_message) + length(assistant_message)) < 100)"""


def digest(spark: SparkSession, d: str) -> DataFrame:
    return A.session_rollup(V.exchanges(spark, d)).filter("session_id NOT LIKE '%4'").select(
        F.lit("session").alias("tier"), "project", "session_id", F.col("start_ts").alias("period_start"), F.col("end_ts").alias("period_end"))


@query(f"""SELECT * FROM (SELECT project, session_id, min(ts_raw) AS start_ts, max(ts_raw) AS end_ts FROM v_exchanges GROUP BY 1, 2) r
  WHERE NOT EXISTS (SELECT 1 FROM ({DIGEST}) x WHERE x.project = r.project AND x.period_start = r.start_ts) AND end_ts <= '2024-01-04'
  AND (project, session_id) NOT IN ({TRIVIAL}) ORDER BY end_ts DESC, session_id LIMIT 5""")
def d1_digest_candidates(spark, d):
    return A.digest_candidates(V.exchanges(spark, d), digest(spark, d), "2024-01-04", 5)


@query(f"""WITH e AS (SELECT tier, project, period_start, period_end FROM ({DIGEST}) WHERE session_id NOT LIKE '%7' AND session_id NOT LIKE '%9'
    UNION ALL SELECT 'day', project, substr(ts_raw, 1, 10), max(ts_raw) FROM v_exchanges GROUP BY project, substr(ts_raw, 1, 10))
  SELECT 'day' AS tier, project, substr(period_start, 1, 10) AS first_day, count(*) AS n, max(period_end) AS period_end FROM e WHERE tier = 'session' AND substr(period_start, 1, 10) < '2024-01-08' GROUP BY 2, 3 HAVING count(*) > 2
  UNION ALL SELECT 'week', project, strftime(date_trunc('week', CAST(substr(period_start, 1, 10) AS DATE)), '%Y-%m-%d') AS first_day, count(*), max(period_end) FROM e
  WHERE tier = 'day' AND date_trunc('week', CAST(substr(period_start, 1, 10) AS DATE)) + INTERVAL 7 DAY <= DATE '2024-01-08' GROUP BY 2, 3 HAVING count(*) > 2""")
def d4_plan_compression(spark, d):
    number = F.col("session_id")
    sessions = digest(spark, d).select("*", number.like("%7").alias("handoff"), F.when(number.like("%9"), F.lit(1).cast("bigint")).alias("superseded_by"))
    day = F.substring("ts_raw", 1, 10)
    days = V.exchanges(spark, d).groupBy("project", day.alias("period_start")).agg(F.max("ts_raw").alias("period_end")).select(
        F.lit("day").alias("tier"), "project", "period_start", "period_end", F.lit(False).alias("handoff"), F.lit(None).cast("bigint").alias("superseded_by"))
    return A.plan_compression(sessions.drop("session_id").unionByName(days), "2024-01-08", 2, 2)


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '<EMAIL>', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '<SSN>', 'g'),
  '\b(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,4})\b', '<CC>', 'g'), '(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}', '<PHONE>', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<IP>', 'g') AS text,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[A-Za-z]{2,}', '[redacted]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[redacted]', 'g'),
  '\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b', '[redacted]', 'g'), '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b', '[redacted]', 'g'), '\b\d{10,19}\b', '[redacted]', 'g')) AS untyped FROM documents""")
def x2_redact_pii(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.redact_pii(F.col("text")).alias("text"), F.md5(T.redact_pii_untyped(F.col("text"))).alias("untyped"))


@query("SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events")
def x5_week_start(spark, d):
    return V.table(spark, d, "events").select("event_id", T.week_start(F.col("ts")).cast("string").alias("week"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))), ' ') AS tokens FROM documents""")
def x7_content_tokens(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.content_tokens(F.col("text"))), " ").alias("tokens"))


@query("""SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || '! ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM part""")
def x19_slug(spark, d):
    return V.table(spark, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit("! "), "p_type")).alias("slug"))


@query("""SELECT query_id, v.id, round(greatest(-1, least(1, 1 - round(list_distance(embedding, query), 6) ** 2 / 2)), 6) AS similarity FROM v_vectors v, v_queries""")
def f7_l2_to_cosine(spark, d):
    pairs = S.all_distances(V.vector_queries(spark, d), V.vectors(spark, d))
    # a distance of 6 places has a similarity of 12, so ties are many: rounded as the SQL's round() does
    return pairs.select("query_id", "id", T.rounded(T.l2_to_cosine(F.col("distance")), 6).alias("similarity"))


@query(f"""SELECT DISTINCT 'session' AS tier, project, start_ts AS period_start FROM (SELECT project, session_id, min(ts_raw) AS start_ts FROM v_exchanges GROUP BY 1, 2)
  WHERE (project, start_ts) NOT IN (SELECT project, period_start FROM ({DIGEST}))""")
def e10_insert_digest(spark, d):
    new = A.session_rollup(V.exchanges(spark, d)).select(F.lit("session").alias("tier"), "project", F.col("start_ts").alias("period_start"))
    return A.insert_new(digest(spark, d).drop("session_id"), new, ["tier", "project", "period_start"])


@query("""SELECT doc_id, trim(regexp_extract('a <summary> ' || source || chr(10) || lang || ' </summary> b', '<summary>(.*?)</summary>', 1, 's')) AS summary FROM documents""")
def x18_extract_summary(spark, d):
    x = F.concat(F.lit("a <summary> "), "source", F.lit("\n"), "lang", F.lit(" </summary> b"))
    return V.table(spark, d, "documents").select("doc_id", T.extract_summary(x).alias("summary"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from turnlake import learned_queries, learning_queries, more_queries, prompt_queries, review_queries, screen_queries, source_queries, state_queries, stream_queries, topic_queries  # noqa: F401  register their queries here

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
