"""Registered queries over the review, text index and streaming operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnlake.functions.stems import stems_sql
from turnlake.operators import review as R
from turnlake.operators import text_index as I
from turnlake.plans import adapters as V
from turnlake.queries import query
from turnlake.streaming import streams

NOTE_TAIL = "chr(10) || 'fact x [#' || md5(archive_path) || ', #' || md5(archive_path) || ']'"
NOTES = f"""(SELECT archive_path AS id, project, string_agg('fact ' || line_start || ' [#' || id || ']', chr(10) ORDER BY line_start)
  || CASE WHEN max(line_end) > 5 THEN {NOTE_TAIL} ELSE '' END AS text FROM v_exchanges GROUP BY archive_path, project)"""


def notes(spark, d):
    """Cited notes: one entry a conversation, one line an exchange; those of long ones end with a line of unknown ids."""
    line = F.concat(F.lit("fact "), F.col("line_start"), F.lit(" [#"), "id", F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_start", line.alias("line")))), lambda x: x["line"])
    grouped = V.exchanges(spark, d).groupBy("archive_path", "project").agg(lines.alias("lines"), F.max("line_end").alias("last"))
    tail = F.concat(F.lit("\nfact x [#"), F.md5("archive_path"), F.lit(", #"), F.md5("archive_path"), F.lit("]"))
    return grouped.select(F.col("archive_path").alias("id"), "project", F.concat(F.array_join("lines", "\n"), F.when(F.col("last") > 5, tail).otherwise("")).alias("text"))


MARKS = f"(SELECT id AS entry_id, unnest(regexp_extract_all(text, '#([0-9a-f]{{32}})', 1)) AS mark FROM {NOTES})"


@query(f"""SELECT DISTINCT entry_id, e.id AS exchange_id, archive_path, line_start, line_end, session_id FROM {MARKS} JOIN v_exchanges e ON mark = e.id""")
def j7_resolve_citations(spark, d):
    return R.resolve_citations(notes(spark, d), V.exchanges(spark, d))


@query(f"SELECT entry_id, count(*) AS missing FROM {MARKS} WHERE mark NOT IN (SELECT id FROM v_exchanges) GROUP BY 1")
def j8_unresolved_citations(spark, d):
    return R.unresolved_citations(notes(spark, d), V.exchanges(spark, d))


@query(f"""SELECT k.id, k.text, a.id AS superseded_by FROM (SELECT id, sup, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
  SELECT id, sup, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT *, lead(id) OVER (PARTITION BY project ORDER BY id) AS sup FROM {NOTES}))
  WHERE regexp_extract(line, '#([0-9a-f]{{32}})', 1) NOT IN (SELECT id FROM v_exchanges WHERE line_start <= 2 AND project <> 'p1')
  GROUP BY 1, 2) k LEFT JOIN (SELECT DISTINCT id FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM {NOTES})
  WHERE regexp_extract(line, '#([0-9a-f]{{32}})', 1) NOT IN (SELECT id FROM v_exchanges WHERE line_start <= 2 AND project <> 'p1')) a ON a.id = k.sup""")
def d9_remove_derived(spark, d):
    n = notes(spark, d).withColumn("superseded_by", F.lead("id").over(Window.partitionBy("project").orderBy("id"))).drop("project")
    return R.remove_derived(n, V.exchanges(spark, d).filter("line_start <= 2 AND project <> 'p1'").select("id"))


MANIFEST = "(SELECT path, max(line_no) AS mtime, right(path, 7) = '4.jsonl' AS marked, project FROM v_messages GROUP BY path, project)"
ISSUES = f"""(SELECT path, issue FROM (SELECT m.path, CASE WHEN m.path LIKE '%5.jsonl' THEN 'missing' WHEN m.mtime > coalesce(l.last, 0) THEN 'outdated' END AS issue
  FROM {MANIFEST} m LEFT JOIN (SELECT archive_path AS path, max(line_end) AS last FROM v_exchanges GROUP BY 1) l USING (path) WHERE project <> 'p6' AND NOT marked)
  WHERE issue IS NOT NULL UNION ALL SELECT DISTINCT archive_path, 'orphaned' FROM v_exchanges WHERE project = 'p6' OR archive_path LIKE '%4.jsonl')"""


def issues(spark, d):
    files = V.messages(spark, d).groupBy("path", "project").agg(F.max("line_no").alias("mtime"))
    marked = files.filter("path LIKE '%4.jsonl'").select("path")
    ex = V.exchanges(spark, d).select(F.col("archive_path").alias("path"), F.col("line_end").alias("last_indexed"))
    summaries = files.filter("path NOT LIKE '%5.jsonl'").select("path")
    return R.verify_index(files.filter("project <> 'p6'").select("path", "mtime"), ex, summaries, marked), marked


@query(f"SELECT path, issue FROM {ISSUES}")
def e1_verify_index(spark, d):
    return issues(spark, d)[0]


@query(f"SELECT path, CASE issue WHEN 'orphaned' THEN 'delete' ELSE 'reindex' END AS action FROM {ISSUES}")
def e2_repair_plan(spark, d):
    return R.repair_plan(*issues(spark, d))


@query("""WITH v_two AS (SELECT run_id, event_type, id % 11 AS part, count(*) FILTER (snapshot_id = 0) AS bg, count(*) FILTER (snapshot_id = 1) AS ag, count(*) FILTER (snapshot_id = 0 AND passed) AS bp, count(*) FILTER (snapshot_id = 1 AND passed) AS ap,
  coalesce(sum(turns) FILTER (snapshot_id = 0), 0) AS bt, coalesce(sum(turns) FILTER (snapshot_id = 1), 0) AS nt, coalesce(sum(usd) FILTER (snapshot_id = 0), 0) AS bu, coalesce(sum(usd) FILTER (snapshot_id = 1), 0) AS nu
  FROM (SELECT *, CASE WHEN id % 3 > 0 THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS usd FROM v_attempts) GROUP BY 1, 2, 3),
v_saved AS (SELECT *, CASE WHEN bg > 0 AND ag > 0 AND bt > 0 THEN 100 * (bt / bg - nt / ag) / (bt / bg) ELSE 0 END AS ts, CASE WHEN bg > 0 AND ag > 0 AND bu > 0 THEN 100 * (bu / bg - nu / ag) / (bu / bg) ELSE 0 END AS us FROM v_two),
v_told AS (SELECT *, CASE WHEN bg = 0 OR ag = 0 THEN 'unmeasured' WHEN bg <> ag THEN 'unequal-coverage' WHEN ap < bp THEN 'pass-rate-fell' WHEN ts >= 10 OR us >= 10 THEN 'saving' ELSE 'no-saving' END AS reason FROM v_saved)
SELECT run_id, event_type, part, round(ts, 4) AS turn_saving, round(us, 4) AS usd_saving, reason = 'saving' AS keep, reason FROM v_told""")
def g8_gain_decision(spark, d):
    side = F.when(F.col("snapshot_id") == 0, "before").otherwise("after").alias("side")
    used = V.attempts(spark, d).withColumn("usd", F.when(F.col("id") % 3 > 0, 0.25).otherwise(0.0)).withColumn("part", F.col("id") % 11)
    cells = used.groupBy("run_id", "event_type", "part", side).agg(F.count(F.lit(1)).alias("graded"), F.count_if("passed").alias("passed"), F.sum("turns").alias("turns"), F.sum("usd").alias("usd"))
    return R.gain_decision(cells, ["run_id", "event_type", "part"])


@query("""SELECT task_id, n.id FROM (SELECT task_id, arg_max(passed, id) AS ok FROM v_attempts WHERE snapshot_id = 0 GROUP BY 1) b
  JOIN (SELECT task_id, max(id) AS id, arg_max(passed, id) AS ok FROM v_attempts WHERE snapshot_id = 1 GROUP BY 1) n USING (task_id) WHERE b.ok AND NOT n.ok""")
def g11_merge_check(spark, d):
    last = lambda s: V.attempts(spark, d).filter(F.col("snapshot_id") == s).groupBy("task_id").agg(F.max("id").alias("id"), F.max_by("passed", "id").alias("passed"))
    return R.merge_check(last(0), last(1))


@query("""SELECT project, leaf, CAST(sum(n) AS BIGINT) AS n FROM (SELECT project, n, CASE WHEN sum(n) OVER (PARTITION BY project) > 900 THEN category END AS leaf FROM (
  SELECT project, event_type AS category, count(*) AS n FROM v_attempts JOIN v_tasks USING (task_id) WHERE NOT passed GROUP BY 1, 2)) GROUP BY 1, 2""")
def g13_split_failures(spark, d):
    failed = V.attempts(spark, d).filter("NOT passed").join(V.tasks(spark, d), "task_id")
    return R.split_failures(failed.withColumnRenamed("event_type", "category"), 900)


@query("""SELECT kind, project, slug, count(DISTINCT id % 4) AS runs, array_to_string(list_sort(list_distinct(list(id))), ',') AS sources FROM v_entries GROUP BY 1, 2, 3
  HAVING count(DISTINCT id % 4) >= 2""")
def g14_merge_candidates(spark, d):
    kept = V.entries(spark, d).withColumns({"run_id": F.col("id") % 4, "source": F.col("id")})
    return R.merge_candidates(kept).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT e.project, e.slug, e.kind, e.body, l.version + 1 AS version, l.id AS parent FROM (SELECT project, slug, kind, min(body) AS body FROM v_entries GROUP BY 1, 2, 3) e
  JOIN (SELECT project, slug, kind, max(version) AS version, max(id) AS id, arg_max(body, version) AS last FROM v_entries GROUP BY 1, 2, 3) l USING (project, slug, kind) WHERE e.body <> l.last""")
def e7_insert_entries(spark, d):
    key = ["project", "slug", "kind"]
    e = V.entries(spark, d)
    return R.insert_entries(e, e.groupBy(*key).agg(F.min("body").alias("body")), key)


@query("""SELECT id, row_number() OVER (PARTITION BY project ORDER BY CASE kind WHEN 'instruction' THEN 1 WHEN 'skill' THEN 2 WHEN 'reflection' THEN 3 ELSE 4 END, slug, id) AS place FROM v_entries""")
def q8_entry_order(spark, d):
    return V.entries(spark, d).select("id", R.entry_rank().alias("place"))


WORDSET = "list_distinct(list_filter(list_transform(regexp_split_to_array(lower({0}), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 2))"


@query(f"""SELECT context, id, score, score >= 0.3 AS selected, rank FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, id) AS rank FROM (
  SELECT context, id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score
  FROM (SELECT slug AS context, {WORDSET.format("slug || ' ' || min(body)")} AS a FROM v_entries GROUP BY slug), (SELECT id, {WORDSET.format("slug || ' ' || body")} AS b FROM v_entries WHERE kind = 'skill'))
  WHERE score >= 0.01) WHERE rank <= 10""")
def j14_match_procedures(spark, d):
    e = V.entries(spark, d)
    contexts = e.groupBy("slug").agg(F.min("body").alias("body")).select(F.col("slug").alias("context"), F.concat_ws(" ", "slug", "body").alias("text"))
    return R.match_procedures(contexts, e.filter("kind = 'skill'").select("id", F.concat_ws(" ", "slug", "body").alias("text")), 10)


ANSWERS = """(SELECT id, archive_path AS true_path, line_start AS true_start, line_end AS true_end, CASE WHEN project = 'p0' THEN NULL WHEN project = 'p1' THEN '/moved/' || regexp_extract(archive_path, '([^/]*)$', 1)
  WHEN project = 'p2' THEN '/else.jsonl' ELSE archive_path END AS path, line_start + CASE WHEN project = 'p3' THEN 100 ELSE 0 END AS s, line_end + 100 AS e FROM v_exchanges)"""


@query(f"""SELECT id, score, CASE WHEN path IS NULL THEN 'no-location' WHEN score = 1 THEN NULL WHEN score = 0.5 THEN 'wrong-lines-or-date' ELSE 'wrong-target' END AS failure FROM (
  SELECT *, CAST(CASE WHEN path = true_path AND s <= true_end AND true_start <= e THEN 1 WHEN regexp_extract(path, '([^/]*)$', 1) = regexp_extract(true_path, '([^/]*)$', 1) THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM {ANSWERS})""")
def x12_grade_locate(spark, d):
    p, path = F.col("project"), F.col("archive_path")
    told = F.when(p == "p0", None).when(p == "p1", F.concat(F.lit("/moved/"), F.regexp_extract(path, r"([^/]*)$", 1))).when(p == "p2", "/else.jsonl").otherwise(path)
    return R.grade_locate(V.exchanges(spark, d).select(
        "id", told.alias("path"), (F.col("line_start") + F.when(p == "p3", 100).otherwise(0)).alias("line_start"), (F.col("line_end") + 100).alias("line_end"),
        path.alias("true_path"), F.col("line_start").alias("true_start"), F.col("line_end").alias("true_end")))


@query("""SELECT session, CASE WHEN stop IS NULL THEN 'pending' WHEN stop_ok THEN 'done' ELSE 'rejected' END AS status, coalesce(stop_failed, total) AS attempts FROM (
  SELECT session, min(CASE WHEN ok OR failed >= 3 THEN seq END) AS stop, arg_min(ok, seq) FILTER (ok OR failed >= 3) AS stop_ok, arg_min(failed, seq) FILTER (ok OR failed >= 3) AS stop_failed, max(failed) AS total
  FROM (SELECT task_id AS session, id AS seq, turns > 80 AS ok, count(*) FILTER (NOT turns > 80) OVER (PARTITION BY task_id ORDER BY id) AS failed FROM v_attempts) GROUP BY 1)""")
def t10_fold_session_status(spark, d):
    return R.fold_session_status(V.attempts(spark, d).select(F.col("task_id").alias("session"), F.col("id").alias("seq"), (F.col("turns") > 80).alias("ok")))


@query("""SELECT project, unit_id, coalesce(seq, top + row_number() OVER (PARTITION BY project, seq IS NULL ORDER BY slug, pos, unit_id)) AS seq FROM (
  SELECT source AS project, doc_id AS unit_id, lang AS slug, n_chars AS pos, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS seq FROM documents)
  LEFT JOIN (SELECT source AS project, max(doc_id) AS top FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) USING (project)""")
def w9_unit_seq(spark, d):
    units = V.table(spark, d, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("unit_id"), F.col("lang").alias("slug"), F.col("n_chars").alias("pos"))
    return R.unit_seq(units, units.filter("unit_id % 3 = 0").select("project", "unit_id", F.col("unit_id").alias("seq")))


@query("""SELECT id, CASE WHEN status = 'active' THEN 'already-active' WHEN status = 'retired' THEN 'retired' WHEN ga IS NULL THEN 'no-record' WHEN ga = 0 THEN 'unmeasured'
  WHEN id % 13 = 0 THEN 'regression' WHEN ga <> gb AND pa * gb < pb * ga THEN 'lower-rate' WHEN ga = gb AND pa < pb THEN 'lower-count' ELSE 'approvable' END AS verdict FROM (
  SELECT id, status, CASE WHEN id % 17 > 0 THEN id % 7 END AS ga, id % 5 + 3 AS gb, id % 3 AS pa, id % 4 AS pb FROM v_entries)""")
def k6_approval_gate(spark, d):
    return R.approval_gate(V.entries(spark, d).select(
        "id", "status", F.expr("CASE WHEN id % 17 > 0 THEN id % 7 END").alias("graded_after"), F.expr("id % 5 + 3").alias("graded_before"),
        F.expr("id % 3").alias("passed_after"), F.expr("id % 4").alias("passed_before"), F.expr("int(id % 13 = 0)").alias("regressions")))


WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def index(spark, d):
    return I.build_postings(V.table(spark, d, "documents"), "doc_id", ["text", "source"])


def asked(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


ASKED = f"(SELECT item_id AS query_id, list_distinct({WORDS.format("text")}) AS terms FROM benchmark)"
POSTINGS = f"""(SELECT doc_id, field, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (
  SELECT doc_id, 'text' AS field, {WORDS.format("coalesce(text, '')")} AS w FROM documents UNION ALL SELECT doc_id, 'source', {WORDS.format("coalesce(source, '')")} FROM documents))"""


@query(f"SELECT term, field, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(sum(pos) AS BIGINT) AS places FROM {POSTINGS} GROUP BY 1, 2")
def s13_postings(spark, d):
    return index(spark, d).groupBy("term", "field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("pos").alias("places"))


PARTS = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}]+')"
def stemmed(text: str) -> str:
    """Views of all postings' stems and of the phrases of the benchmark's `text`."""
    return f"""v_post AS (SELECT doc_id, field, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (
  SELECT doc_id, field, {stems_sql(PARTS.format("t"))} AS w FROM (SELECT doc_id, 'text' AS field, coalesce(text, '') AS t FROM documents UNION ALL SELECT doc_id, 'source', coalesce(source, '') FROM documents))),
v_runs AS (SELECT query_id, list_distinct(list_filter(list_transform(runs, lambda r: {stems_sql(PARTS.format("r"))}), lambda p: len(p) > 0)) AS ps FROM (
  SELECT item_id AS query_id, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+') AS runs FROM benchmark)),
v_terms AS (SELECT query_id, i, len(p) AS size, n, unnest(p) AS term, generate_subscripts(p, 1) AS k FROM (SELECT query_id, len(ps) AS n, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM v_runs))"""


FOUND = """SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM (
  SELECT query_id, doc_id, n FROM (SELECT query_id, doc_id, n, i FROM v_terms JOIN v_post USING (term) GROUP BY query_id, doc_id, n, i, size, field, pos - k HAVING count(DISTINCT k) = size)
  GROUP BY ALL HAVING count(DISTINCT i) = n)) WHERE rank <= 20"""


def terms_index(spark, d):
    """Postings of texts that are analysed and written once: a search reads them three times."""
    path = f"{streams.shared_root(spark)}/terms-{uuid.uuid4().hex}"
    texts = I.analysed_texts(V.table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", ["text", "source"])
    texts.write.option("compression", "zstd").parquet(path)
    return I.postings_of(spark.read.schema(texts.schema).parquet(path), "doc_id")


@query(f"WITH {stemmed('text')} {FOUND}")
def j2_text_search(spark, d):
    return I.text_search(asked(spark, d), terms_index(spark, d), "doc_id", 20)


@query(f"""WITH {stemmed("regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g')")} {FOUND}""")
def j2_phrase_search(spark, d):
    """Whole benchmark texts as one phrase each."""
    phrases = asked(spark, d).withColumn("text", F.regexp_replace("text", "[^A-Za-z0-9]+", "_"))
    return I.text_search(phrases, terms_index(spark, d), "doc_id", 20)


@query(f"""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM (
    SELECT query_id, doc_id, n, tf, count(*) OVER (PARTITION BY query_id, term) AS df FROM (SELECT query_id, doc_id, term, n, count(*) AS tf
      FROM (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM {ASKED}) JOIN {POSTINGS} USING (term) GROUP BY ALL)) t
  JOIN (SELECT doc_id, count(*) AS len FROM {POSTINGS} GROUP BY 1) USING (doc_id), (SELECT count(DISTINCT doc_id)::DOUBLE AS docs, count(*) / count(DISTINCT doc_id) AS mean FROM {POSTINGS})
  GROUP BY query_id, doc_id, n HAVING count(*) = n)) WHERE rank <= 20""")
def j10_ranked_search(spark, d):
    return I.bm25_search(asked(spark, d), index(spark, d), "doc_id", 20)


#: Digest entries: documents by source, some in one line that cites e3, the others with a last line that cites an id; every sixth is superseded.
ENTRIES = """v_entry AS (SELECT doc_id AS id, source AS project, doc_id % 6 = 0 AS old, CASE WHEN doc_id % 5 = 0 THEN replace(coalesce(text, ''), chr(10), ' ') || ' [#e3]' ELSE coalesce(text, '') || chr(10) || '- seen [x, #e' || (doc_id % 7) || ']' END AS text FROM documents)"""


@query(rf"""WITH {ENTRIES}, v_post AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM v_entry),
v_tf AS (SELECT query_id, id, term, n, count(*) AS tf FROM (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM {ASKED}) JOIN v_post USING (term) GROUP BY ALL),
v_score AS (SELECT query_id, id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM v_tf) JOIN (SELECT id, count(*) AS len FROM v_post GROUP BY 1) USING (id), (SELECT count(DISTINCT id)::DOUBLE AS docs, count(*) / count(DISTINCT id) AS mean FROM v_post)
  GROUP BY query_id, id, n HAVING count(*) = n),
v_best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v_score JOIN v_entry USING (id) WHERE NOT old AND (length(CAST(query_id AS VARCHAR)) % 2 = 0 OR project = (SELECT min(source) FROM documents))),
v_seen AS (SELECT query_id, id, rank, list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '\[(x, )?#e3\]')) AS ls FROM v_best WHERE rank <= 20)
SELECT query_id, id, rank, md5(array_to_string(ls, chr(10))) AS text FROM v_seen WHERE regexp_matches(array_to_string(ls, chr(10)), '\S')""")
def j10_search_digest(spark, d):
    t = V.table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    own = F.when(F.col("doc_id") % 5 == 0, F.concat(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit(" [#e3]"))).otherwise(F.concat(text, F.lit("\n- seen [x, #e"), F.col("doc_id") % 7, F.lit("]")))
    entries = t.select(F.col("doc_id").alias("id"), F.col("source").alias("project"), own.alias("text"), F.when(F.col("doc_id") % 6 == 0, F.lit(1)).alias("superseded_by"))
    least = t.agg(F.min("source").alias("least"))
    queries = asked(spark, d).crossJoin(F.broadcast(least)).withColumn("project", F.when(F.length(F.col("query_id").cast("string")) % 2 == 1, F.col("least"))).drop("least")
    return I.search_digest(queries, entries, spark.range(1).select(F.lit("e3").alias("id")), 20).withColumn("text", F.md5("text"))


@query("""SELECT period_start::VARCHAR AS period_start, event_type, n FROM (SELECT date_trunc('day', ts) AS period_start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  WHERE period_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""")
def r4_stream_tier_counts(spark, d):
    counts = streams.tier_counts(streams.event_stream(spark, f"{d}/events.parquet"), "day", "30 minutes")
    return streams.drained(counts, "tier-counts").withColumn("period_start", F.date_format("period_start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def r5_stream_dedup(spark, d):
    return streams.drained(streams.first_seen(streams.event_stream(spark, f"{d}/events.parquet"), ["user_id", "event_type"], "60 days"), "first-seen")
