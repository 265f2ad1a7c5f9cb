"""Registered queries over prompts, answers, digests and project contexts, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnlake.learning_queries import _redacted
from turnlake.operators import prompts as P
from turnlake.plans import adapters as V
from turnlake.queries import query

NUMBERED = """v_num AS (SELECT archive_path, project, id, line_start, ts_raw, user_message, assistant_message, replace(user_message, chr(10), ' ') AS flat,
  row_number() OVER (PARTITION BY archive_path ORDER BY line_start) AS n FROM v_exchanges)"""


def numbered(spark, d):
    w = Window.partitionBy("archive_path").orderBy("line_start")
    return V.exchanges(spark, d).withColumn("flat", F.replace(F.col("user_message"), F.lit("\n"), F.lit(" "))).withColumn("n", F.row_number().over(w))


@query("""SELECT k, unnest(f.kept) - 1 AS place FROM (SELECT k, list_reduce(list_transform(range(1, len(ns) + 1), lambda i: {used: ns[i]::BIGINT, kept: [i]}),
  lambda s, b: CASE WHEN s.used + b.used + CASE WHEN len(s.kept) > 0 THEN 2 ELSE 0 END <= 900 THEN {used: s.used + b.used + CASE WHEN len(s.kept) > 0 THEN 2 ELSE 0 END, kept: list_concat(s.kept, b.kept)} ELSE s END,
  {used: 0::BIGINT, kept: []::BIGINT[]}) AS f FROM (SELECT conv_id AS k, list(length(coalesce(text, '')) ORDER BY turn) AS ns FROM conversations GROUP BY 1))""")
def w5_pack_skip(spark, d):
    ns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.char_length(F.coalesce("text", F.lit(""))).alias("n")))), lambda x: x["n"])
    return V.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("k")).agg(ns.alias("ns")).select("k", F.explode(P.pack_skip(F.col("ns"), 900)).alias("place"))


@query(f"""WITH {NUMBERED}, v_clip AS (SELECT archive_path, id, n, '[' || n || '] ' || substr(ts_raw, 1, 10) || ' User: ' || CASE WHEN length(u) > 300 THEN substr(u, 1, 300) || '...' ELSE u END || chr(10) ||
  '[' || n || '] Agent: ' || CASE WHEN length(a) > 300 THEN substr(a, 1, 300) || '...' ELSE a END AS block FROM (SELECT *, {_redacted('user_message')} AS u, {_redacted('assistant_message')} AS a FROM v_num)),
v_kept AS (SELECT archive_path, list_reduce(list({{used: length(block)::BIGINT, kept: [n]}} ORDER BY n),
  lambda s, b: CASE WHEN s.used + b.used + CASE WHEN len(s.kept) > 0 THEN 2 ELSE 0 END <= 1000 THEN {{used: s.used + b.used + CASE WHEN len(s.kept) > 0 THEN 2 ELSE 0 END, kept: list_concat(s.kept, b.kept)}} ELSE s END,
  {{used: 0::BIGINT, kept: []::BIGINT[]}}) AS f FROM v_clip GROUP BY 1)
SELECT c.archive_path, n AS mark, id, md5(block) AS block FROM v_clip c JOIN v_kept k ON c.archive_path = k.archive_path AND list_contains(k.f.kept, n)""")
def d2_session_prompt_rows(spark, d):
    return P.session_prompt_rows(V.exchanges(spark, d), 1000, dated=True, most=300).withColumn("block", F.md5("block"))


@query(f"""WITH {NUMBERED}, v_raw AS (SELECT archive_path, n, generate_subscripts(ls, 1) AS i, unnest(ls) AS line, len(ls) AS c FROM (SELECT *, string_split(user_message, chr(10)) AS ls FROM v_num)),
v_said AS (SELECT r.*, trim(line) AS t, i = c AND n % 4 < 3 AS marked, n % 3 > 0 AS inner_, a.id AS own, b.id AS next, p.id AS before FROM v_raw r JOIN v_num a USING (archive_path, n)
  LEFT JOIN v_num b ON b.archive_path = r.archive_path AND b.n = r.n + r.n % 2 LEFT JOIN v_num p ON p.archive_path = r.archive_path AND p.n = r.n - 1),
v_told AS (SELECT archive_path, n, i, t <> '' OR marked AS there, marked AND t <> '' AND next IS NOT NULL AND (NOT inner_ OR before IS NOT NULL) AS good,
  t || CASE WHEN inner_ THEN ' see [#' || before || '] in a[9]' ELSE '' END || ' [#' || own || ',#' || next || ']' AS line,
  CASE WHEN inner_ THEN [before, own, next] ELSE [own, next] END AS ids FROM v_said)
SELECT archive_path, coalesce(string_agg(line, chr(10) ORDER BY n, i) FILTER (WHERE good), '') AS text, coalesce(sum(CASE WHEN good THEN 0 ELSE 1 END), 0)::BIGINT AS dropped,
  coalesce(len(list_distinct(flatten(list(ids) FILTER (WHERE good)))), 0) AS n_sources FROM v_told WHERE there GROUP BY 1""")
def d3_parse_cited_lines(spark, d):
    n = F.col("n")
    line = F.concat(F.lit("- "), "user_message", F.when(n % 4 < 3, F.concat(F.when(n % 3 > 0, F.concat(F.lit(" see ["), n - 1, F.lit("] in a[9]"))).otherwise(""), F.lit(" ["), n, F.lit(" , "), n + n % 2, F.lit("] "))).otherwise(""))
    num = numbered(spark, d)
    answers = num.groupBy("archive_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda x: x["l"]), "\r\n").alias("text"))
    return P.parse_cited_lines(answers, num.select("archive_path", n.alias("mark"), "id"), "archive_path").select("archive_path", "text", "dropped", F.size("sources").cast("long").alias("n_sources"))


@query(f"""WITH {NUMBERED}, v_e AS (SELECT archive_path, project, row_number() OVER (PARTITION BY project ORDER BY archive_path) AS id, min(ts_raw) AS first, max(ts_raw) AS last, count(*) AS c,
  string_agg(flat || ' [#' || id || ']', chr(10) ORDER BY n) FILTER (WHERE n <> 2) AS text FROM v_num GROUP BY 1, 2),
v_b AS (SELECT project, id, last, id % 4 = 1 AS handoff, '## ' || CASE WHEN id % 4 = 1 THEN 'Handoff note' WHEN c % 3 = 0 THEN 'Session ' || substr(first, 1, 10) WHEN c % 3 = 1 THEN 'Day ' || substr(first, 1, 10)
  ELSE 'Week of ' || substr(first, 1, 10) END || chr(10) || text || chr(10) || chr(10) AS block FROM v_e WHERE id % 5 > 0),
v_u AS (SELECT *, sum(length(block)) OVER (PARTITION BY project ORDER BY handoff DESC, last DESC, id DESC) AS used FROM v_b)
SELECT project, '# Digest' || chr(10) || string_agg(block, '' ORDER BY used) AS digest FROM v_u WHERE used <= 2991 GROUP BY 1""")
def d6_build_digest(spark, d):
    num = numbered(spark, d)
    marked = F.struct("n", F.concat("flat", F.lit(" [#"), "id", F.lit("]")).alias("l"))
    e = num.groupBy("archive_path", "project").agg(F.min("ts_raw").alias("period_start"), F.max("ts_raw").alias("period_end"), F.count(F.lit(1)).alias("c"),
        F.array_join(F.transform(F.array_sort(F.collect_list(marked)), lambda x: x["l"]), "\n").alias("text"), F.array_compact(F.array(F.max(F.when(F.col("n") == 2, F.col("id"))))).alias("hide"))
    e = e.withColumn("id", F.row_number().over(Window.partitionBy("project").orderBy("archive_path"))).withColumn("handoff", F.col("id") % 4 == 1)
    e = e.withColumn("tier", F.element_at(F.array(*map(F.lit, ("session", "day", "week"))), (F.col("c") % 3 + 1).cast("int"))).withColumn("superseded_by", F.when(F.col("id") % 5 == 0, 1))
    return P.build_digest(e, "# Digest", 3000, F.col("hide"))


WORDS = r"list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{4,}}'))"


@query(f"""WITH {NUMBERED}, v_l AS (SELECT a.archive_path, a.n, a.flat, CASE a.n % 6 WHEN 0 THEN md5(a.id) WHEN 1 THEN b.id ELSE a.id END AS cited, a.n % 6 AS k, a.line_start FROM v_num a
  JOIN v_num b ON a.archive_path = b.archive_path AND b.n = CASE WHEN a.n > 1 THEN a.n - 1 ELSE 1 END)
SELECT l.archive_path || ':' || n AS key, CASE WHEN k IN (4, 5) THEN 'no-marks' WHEN e.id IS NULL OR (k = 3 AND l.line_start % 2 = 1) THEN 'unknown-id'
  WHEN len(list_intersect({WORDS.format('flat')}, {WORDS.format('e.assistant_message')})) < 3 THEN 'ungrounded' END AS reason FROM v_l l LEFT JOIN v_exchanges e ON e.id = l.cited WHERE trim(flat) <> ''""")
def x8_gate_cited_lines(spark, d):
    num = numbered(spark, d)
    before = F.coalesce(F.lag("id").over(Window.partitionBy("archive_path").orderBy("line_start")), "id")
    k = F.col("n") % 6
    cited = F.when(k == 0, F.md5("id")).when(k == 1, before).otherwise(F.col("id"))
    group = (F.when(k == 4, "").when(k == 5, " [@1]")
             .when((k == 3) & (F.col("line_start") % 2 == 1), F.concat(F.lit(" [#"), cited, F.lit(",@99999999999]")))
             .otherwise(F.concat(F.lit(" [#"), cited, F.lit(", @1]"))))
    answers = num.select(F.concat("archive_path", F.lit(":"), "n").alias("key"), F.concat(F.lit("* "), "flat", group).alias("text"))
    texts = num.select("id", F.col("assistant_message").alias("text"))
    return P.gate_cited_lines(answers, texts, V.attempts(spark, d), "key").select("key", "reason")


@query("""SELECT * FROM (SELECT id, t.tier, t.kind, trim(t.prompt) AS prompt FROM (SELECT id, unnest([{tier: 1, kind: 'locate', prompt: a}, {tier: 1, kind: 'recall', prompt: b}, {tier: 3, kind: 'when', prompt: a}]) AS t
  FROM (SELECT id, string_split(user_message, chr(10))[1] AS a, string_split(assistant_message, chr(10))[-1] AS b FROM v_exchanges))) WHERE prompt <> ''""")
def x17_parse_paraphrase(spark, d):
    a, b = F.element_at(F.split("user_message", "\n"), 1), F.element_at(F.split("assistant_message", "\n"), -1)
    text = F.concat(F.lit("<tier1>\n- **Locate**: first\n- **Locate**: "), a, F.lit(" **\n why: none\nrecall : "), b, F.lit("\n</tier1>\n<tier2>no</tier3> <tier3>when:"), a, F.lit("</tier3>"))
    return P.parse_paraphrase(V.exchanges(spark, d).select("id", text.alias("text")), "id")


@query("""SELECT conv_id, turn, CASE WHEN role <> 'user' THEN substr(text, 1, 5) || '!' END AS answer, CASE WHEN text IS NULL THEN 'no prompt' WHEN role = 'user' THEN 'refused' END AS error FROM conversations""")
def u2_map_prompts(spark, d):
    def model(prompt: str) -> str:
        role, text = prompt.split(":", 1)
        if role == "user":
            raise ValueError("refused")
        return text[:5] + "!"

    c = V.table(spark, d, "conversations")
    out = P.map_prompts(c.select(F.struct("conv_id", "turn").alias("k"), F.concat("role", F.lit(":"), "text").alias("prompt")), model, "k")
    return out.select("k.*", "answer", "error")


@query("""SELECT id, round(length(user_message) / sqrt(length(user_message) ** 2 + 1), 6) AS x FROM v_exchanges""")
def a10_embed_exchanges(spark, d):
    def vectors(texts: list[str]) -> np.ndarray:
        v = np.array([[len(t), 1.0] for t in texts])
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    own = V.exchanges(spark, d).select("id", F.col("user_message").alias("text"))
    return P.embed_exchanges(own, vectors, "id", 2).select("id", F.round(F.get("embedding", F.lit(0)), 6).alias("x"))


@query("""WITH v_own AS (SELECT *, CASE WHEN id % 4 = 0 THEN id END AS superseded_by FROM v_entries WHERE kind = 'instruction'), v_live AS (SELECT * FROM v_own WHERE status = 'active' AND superseded_by IS NULL),
v_of AS (SELECT o.id, CASE WHEN o.status = 'active' AND o.superseded_by IS NULL THEN o.id ELSE (SELECT min(l.id) FROM v_live l WHERE l.project = o.project AND l.slug = o.slug) END AS live FROM v_own o),
v_h AS (SELECT h, v_of.live FROM (SELECT h, max(id) AS id FROM (SELECT id AS h, id FROM v_own UNION ALL SELECT id + 1, id FROM v_own) GROUP BY 1) JOIN v_of USING (id) WHERE v_of.live IS NOT NULL)
SELECT DISTINCT least(x.live, y.live) AS a, greatest(x.live, y.live) AS b FROM lineitem JOIN v_h x ON x.h = l_partkey JOIN v_h y ON y.h = l_suppkey WHERE x.live <> y.live""")
def j17_live_conflict_pairs(spark, d):
    own = V.entries(spark, d).drop("version", "body").withColumn("superseded_by", F.when(F.col("id") % 4 == 0, F.col("id"))).withColumn("heuristic_ids", F.array("id", F.col("id") + 1))
    return P.live_conflict_pairs(V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), own)


@query("""WITH v_up AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY archive_path, line_start) AS seq, string_split(user_message, chr(10))[1] AS f, string_split(user_message, ' ') AS w FROM v_exchanges),
v_f AS (SELECT project, 'Facts:' || string_agg(chr(10) || '- ' || f, '' ORDER BY s) AS t FROM (SELECT project, f, min(seq) AS s FROM v_up GROUP BY 1, 2) GROUP BY 1),
v_c AS (SELECT project, 'Conventions:' || string_agg(chr(10) || '- ' || c, '' ORDER BY s) AS t FROM (SELECT project, c, min(s) AS s FROM (SELECT project, w[1] AS c, seq * 2 AS s FROM v_up UNION ALL SELECT project, w[2], seq * 2 + 1 FROM v_up) WHERE c IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
v_g AS (SELECT project, 'Glossary:' || string_agg(chr(10) || '- ' || k || ': ' || x, '' ORDER BY s) AS t FROM (SELECT project, w[1] AS k, min(seq) AS s, arg_max(f, seq) AS x FROM v_up GROUP BY 1, 2) GROUP BY 1)
SELECT project, CASE WHEN length(p) > 1500 THEN substr(p, 1, 1499) || '…' ELSE p END AS prose FROM (SELECT project, v_f.t || chr(10) || chr(10) || v_c.t || chr(10) || chr(10) || v_g.t AS p FROM v_f JOIN v_c USING (project) JOIN v_g USING (project))""")
def g17_merge_project_context(spark, d):
    words, first = F.split("user_message", " "), F.element_at(F.split("user_message", "\n"), 1)
    ex = V.exchanges(spark, d).withColumn("seq", F.struct("archive_path", "line_start"))
    return P.merge_project_context(ex.select("project", "seq", F.array(first).alias("facts"), F.slice(words, 1, 2).alias("conventions"),
                                             F.array(F.struct(F.get(words, F.lit(0)).alias("term"), first.alias("definition"))).alias("glossary")))
