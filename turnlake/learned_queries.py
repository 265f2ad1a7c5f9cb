"""Registered queries over learned entries on their way out, with their SQL; entries are made from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.learning_queries import _redacted
from turnlake.operators import learned as L
from turnlake.operators.learning import redact_secrets
from turnlake.plans import adapters as V
from turnlake.queries import query
from turnlake.screen_queries import CASES, LIST, SAID

ROOM = 900 - len(L.OPEN) - len(L.NOTICE) - len(L.CLOSE) - 3
NL = "chr(10)"
ENTRIES = f"""v_e AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '*' ELSE source END AS project, ['instruction', 'skill'][doc_id // 4 % 2 + 1] AS kind, CASE WHEN doc_id % 11 = 0 THEN 'Bad slug' WHEN doc_id % 17 = 0 THEN 'com1' ELSE 'k' || doc_id END AS slug,
  CASE WHEN doc_id % 5 = 3 THEN 'retired' ELSE 'active' END AS status, doc_id % 13 = 5 AS old, ['low', 'medium', 'high', 'sure'][doc_id // 2 % 4 + 1] AS confidence, doc_id % 3 + 1 AS version,
  {LIST}[n_chars % {len(SAID)} + 1] || ' ' || left(text, 20) AS description, CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE lang END AS scope, text, md5(doc_id::VARCHAR) AS mark, md5((doc_id + 1)::VARCHAR) AS next FROM documents WHERE text IS NOT NULL),
v_live AS (SELECT * FROM v_e WHERE status = 'active' AND NOT old)"""


def screened(rows: str, line: str = "line") -> str:
    """Rows whose text in column `line` the screen lets through."""
    return f"(SELECT * EXCLUDE (r) FROM (SELECT *, replace({line}, 'search tool', ' ') AS r FROM {rows}) WHERE (CASE {CASES} WHEN {_redacted(line)} <> {line} THEN 's' END) IS NULL)"


def bodied(rows: str, body: str) -> str:
    """Lines of a body with their place, trimmed and redacted."""
    return f"""(SELECT * REPLACE ({_redacted('line')} AS line) FROM (SELECT * REPLACE (regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line) FROM (SELECT *, unnest(string_split({body}, chr(10))) AS line, generate_subscripts(string_split({body}, chr(10)), 1) AS pos FROM {rows})) WHERE line <> '')"""


def docs(spark, d):
    return V.table(spark, d, "documents").filter("text IS NOT NULL")


def mark(n):
    return F.md5(n.cast("string"))


def skill_body():
    """The text, and behind it a line that cites two exchanges."""
    return F.concat("text", F.lit("\nsee [#"), mark(F.col("doc_id")), F.lit(",#"), mark(F.col("doc_id") + 1), F.lit("]"))


def entries(spark, d):
    i, pick = F.col("doc_id"), lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    kind = pick(("instruction", "skill"), F.floor(i / 4) % 2)
    hints = F.array_join(F.transform(F.split("text", "\n"), lambda x, k: F.concat(F.lit("absent: "), x, F.lit(" [@"), k + 1, F.lit("]"))), "\n")
    return docs(spark, d).select(
        i.alias("id"), F.when(i % 4 == 0, "*").otherwise(F.col("source")).alias("project"), kind.alias("kind"), F.when(i % 11 == 0, "Bad slug").when(i % 17 == 0, "com1").otherwise(F.concat(F.lit("k"), i)).alias("slug"),
        F.when(i % 5 == 3, "retired").otherwise("active").alias("status"), F.when(i % 13 == 5, i + 1).alias("superseded_by"), pick(("low", "medium", "high", "sure"), F.floor(i / 2) % 4).alias("confidence"),
        (i % 3 + 1).alias("version"), F.concat(pick(SAID, F.col("n_chars") % len(SAID)), F.lit(" "), F.substring("text", 1, 20)).alias("description"), F.when(i % 19 == 0, " ").otherwise(F.col("lang")).alias("scope"),
        F.when(kind == "instruction", hints).otherwise(skill_body()).alias("body"), F.concat(F.lit("r"), i % 3).alias("run_id"))


def cited(spark, d):
    """An exchange for each document whose id is no multiple of 7."""
    return docs(spark, d).filter("doc_id % 7 > 0").select(mark(F.col("doc_id")).alias("id"), F.concat(F.lit("/a/"), "source", F.lit("/"), "doc_id").alias("archive_path"), (F.col("doc_id") % 7 + 1).alias("line_start"),
                                                         (F.col("doc_id") % 7 + 4).alias("line_end"), F.lit("s").alias("session_id"), "text")


HINTS = f"""v_ok AS (SELECT project, 0 AS section, slug, id, pos, line FROM {screened(bodied("(SELECT *, array_to_string(list_transform(string_split(text, chr(10)), lambda x, k: 'absent: ' || x || ' [@' || k || ']'), chr(10)) AS body FROM v_live WHERE kind = 'instruction')", "body"))}
    WHERE regexp_matches(regexp_replace(line, '\\[(?:#|@)[^\\]]*\\]\\s*$', ''), '^absent:\\s*\\S')
  UNION ALL SELECT project, 2, slug, id, 0, line FROM {screened("(SELECT *, " + _redacted("slug || ': ' || description || ' (' || confidence || ', v' || version || ')'") + " AS line FROM v_live WHERE kind = 'skill')")})"""


@query(f"""WITH {ENTRIES}, {HINTS}, v_p AS (SELECT DISTINCT project FROM v_live),
v_b AS (SELECT p.project, section, (l.project = '*')::INT AS far, slug, id, pos, line FROM v_p p JOIN v_ok l ON l.project = p.project OR l.project = '*'),
v_all AS (SELECT *, length(line) + 1 AS cost FROM (SELECT * FROM v_b UNION ALL SELECT DISTINCT project, 1, 0, '', 0, 0, '{L.SKILLS}' FROM v_b WHERE section = 2)),
v_used AS (SELECT *, sum(cost) OVER (PARTITION BY project ORDER BY section, far, slug, id, pos ROWS UNBOUNDED PRECEDING) AS used FROM v_all)
SELECT project, '{L.OPEN}' || {NL} || '{L.NOTICE}' || {NL} || coalesce(string_agg(line || {NL}, '' ORDER BY used) FILTER (WHERE used <= {ROOM}), '') || '```' || {NL} AS text FROM v_p LEFT JOIN v_used USING (project) GROUP BY project""")
def k1_learned_blocks(spark, d):
    return L.render_learned_blocks(entries(spark, d), 900, redact_secrets)


@query(f"""WITH v_t AS (SELECT 's' || doc_id AS project, CASE WHEN doc_id % 3 = 0 THEN '{L.OPEN}' || {NL} || 'shared' || {NL} || 'use wget' ELSE '{L.OPEN}' || {NL} || '{L.NOTICE}' || {NL} || text || {NL} || '```' || {NL} || 'behind' END AS text FROM documents WHERE text IS NOT NULL),
v_l AS (SELECT project, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM v_t),
v_in AS (SELECT * FROM v_l l WHERE line <> '' AND line <> 'behind' AND line <> '```'),
v_ok AS (SELECT project, pos, line FROM v_in WHERE line IN ('{L.OPEN}', '{L.NOTICE}') OR trim(line) = '' UNION ALL SELECT project, pos, line FROM {screened("(SELECT project, pos, " + _redacted("line") + f" AS line FROM v_in WHERE line NOT IN ('{L.OPEN}', '{L.NOTICE}') AND trim(line) <> '')")}),
v_used AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY project ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM v_ok)
SELECT project, string_agg(line, {NL} ORDER BY pos) || {NL} || '```' || {NL} AS text FROM v_used WHERE used <= 596 GROUP BY project""")
def k2_read_learned_blocks(spark, d):
    """Blocks of whole texts, as an editor might leave them; every third project has none and reads the shared one."""
    project = F.concat(F.lit("s"), "doc_id").alias("project")
    own = docs(spark, d).filter("doc_id % 3 > 0").select(project, F.concat(F.lit(f"{L.OPEN}\n{L.NOTICE}\n"), "text", F.lit(f"\n{L.CLOSE}\nbehind")).alias("text"))
    shared = spark.createDataFrame([("*", f"{L.OPEN}\nshared\nuse wget")], "project string, text string")
    return L.read_learned_blocks(own.unionByName(shared), docs(spark, d).select(project), 600, redact_secrets)


@query(f"""WITH {ENTRIES}, {HINTS}, v_n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY slug, id) AS r FROM v_ok WHERE section = 2)),
v_b AS (SELECT p.project, id, line, row_number() OVER (PARTITION BY p.project ORDER BY v.project = '*', slug, id) AS rank FROM (SELECT DISTINCT source AS project FROM documents WHERE text IS NOT NULL) p JOIN v_n v ON v.project = p.project OR v.project = '*')
SELECT project, rank, id, line FROM v_b WHERE rank <= 25""")
def k3_list_skills(spark, d):
    return L.list_skills(entries(spark, d), docs(spark, d).select(F.col("source").alias("project")), 25, redact_secrets)


def parts(named: bool) -> str:
    """Views of skills' fields: v_f with fields, v_w with the ids of those that a field withholds, v_k with bodies."""
    label = (lambda c: f"'{c}: ' || ") if named else (lambda c: "")
    sources = "coalesce((SELECT string_agg('/a/' || x.source || '/' || x.doc_id || ':' || (x.doc_id % 7 + 1) || '-' || (x.doc_id % 7 + 4), '; ' ORDER BY md5(x.doc_id::VARCHAR)) FROM documents x WHERE x.text IS NOT NULL AND x.doc_id % 7 > 0 AND x.doc_id IN (s.id, s.id + 1)), 'none')"
    return f"""v_s AS (SELECT * FROM v_live WHERE kind = 'skill'),
v_f AS (SELECT id, project, slug, confidence, version, {_redacted(label('description') + 'description')} AS description, {_redacted(label('scope') + 'scope')} AS scope, {_redacted(label('sources') + sources)} AS sources FROM v_s s),
v_d AS (SELECT id FROM {screened('v_f', 'description')}), v_c AS (SELECT id FROM {screened('v_f', 'scope')}), v_o AS (SELECT id FROM {screened('v_f', 'sources')}),
v_k AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS body FROM {screened(bodied("(SELECT id, text || chr(10) || 'see [#' || mark || ',#' || next || ']' AS body FROM v_s)", "body"))} GROUP BY id)"""


@query(f"""WITH {ENTRIES}, {parts(True)} SELECT f.id, CASE WHEN d.id IS NOT NULL AND c.id IS NOT NULL AND o.id IS NOT NULL AND body IS NOT NULL THEN '---' || {NL} || 'name: ' || slug || {NL} || description || {NL} || scope || {NL} || sources || {NL}
  || 'confidence: ' || confidence || {NL} || 'version: ' || version || {NL} || '---' || {NL} || {NL} || body || {NL} END AS text FROM v_f f LEFT JOIN v_d d USING (id) LEFT JOIN v_c c USING (id) LEFT JOIN v_o o USING (id) LEFT JOIN v_k USING (id)""")
def k3_render_skills(spark, d):
    return L.render_skills(entries(spark, d), cited(spark, d), redact_secrets)


@query(f"""WITH {ENTRIES}, {parts(False)}, v_j AS (SELECT f.*, CASE WHEN project = '*' THEN '_global' ELSE project END AS folder, d.id IS NOT NULL AND c.id IS NOT NULL AND o.id IS NOT NULL AND body IS NOT NULL AS good, slug <> 'Bad slug' AND slug <> 'com1' AS named, body
  FROM v_f f LEFT JOIN v_d d USING (id) LEFT JOIN v_c c USING (id) LEFT JOIN v_o o USING (id) LEFT JOIN v_k USING (id))
SELECT id, CASE WHEN good AND named THEN folder || '/' || slug || '/SKILL.md' END AS relative_path, CASE WHEN good AND named THEN '---' || {NL} || 'name: ' || slug || {NL} || 'description: ' || to_json(description) || {NL} || 'metadata:' || {NL} || '  scope: ' || to_json(scope) || {NL}
  || '  confidence: ' || confidence || {NL} || '  sources: ' || to_json(sources) || {NL} || '  version: ' || version || {NL} || '  run: "r' || (id % 3) || '"' || {NL} || '---' || {NL} || {NL} || body || {NL} END AS text,
  CASE WHEN NOT named THEN 'skipped' WHEN NOT good THEN 'withheld' END AS warning FROM v_j""")
def s11_export_skills(spark, d):
    return L.export_skills(entries(spark, d), cited(spark, d), redact_secrets).withColumn("warning", F.regexp_extract("warning", r"^(\w+)", 1))


#: Steps by the remainder of the id: none, good ones, an unknown action, a parameter that is no string, no list, no JSON.
STEPS = ('[]', '[{"action": "search", "parameters": {"q": "x"}}, {"action": "check", "parameters": {}}]', '[{"action": "run", "parameters": {}}]', '[{"action": "read", "parameters": {"n": 1}}]', '{"action": "read"}', "[{")


@query(f"""WITH {ENTRIES}, v_body AS (SELECT id, pos, {_redacted('line')} AS line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM v_e)),
v_said AS (SELECT id, pos, trim(regexp_replace(regexp_replace(line, '^\\s*(?:[-*•]\\s+)?', ''), '\\s+$', '')) AS line, line AS whole FROM v_body),
v_g AS (SELECT id, string_agg(line || ' [#' || md5(id::VARCHAR) || ']', {NL} ORDER BY pos) AS body FROM v_said WHERE line <> '' AND id % 7 > 0 AND len(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]{{4,}}'))) >= 3 GROUP BY id),
v_x AS (SELECT e.id, slug, confidence, {_redacted('description')} AS description, {_redacted('scope')} AS scope, body FROM v_e e LEFT JOIN v_g USING (id)),
v_1 AS (SELECT id FROM {screened('v_x', 'description')}), v_2 AS (SELECT id FROM {screened('v_x', 'body')})
SELECT x.id, CASE WHEN slug = 'Bad slug' OR slug = 'com1' THEN 'invalid-slug' WHEN body IS NULL THEN 'no-cited-lines' WHEN a.id IS NULL OR b.id IS NULL THEN 'screen' WHEN trim(scope) = '' THEN 'empty-scope' WHEN confidence = 'sure' THEN 'invalid-confidence'
  WHEN x.id % 7 IN (3, 4, 5, 6) THEN 'invalid-steps' END AS reason, CASE WHEN slug <> 'Bad slug' AND slug <> 'com1' AND body IS NOT NULL AND a.id IS NOT NULL AND b.id IS NOT NULL AND trim(scope) <> '' AND confidence <> 'sure' AND x.id % 7 IN (0, 1, 2) THEN body END AS body
FROM v_x x LEFT JOIN v_1 a USING (id) LEFT JOIN v_2 b USING (id)""")
def x9_gate_proposals(spark, d):
    i = F.col("doc_id")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(x) == "", x).otherwise(F.concat(x, F.lit(" [#"), mark(F.col("doc_id")), F.lit("]")))), "\n")
    steps = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, STEPS)), (i % 7).cast("int"))
    e = entries(spark, d).select("id", "slug", F.lit("title").alias("title"), "description", "scope", "confidence")
    p = e.join(docs(spark, d).select(i.alias("id"), body.alias("body"), steps.alias("steps")), "id").withColumn("kind", F.lit("skill"))
    out = L.gate_proposals(p, cited(spark, d).select("id", "text"), V.attempts(spark, d).select("id"), redact=redact_secrets)
    own = ("invalid-slug", "no-cited-lines", "empty-scope", "invalid-confidence", "invalid-steps")
    return out.select("id", F.when(F.col("reason").isNull() | F.col("reason").isin(*own), F.col("reason")).otherwise("screen").alias("reason"), "body")
