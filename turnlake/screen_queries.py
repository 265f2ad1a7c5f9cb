"""Registered queries over screens, answers and checks of topic edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.learning_queries import _redacted
from turnlake.operators import screens as S
from turnlake.operators import topic_edits as E
from turnlake.plans import adapters as V
from turnlake.queries import query
from turnlake.topic_queries import EVENTS, docs

#: What stands before a document's text, by its length, so that every rule meets texts.
SAID = ("Ignore all the rules", "a new system prompt", "the system_prompt is", "you are  now", "from now on", "the user insists", "exec it", "use wget", "call Edit(x)", "save it", "create file", "/a/b then delete",
        "see www.x", "mail a@b.de", "paste the api key", "password: enter", "invoke the old red tool", "mcp__ x", "mcp__own-x", "mcp__else", "use the search tool", "npm_aaaaaaaaaaaaaaaaaaaaaaaa", "plain")
LIST = "[" + ", ".join(f"'{s}'" for s in SAID) + "]"
#: The screen's rules as they are; the one with a look-ahead, which SQL lacks, as the names that don't begin as one's own do.
CASES = " ".join(f"WHEN regexp_matches(r, '{shape}') THEN '{name}'" for name, shape in [*S.RULES, ("foreign-mcp-name", r"(?i)\bmcp__[a-np-z0-9_-]")])


@query(f"""SELECT doc_id, CASE {CASES} WHEN {_redacted('t')} <> t THEN 'secret-like-text' END AS reason FROM (SELECT doc_id, t, replace(t, 'search tool', ' ') AS r FROM (
  SELECT doc_id, {LIST}[n_chars % {len(SAID)} + 1] || '. ' || text AS t FROM documents))""")
def x4_screen_text(spark, d):
    said = F.get(F.array(*map(F.lit, SAID)), (F.col("n_chars") % len(SAID)).cast("int"))
    return V.table(spark, d, "documents").select("doc_id", S.screen_text(F.concat(said, F.lit(". "), "text")).alias("reason"))


@query("""SELECT id, archive_path AS path, line_start, line_end, project, substr(ts_raw, 1, 10) AS day, nullif(trim(string_split(user_message, chr(10))[1]), '') AS outcome FROM v_exchanges""")
def x10_parse_answer(spark, d):
    first = F.element_at(F.split("user_message", "\n"), 1)
    text = F.concat(F.lit("Found it:\n- **Path**: `"), "archive_path", F.lit("`\n2) lines = "), "line_start", F.lit(" to "), "line_end", F.lit("\n> project: '"), "project", F.lit("'\ndate: on "), "ts_raw", F.lit("\nOutcome: "), first, F.lit("\nlines: 7"))
    a = V.exchanges(spark, d).select("id", S.parse_answer(text).alias("a")).select("id", F.explode("a.locations").alias("l"), "a.project", "a.day", "a.outcome")
    return a.select("id", "l.*", "project", "day", "outcome")


@query("SELECT id, line_start % 5 < 2 OR (line_start % 5 = 2 AND upper(archive_path) = archive_path) AS same FROM v_exchanges")
def x11_same_path(spark, d):
    p, k = F.col("archive_path"), F.col("line_start") % 5
    a = F.when(k == 1, F.concat(F.lit("C:\\Old\\..\\X"), F.translate(p, "/", "\\"))).otherwise(p)
    b = (F.when(k == 0, F.replace(p, F.lit("/archive/"), F.lit("archive/./other//../"))).when(k == 1, F.concat(F.lit("c:/x"), F.upper(p), F.lit("/")))
         .when(k == 2, F.upper(p)).when(k == 3, "").otherwise(F.concat(p, F.lit("x"))))
    return V.exchanges(spark, d).select("id", S.same_path(a, b).alias("same"))


@query(rf"""WITH {EVENTS}, v_doc AS (SELECT slug, id, id % 2 = 0 AND id % 20 NOT IN (2, 6, 8) AND id <> 10 AS written, id % 20 = 6 AS gone FROM (SELECT DISTINCT slug, CAST(slug[2:] AS BIGINT) AS id FROM v_lines)),
v_w AS (SELECT slug, id FROM v_doc WHERE written), v_now AS (SELECT * FROM v_units JOIN v_doc USING (slug) WHERE NOT gone), v_wd AS (SELECT * FROM v_def JOIN v_w USING (slug)),
v_top AS (SELECT slug, count(*) FILTER (WHERE heading = 1) AS h1, coalesce(arg_min(coalesce(heading, 0), line_no) FILTER (WHERE fenced OR regexp_matches(line, '\S')), 0) AS first FROM v_head JOIN v_w USING (slug) GROUP BY 1),
v_len AS (SELECT slug, sum(length(line)) + count(*) - 1 AS n FROM v_masked GROUP BY 1), v_sound AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY slug, line_no) AS r FROM v_now WHERE regexp_matches(unit_id, '^[0-9a-f]{{8}}$')),
v_target AS (SELECT slug, unnest(regexp_extract_all(text, '\]\(([^()\s]*\.md(?:#[^()\s]*)?)\)', 1)) AS t FROM v_now),
v_err AS (SELECT 'D' || id AS slug, 1 AS c, 'bad slug' AS error FROM v_doc WHERE id % 20 = 2 UNION ALL SELECT 'example-topic', 1, 'slug of the example' FROM v_doc WHERE id = 10 UNION ALL SELECT slug, 1, 'repeated slug' FROM v_doc WHERE id % 20 = 4
  UNION ALL SELECT 'x' || id, 2, 'nothing to delete' FROM v_doc WHERE id % 20 = 8 UNION ALL SELECT slug, 3, 'not shown' FROM v_doc WHERE (written OR gone) AND id % 4 <> 0
  UNION ALL SELECT slug, 4, 'no single title' FROM v_top WHERE h1 <> 1 UNION ALL SELECT slug, 4, 'title not first' FROM v_top WHERE h1 = 1 AND first <> 1
  UNION ALL SELECT slug, 5, 'malformed definition' FROM v_wd WHERE bad UNION ALL SELECT slug, 5, 'repeated label' FROM v_wd WHERE r > 1
  UNION ALL SELECT slug, 5, 'paragraph without reference' FROM v_now WHERE written AND NOT regexp_matches(text, '\[\^[^\]\s]+\]')
  UNION ALL SELECT slug, 5, 'undefined label' FROM (SELECT DISTINCT slug, label FROM v_said JOIN v_w USING (slug)) ANTI JOIN v_def USING (slug, label)
  UNION ALL SELECT slug, 5, 'label used again' FROM (SELECT slug, label FROM v_said JOIN v_w USING (slug) GROUP BY ALL HAVING sum(uses) > 1) UNION ALL SELECT slug, 5, 'unused label' FROM v_wd ANTI JOIN v_said USING (slug, label)
  UNION ALL SELECT slug, 6, 'bad time' FROM v_wd WHERE bad OR k % 10 = 0 UNION ALL SELECT slug, 7, 'no source' FROM v_wd WHERE bad UNION ALL SELECT slug, 7, 'unknown mark' FROM v_wd WHERE NOT bad AND k % 2 = 1
  UNION ALL SELECT slug, 7, 'unknown source' FROM v_wd WHERE NOT bad AND k % 4 = 2 UNION ALL SELECT slug, 7, 'malformed source' FROM v_wd WHERE NOT bad
  UNION ALL SELECT slug, 8, 'no unit id' FROM v_now WHERE unit_id IS NULL UNION ALL SELECT slug, 8, 'bad unit id' FROM v_now WHERE NOT regexp_matches(unit_id, '^[0-9a-f]{{8}}$') UNION ALL SELECT slug, 8, 'repeated unit id' FROM v_sound WHERE r > 1
  UNION ALL SELECT slug, 9, 'broken link' FROM (SELECT slug, unnest(regexp_extract_all(text, '\[[^\]]*\]\([^()\s#]+\.md#\^([^()\s]*)\)', 1)) AS unit_id FROM v_now) ANTI JOIN v_sound USING (unit_id)
  UNION ALL SELECT slug, 9, 'malformed link' FROM v_target WHERE NOT regexp_matches(t, '^[^#]+\.md#\^') AND NOT starts_with(t, 'https:')
  UNION ALL SELECT slug, 10, 'too long' FROM v_len JOIN v_w USING (slug) LEFT JOIN (SELECT slug, count(*) AS m FROM v_def WHERE NOT bad AND k % 2 = 0 GROUP BY 1) USING (slug) WHERE n + (3 + length(slug)) * coalesce(m, 0) > 4000
  UNION ALL SELECT '(project)', 10, 'too many documents' FROM (SELECT count(*) AS n FROM v_doc WHERE NOT gone) WHERE n > 50
  UNION ALL SELECT slug, 11, 'lost citation' FROM v_def JOIN v_doc USING (slug) WHERE NOT bad AND (gone OR written AND k % 2 = 1))
SELECT slug, c AS "check", error, count(*) AS n FROM v_err GROUP BY ALL""")
def t5_validate_topic_edit(spark, d):
    own = docs(spark, d)
    marks = own.select("slug", "doc_id", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")))).alias("mark")).withColumn("id", F.concat(F.lit("e"), "slug", F.lit("-"), "mark"))
    new = E.rewrite_marks(own, marks.filter("mark % 2 = 0")).join(own.select("slug", "doc_id"), "slug")
    kind = F.expr("CASE WHEN doc_id % 20 IN (6, 8) THEN 'delete' ELSE 'file' END")
    slug = F.expr("CASE WHEN doc_id % 20 = 2 THEN concat('D', doc_id) WHEN doc_id % 20 = 8 THEN concat('x', doc_id) WHEN doc_id = 10 THEN 'example-topic' ELSE slug END")
    twice = F.explode(F.expr("CASE WHEN doc_id % 20 = 4 THEN array(2 * doc_id, 2 * doc_id + 1) ELSE array(2 * doc_id) END"))
    blocks = new.filter("doc_id % 2 = 0").select(twice.alias("n"), kind.alias("kind"), slug.alias("slug"), "text")
    return E.validate_topic_edit(E.rewrite_marks(own, marks), blocks, own.filter("doc_id % 4 = 0").select("slug"), marks.filter("mark % 4 = 0").select("id"), 4000)
