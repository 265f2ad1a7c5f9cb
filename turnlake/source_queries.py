"""Registered queries over raw transcript lines in both dialects, which Spark derives from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlake.operators import assemble as M
from turnlake.operators import render
from turnlake.plans import adapters as V
from turnlake.queries import query
from turnlake.sources import transcripts as R


def raw_lines(spark, d, rich=False):
    """Lines (path, project, line_no, raw) of every conversation: even ones in the first dialect, with blank and malformed lines,
    odd ones in the second; every assistant turn calls a tool, and the following turn or line has the result. Rich ones have
    sidechains and token usage."""
    conv, turn, role, text = (F.col(c) for c in ("conv_id", "turn", "role", "text"))
    s = lambda **k: F.to_json(F.struct(*[(v if not isinstance(v, (str, int)) else F.lit(v)).alias(n) for n, v in k.items()]))
    st = lambda **k: F.struct(*[(v if not isinstance(v, (str, int)) else F.lit(v)).alias(n) for n, v in k.items()])
    line = lambda no, raw: F.struct(no.cast("int").alias("line_no"), raw.alias("raw"))
    none = F.lit(None).cast("string")
    path = F.concat(F.lit("/archive/p"), conv % 7, F.lit("/"), conv, F.lit(".jsonl"))
    use = lambda t: F.concat(F.lit("c"), conv, F.lit("-"), t)
    block = lambda kind, **k: F.struct(F.lit(kind).alias("type"), *[k.get(n, none).alias(n) for n in ("text", "id", "name", "tool_use_id", "content")], k.get("is_error", F.lit(None).cast("boolean")).alias("is_error"))
    said = F.when(role == "user", F.array(block("text", text=text), block("tool_result", tool_use_id=use(turn - 1), content=F.concat(F.lit("done "), turn), is_error=turn % 4 == 0))).otherwise(
        F.array(block("text", text=text), block("tool_use", id=use(turn), name=F.lit("Read"))))
    ts = F.concat(F.lit("2024-01-01T00:00:"), F.lpad(turn.cast("string"), 2, "0"), F.lit("Z"))
    common = {"type": role, "sessionId": F.concat(F.lit("s"), conv), "timestamp": ts}
    usage = F.when(role == "assistant", st(input_tokens=turn * 1000 + 234, cache_read_input_tokens=F.when(turn >= 3, turn * 1500), output_tokens=turn))
    more = {"usage": usage} if rich else {}
    if rich:
        common["isSidechain"] = (conv % 3 == 0) & turn.isin(2, 3)
    first = F.when(turn == 0, s(**common, message=st(role=role, content=text, **more))).otherwise(s(**common, message=st(role=role, content=said, **more)))
    claude = F.array(line(2 * turn + 2, first), line(2 * turn + 3, F.when(turn % 2 == 0, "").otherwise("{broken")))
    response = lambda p: s(type="response_item", timestamp=ts, payload=p)
    codex = F.filter(F.array(
        line(4 * turn + 2, F.when(role == "user", s(type="turn_context", payload=st(model=F.when(turn % 4 == 0, "").otherwise(F.concat(F.lit("m"), turn % 3)))))),
        line(4 * turn + 3, response(st(type="message", role=role, content=F.array(st(type="output_text", text=text))))),
        line(4 * turn + 4, F.when(role == "assistant", response(st(type="function_call", name="shell", call_id=use(turn), arguments=F.concat(F.lit('{"n": '), turn, F.lit("}")))))),
        line(4 * turn + 5, F.when(role == "assistant", response(st(type="function_call_output", call_id=use(turn), output=F.concat(F.lit("out "), turn)))))), lambda x: x["raw"].isNotNull())
    c = V.table(spark, d, "conversations")
    body = c.select(path.alias("path"), F.concat(F.lit("p"), conv % 7).alias("project"), F.explode(F.when(conv % 2 == 0, claude).otherwise(codex)).alias("l"))
    meta = s(type="session_meta", payload=st(id=F.concat(F.lit("s"), conv), cwd=F.concat(F.lit("/w/q"), conv % 5), cli_version="1.0", git=st(branch="main")))
    head = c.select("conv_id").distinct().select(path.alias("path"), F.concat(F.lit("p"), conv % 7).alias("project"), line(F.lit(1), F.when(conv % 2 == 0, s(type="summary", summary="x")).otherwise(meta)).alias("l"))
    return head.unionByName(body).select("path", "project", "l.line_no", "l.raw")


def _part(spark, d, harness):
    lines = raw_lines(spark, d)
    return lines.join(R.detect_harness(lines).filter(F.col("harness") == harness), "path", "left_semi")


PATH = "'/archive/p' || (conv_id % 7) || '/' || conv_id || '.jsonl'"
SAID = "role IN ('user', 'assistant') AND trim(text) <> ''"
CLAUDE = f"""(SELECT md5(p || ':' || s || '-' || e) AS id, * FROM (SELECT {PATH} AS p, conv_id, s, max(2 * turn + 2) FILTER (role = 'assistant') AS e, max(text) FILTER (role = 'user') AS u,
  string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant') AS a FROM (SELECT *, max(CASE WHEN role = 'user' THEN 2 * turn + 2 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s
  FROM conversations WHERE {SAID} AND conv_id % 2 = 0) WHERE s IS NOT NULL GROUP BY conv_id, s) WHERE e IS NOT NULL)"""
ROWS = f"""(SELECT conv_id, 4 * turn + 2 AS n, 'meta' AS kind, NULL AS text, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'm' || (turn % 3) END AS model FROM conversations WHERE conv_id % 2 = 1 AND role = 'user'
  UNION ALL SELECT conv_id, 4 * turn + 3, role, text, NULL FROM conversations WHERE conv_id % 2 = 1 AND {SAID}
  UNION ALL SELECT conv_id, 4 * turn + 5, 'tool', NULL, NULL FROM conversations WHERE conv_id % 2 = 1 AND role = 'assistant')"""
CODEX = f"""(SELECT md5(p || ':' || s || '-' || e) AS id, * FROM (SELECT {PATH} AS p, conv_id, s, max(n) FILTER (kind IN ('assistant', 'tool')) AS e, max(text) FILTER (kind = 'user') AS u,
  string_agg(text, chr(10) || chr(10) ORDER BY n) FILTER (kind = 'assistant') AS a, arg_max(m, n) AS model FROM (SELECT *, max(CASE WHEN kind = 'user' THEN n END) OVER w AS s,
  last_value(model IGNORE NULLS) OVER w AS m FROM {ROWS} WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING)) WHERE s IS NOT NULL GROUP BY conv_id, s) WHERE a IS NOT NULL)"""


@query(f"SELECT DISTINCT {PATH} AS path, CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS harness FROM conversations")
def s3_detect_harness(spark, d):
    return R.detect_harness(raw_lines(spark, d))


@query("SELECT archive_path, line_start FROM v_exchanges WHERE project NOT IN ('p1', 'p4')")
def s2_exclude_projects(spark, d):
    names = V.table(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("project")).filter("project IN ('p1', 'p4')")
    return R.exclude_projects(V.exchanges(spark, d), names).select("archive_path", "line_start")


@query(f"SELECT DISTINCT {PATH} AS path FROM conversations WHERE role IN ('user', 'assistant') AND (contains(text, 'tion') OR contains(text, 'the'))")
def s6_find_marked_files(spark, d):
    return R.find_marked_files(raw_lines(spark, d), ("tion", "the"))


@query(f"SELECT id, p AS archive_path, u AS user_message, a AS assistant_message, s AS line_start, e AS line_end FROM {CLAUDE}")
def a5_raw_exchanges(spark, d):
    return M.assemble_exchanges(R.claude_messages(_part(spark, d, "claude"))).select("id", "archive_path", "user_message", "assistant_message", "line_start", "line_end")


@query(f"SELECT id, p AS archive_path, 'q' || (conv_id % 5) AS project, 's' || conv_id AS session_id, u AS user_message, a AS assistant_message, s AS line_start, e AS line_end, model FROM {CODEX}")
def a2_codex_exchanges(spark, d):
    return R.assemble_codex(R.codex_records(_part(spark, d, "codex"))).select("id", "archive_path", "project", "session_id", "user_message", "assistant_message", "line_start", "line_end", "model")


CALL = """CASE WHEN n.role = 'user' THEN 'done ' || n.turn END AS tool_result, coalesce(n.role = 'user' AND n.turn % 4 = 0, false) AS is_error"""


@query(f"""SELECT 'c' || c.conv_id || '-' || c.turn AS id, x.id AS exchange_id, 'Read' AS tool_name, {CALL} FROM (SELECT *, max(CASE WHEN role = 'user' AND trim(text) <> '' THEN 2 * turn + 2 END)
  OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) c JOIN {CLAUDE} x ON x.conv_id = c.conv_id AND x.s = c.s LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
  WHERE c.role = 'assistant' AND c.turn > 0""")
def a3_tool_calls(spark, d):
    messages = R.claude_messages(_part(spark, d, "claude"))
    return R.extract_tool_calls(messages, M.assemble_exchanges(messages)).drop("tool_input")


@query(f"""SELECT 'c' || c.conv_id || '-' || turn AS id, x.id AS exchange_id, 'shell' AS tool_name, '{{"n":' || turn || '}}' AS tool_input, 'out ' || turn AS tool_result FROM (SELECT *,
  max(CASE WHEN role = 'user' AND trim(text) <> '' THEN 4 * turn + 3 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) c JOIN {CODEX} x ON x.conv_id = c.conv_id AND x.s = c.s WHERE c.role = 'assistant'""")
def a4_codex_tool_calls(spark, d):
    records = R.codex_records(_part(spark, d, "codex"))
    return R.extract_codex_tool_calls(records, R.assemble_codex(records)).drop("is_error")


LABEL = "CASE WHEN side THEN CASE role WHEN 'user' THEN 'Agent' ELSE 'Subagent' END WHEN role = 'user' THEN 'User' ELSE 'Agent' END"
RULE, NL = "chr(10) || '---' || chr(10)", "chr(10)"
STAMP = "'(1/1/2024, 12:00:' || lpad(turn::VARCHAR, 2, '0') || ' AM) {#'"
FIRST = f"""SELECT {PATH} AS path, '# Conversation' || {NL} || {NL} || '## Metadata' || {NL} || {NL} || '**Session ID:** s' || conv_id || {NL} || {NL} || '---' || {NL} || {NL} || '## Messages' || {NL} || {NL}
  || string_agg(CASE WHEN side AND NOT was THEN {RULE} || '**🔀 SIDECHAIN START**' || {RULE} || {NL} WHEN was AND NOT side THEN {RULE} || '**🔀 SIDECHAIN END**' || {RULE} || {NL} ELSE '' END
    || '### **' || {LABEL} || '** ' || {STAMP} || 'msg-' || i || '}}' || {NL} || {NL} || text || {NL} || {NL}
    || CASE WHEN role = 'assistant' AND turn > 0 THEN '**Tool Use:** `Read`' || {NL} || {NL} || CASE WHEN next = 'user' THEN '**Result:**' || {NL} || 'done ' || (turn + 1) || {NL} || {NL} ELSE '' END ELSE '' END
    || CASE WHEN role = 'assistant' THEN '_in: ' || format('{{:,}}', turn * 1000 + 234) || CASE WHEN turn >= 3 THEN ' | cache read: ' || format('{{:,}}', turn * 1500) ELSE '' END || ' | out: ' || turn || '_' || {NL} || {NL} ELSE '' END, '' ORDER BY turn)
  || CASE WHEN arg_max(side, turn) THEN {RULE} || '**🔀 SIDECHAIN END**' || {RULE} || {NL} ELSE '' END AS markdown
  FROM (SELECT *, conv_id % 3 = 0 AND turn IN (2, 3) AS side, coalesce(lag(conv_id % 3 = 0 AND turn IN (2, 3)) OVER w, false) AS was, row_number() OVER w - 1 AS i, lead(role) OVER w AS next
    FROM conversations WHERE conv_id % 2 = 0 AND role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id"""
SECOND = f"""SELECT {PATH}, '# Conversation' || {NL} || {NL} || '## Metadata' || {NL} || {NL} || '**Harness:** Codex' || {NL} || {NL} || '**Session ID:** s' || conv_id || {NL} || {NL} || '**Git Branch:** main' || {NL} || {NL}
  || '**Working Directory:** /w/q' || (conv_id % 5) || {NL} || {NL} || '**Codex Version:** 1.0' || {NL} || {NL} || coalesce('**Model:** m' || (max(turn) FILTER (WHERE role = 'user' AND turn % 4 <> 0) % 3) || {NL} || {NL}, '')
  || '---' || {NL} || {NL} || '## Messages' || {NL} || {NL}
  || string_agg('### **' || CASE role WHEN 'user' THEN 'User' ELSE 'Agent' END || '** ' || {STAMP} || 'msg-' || (1 + before + (role = 'user')::INT) || '}}' || {NL} || {NL} || text || {NL} || {NL}
    || CASE WHEN role = 'assistant' THEN '### **Tool Use** ' || {STAMP} || 'c' || conv_id || '-' || turn || '}}' || {NL} || {NL} || '**Tool Use:** `shell`' || {NL} || {NL} || '- **n:**' || {NL} || '```json' || {NL} || turn || {NL} || '```' || {NL} || {NL}
      || '### **Tool Result** ' || {STAMP} || 'c' || conv_id || '-' || turn || '-result}}' || {NL} || {NL} || '**Result:**' || {NL} || 'out ' || turn || {NL} || {NL} ELSE '' END, '' ORDER BY turn)
  FROM (SELECT *, coalesce(sum(CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM conversations WHERE conv_id % 2 = 1) GROUP BY conv_id"""


@query(f"{FIRST} UNION ALL {SECOND}".replace("}}", "}").replace("{{", "{"))
def s12_render_conversations(spark, d):
    return render.whole_conversations(render.render_conversations(raw_lines(spark, d, rich=True), 700))
