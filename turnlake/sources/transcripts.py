"""Raw transcript files (JSON lines in two dialects) to lines, messages, exchanges and tool calls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.operators.assemble import exchange_id

#: The record types that mark the second dialect, and its call and output records.
CODEX_TYPES = ("session_meta", "turn_context", "response_item", "event_msg", "compacted")
CALLS = ("function_call", "custom_tool_call", "tool_search_call", "local_shell_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "tool_search_output", "local_shell_call_output")


def read_transcripts(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Path (below root), project (its first folder), line_no (from 1, blank lines count) and raw of all *.jsonl files.

    Files are split as Spark splits text, so a file is never one row; a folder named in `excluded` is left out at any depth.
    """
    base = root.rstrip("/") + "/"
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(base)
    # within a split rows come in the order of the file, and so do their increasing ids
    found = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), "^[a-z]+:(//[^/]*)?/+", "/")
    below = F.substring(plain, F.lit(len(re.sub("^[a-z]+:(//[^/]*)?/+", "/", base)) + 1), F.char_length(plain))
    parts = F.split(below, "/")
    rows = found.withColumn("path", below).withColumn("project", F.when(F.size(parts) > 1, parts[0]).otherwise(""))
    if excluded:
        folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
        rows = rows.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, excluded))))
    order = Window.partitionBy("path").orderBy("block", "at")
    return rows.select("path", "project", F.row_number().over(order).alias("line_no"), F.col("value").alias("raw"))


def exclude_projects(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose project is none of `names` (project), by exact name."""
    return df.join(names.select("project").distinct(), "project", "left_anti")


def _json(lines: DataFrame) -> DataFrame:
    """Lines that parse, as a variant `v`; blank and malformed lines and a bare null are left out."""
    parsed = lines.filter(F.trim("raw") != "").withColumn("v", F.try_parse_json("raw"))
    return parsed.filter(F.col("v").isNotNull() & ~F.is_variant_null("v"))


def _get(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def detect_harness(lines: DataFrame) -> DataFrame:
    """S3: path, harness of every path by its first line that parses; without one it is the first dialect."""
    payload = F.coalesce(_get("$.payload"), F.lit(""))
    second = _get("$.type").isin(*CODEX_TYPES) & ~payload.isin("", "0", "false")
    first = _json(lines).groupBy("path").agg(F.min_by(F.coalesce(second, F.lit(False)), "line_no").alias("second"))
    return lines.select("path").distinct().join(first, "path", "left").select(
        "path", F.when(F.col("second"), "codex").otherwise("claude").alias("harness"))


def _string(value: Column) -> Column:
    """A variant as string, if it is one."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def content_text(value: Column) -> Column:
    """A5: a string as it is; of an array the string `text`s of its blocks, one a line; else empty."""
    blocks = F.try_variant_get(value, "$", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: _string(F.try_variant_get(b, "$.text", "variant"))), lambda t: t.isNotNull())
    return F.coalesce(_string(value), F.array_join(texts, "\n"), F.lit(""))


def tool_output_text(value: Column) -> Column:
    """Null for null; a string as it is; the blocks' texts unless blank; else compact JSON."""
    text = content_text(value)
    return F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("string")).when(_string(value).isNotNull(), text).when(F.trim(text) != "", text).otherwise(F.to_json(value))


def find_marked_files(lines: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Paths with a marker in the text of a user or assistant message. Only lines that hold a marker are parsed; one that
    doesn't parse counts. Markers have no characters that JSON escapes."""
    holds = lambda c: F.greatest(*[c.contains(m) for m in markers], F.lit(False))
    some = lines.filter(holds(F.col("raw"))).withColumn("v", F.try_parse_json("raw"))
    message = F.when(_get("$.type").isin("user", "assistant"), _get("$.message.content", "variant")).when(
        (_get("$.type") == "response_item") & (_get("$.payload.type") == "message") & _get("$.payload.role").isin("user", "assistant"), _get("$.payload.content", "variant"))
    return some.filter(F.col("v").isNull() | holds(content_text(message))).select("path").distinct()


def claude_messages(lines: DataFrame) -> DataFrame:
    """User and assistant lines of the first dialect: the columns that assemble_exchanges takes, with calls and results."""
    content = _get("$.message.content", "variant")
    rows = _json(lines).filter(_get("$.type").isin("user", "assistant"))
    blocks = F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>"))
    at = lambda b, p, kind="string": F.try_variant_get(b, p, kind)
    calls = F.transform(F.filter(blocks, lambda b: at(b, "$.type") == "tool_use"), lambda b: F.struct(
        at(b, "$.id").alias("id"), F.coalesce(at(b, "$.name"), F.lit("unknown")).alias("name"), F.to_json(at(b, "$.input", "variant")).alias("input")))
    results = F.transform(F.filter(blocks, lambda b: at(b, "$.type") == "tool_result"), lambda b: F.struct(
        at(b, "$.tool_use_id").alias("id"), tool_output_text(at(b, "$.content", "variant")).alias("output"),
        F.coalesce(at(b, "$.is_error", "boolean"), F.lit(False)).alias("is_error")))
    role = _get("$.type")
    return rows.select(
        "path", "project", "line_no", role.alias("role"), content_text(content).alias("text"), _get("$.timestamp").alias("ts_raw"), _get("$.sessionId").alias("session_id"),
        F.coalesce(_get("$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"),
        F.when(role == "assistant", calls).alias("calls"), F.when(role == "user", results).alias("results"))


def extract_tool_calls(messages: DataFrame, exchanges: DataFrame) -> DataFrame:
    """A3: id, exchange_id, tool_name, tool_input, tool_result, is_error of calls in the exchanges of `messages` (claude_messages).

    A result counts up to and with the user line that closes its exchange; of several the last one does. A call without an
    id gets one from its place.
    """
    opens = (F.col("role") == "user") & (F.trim("text") != "")
    order = Window.partitionBy("path").orderBy("line_no")
    rows = messages.withColumn("start", F.last(F.when(opens, F.col("line_no")), True).over(order)).withColumn(
        "before", F.last(F.when(opens, F.col("line_no")), True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    calls = rows.select("path", "start", "line_no", F.posexplode("calls").alias("i", "c")).select(
        "path", "start", "line_no", "i", "c.*").withColumn("id", F.coalesce("id", F.sha2(F.concat_ws(":", "path", "line_no", "i"), 256)))
    results = rows.select("path", F.col("before").alias("start"), F.col("line_no").alias("at"), F.posexplode("results").alias("j", "r")).select("path", "start", "at", "j", "r.*")
    last = results.groupBy("path", "start", "id").agg(F.max(F.struct("at", "j", "output", "is_error")).alias("r"))
    own = calls.join(exchanges.select(F.col("archive_path").alias("path"), F.col("line_start").alias("start"), F.col("id").alias("exchange_id")), ["path", "start"])
    good = F.col("r.at") > F.col("line_no")
    return own.join(last, ["path", "start", "id"], "left").select(
        "id", "exchange_id", F.col("name").alias("tool_name"), F.col("input").alias("tool_input"),
        F.when(good, F.col("r.output")).alias("tool_result"), F.coalesce(good & F.col("r.is_error"), F.lit(False)).alias("is_error"))


def codex_records(lines: DataFrame) -> DataFrame:
    """Lines of the second dialect with the exchange they are in (line_start, null before the first) and running metadata."""
    kind, inner, payload = _get("$.type"), _get("$.payload.type"), lambda p, k="string": _get("$.payload." + p, k)
    item = kind == "response_item"
    text = content_text(payload("content", "variant"))
    spoken = item & (inner == "message") & payload("role").isin("user", "assistant") & (F.trim(text) != "")
    part = F.when(spoken, payload("role")).when(item & inner.isin(*CALLS), "call").when(item & inner.isin(*OUTPUTS), "output").when(kind.isin("session_meta", "turn_context"), "meta")
    arguments = payload("arguments", "variant")
    given = F.coalesce(F.when(_string(arguments).isNotNull(), F.coalesce(F.to_json(F.try_parse_json(_string(arguments))), _string(arguments))),
                       F.to_json(payload("input", "variant")), F.to_json(payload("action", "variant")), F.to_json(arguments))
    some = lambda c: F.when(c != "", c)
    meta = {name: F.when(kind.isin(*kinds), some(payload(path))) for name, path, kinds in (
        ("session_id", "id", ("session_meta",)), ("cwd", "cwd", ("session_meta", "turn_context")), ("git_branch", "git.branch", ("session_meta",)),
        ("agent_version", "cli_version", ("session_meta",)), ("model_provider", "model_provider", ("session_meta",)), ("model", "model", ("turn_context",)))}
    rows = _json(lines).select(
        "path", "project", "line_no", part.alias("kind"), F.when(spoken, text).alias("text"), _get("$.timestamp").alias("ts_raw"), some(payload("call_id")).alias("call_id"),
        F.coalesce(some(payload("name")), some(payload("namespace")), inner, F.lit("unknown")).alias("name"), given.alias("input"),
        tool_output_text(payload("output", "variant")).alias("output"), *[c.alias(n) for n, c in meta.items()]).filter("kind IS NOT NULL")
    order = Window.partitionBy("path").orderBy("line_no")
    running = rows.withColumns({n: F.last(n, True).over(order) for n in meta} | {"line_start": F.last(F.when(F.col("kind") == "user", F.col("line_no")), True).over(order)})
    same = Window.partitionBy("path", "line_start", "call_id").orderBy("line_no")
    return running.withColumn("paired", F.coalesce(F.max(F.col("kind") == "call").over(same) & F.col("call_id").isNotNull(), F.lit(False)))


def assemble_codex(records: DataFrame) -> DataFrame:
    """A2: exchanges of codex_records. Calls and outputs of known calls move line_end; metadata is that at the exchange's close."""
    answers, ends = F.col("kind") == "assistant", F.col("kind").isin("assistant", "call") | ((F.col("kind") == "output") & F.col("paired"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(answers, F.struct("line_no", "text")))), lambda x: x["text"])
    meta = ("session_id", "cwd", "git_branch", "agent_version", "model_provider", "model")
    found = records.filter("line_start IS NOT NULL").groupBy("path", "project", "line_start").agg(
        F.max(F.when(F.col("kind") == "user", F.col("text"))).alias("user_message"), F.array_join(texts, "\n\n").alias("assistant_message"), F.max(answers).alias("answered"),
        F.max(F.when(ends, F.col("line_no"))).alias("line_end"), F.max_by("ts_raw", F.when(answers, F.col("line_no"))).alias("ts_raw"), *[F.max_by(m, "line_no").alias(m) for m in meta])
    folder = F.regexp_extract(F.regexp_replace("cwd", r"[/\\]+$", ""), r"([^/\\]+)$", 1)
    return found.filter("answered").select(
        exchange_id("path", "line_start", "line_end").alias("id"), F.col("path").alias("archive_path"), F.coalesce(F.when(folder != "", folder), F.col("project")).alias("project"),
        "user_message", "assistant_message", "line_start", "line_end", "ts_raw", *meta)


def extract_codex_tool_calls(records: DataFrame, exchanges: DataFrame) -> DataFrame:
    """A4: calls of codex_records with the last output of their id in the same exchange."""
    calls = records.filter("kind = 'call'").select("path", "line_start", F.col("line_no").alias("at"), F.coalesce("call_id", F.sha2(F.concat_ws(":", "path", "line_no"), 256)).alias("id"),
                                                   F.col("name").alias("tool_name"), F.col("input").alias("tool_input"))
    outputs = records.filter("kind = 'output' AND paired AND output IS NOT NULL").groupBy("path", "line_start", F.col("call_id").alias("id")).agg(F.max_by("output", "line_no").alias("tool_result"))
    own = exchanges.select(F.col("archive_path").alias("path"), "line_start", F.col("id").alias("exchange_id"))
    return calls.join(own, ["path", "line_start"]).join(outputs, ["path", "line_start", "id"], "left").select("id", "exchange_id", "tool_name", "tool_input", "tool_result", F.lit(False).alias("is_error"))
