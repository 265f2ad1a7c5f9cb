"""Transcript lines to exchanges: one user message and the assistant messages up to the next user message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP = 262_144
NOTICE = "\n[... cut for the index; whole length "


def exchange_id(path: Column | str, start: Column | str, end: Column | str) -> Column:
    """md5 of `path:start-end`."""
    return F.md5(F.concat(path, F.lit(":"), start, F.lit("-"), end))


def assemble_exchanges(lines: DataFrame) -> DataFrame:
    """A1 for lines (path, project, session_id, line_no, role, text, ts_raw, is_sidechain).

    Only user and assistant lines with text count; an exchange lives if an assistant answered. All lines of a path
    share one shuffle: the window's partitioning serves the aggregation.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    user = F.col("role") == "user"
    said = lines.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    numbered = said.withColumn("ex_no", F.sum(user.cast("int")).over(order)).filter("ex_no > 0")
    answer = F.array_sort(F.collect_list(F.when(~user, F.struct("line_no", "text"))))
    found = numbered.groupBy("path", "ex_no").agg(
        F.first("project").alias("project"), F.first("session_id").alias("session_id"),
        F.max_by("is_sidechain", F.when(user, 1)).alias("is_sidechain"), F.max(F.when(user, F.col("text"))).alias("user_message"),
        F.array_join(answer["text"], "\n\n").alias("assistant_message"), F.min("line_no").alias("line_start"),
        F.max(F.when(~user, F.col("line_no"))).alias("line_end"), F.max(F.when(~user, F.col("ts_raw"))).alias("ts_raw"),
    ).filter("line_end IS NOT NULL")
    return found.select(
        exchange_id("path", "line_start", "line_end").alias("id"), F.col("path").alias("archive_path"), "project", "session_id", "is_sidechain",
        "user_message", "assistant_message", "line_start", "line_end", "ts_raw")


def truncate_for_index(text: Column, cap: int = CAP) -> Column:
    """At most `cap` code points and a notice of the whole length; cut texts stay as they are; cap <= 0 is off."""
    if cap <= 0:
        return text
    cut = F.concat(F.substring(text, 1, cap), F.lit(NOTICE), F.char_length(text), F.lit("]"))
    return F.when((F.char_length(text) > cap) & ~text.contains(NOTICE), cut).otherwise(text)


def embedding_text(user: Column, assistant: Column, cap: int = 2000, tools: Column | None = None, message_cap: int = 0, redact: Callable[[Column], Column] = lambda t: t) -> Column:
    """What an embedder reads of an exchange: both messages, redacted and then cut (A8), and the names of its tools, if any."""
    said = lambda t: truncate_for_index(redact(t), message_cap)
    listed = F.lit("") if tools is None else F.when(F.size(tools) > 0, F.concat(F.lit("\n\nTools: "), F.array_join(tools, ", "))).otherwise("")
    return F.substring(F.concat(F.lit("User: "), said(user), F.lit("\n\nAssistant: "), said(assistant), listed), 1, cap)


def filter_incremental(exchanges: DataFrame, indexed: DataFrame) -> DataFrame:
    """Exchanges that start behind the last indexed line of their path."""
    mark = indexed.groupBy("archive_path").agg(F.max("line_end").alias("mark"))
    return exchanges.join(mark, "archive_path", "left").filter("mark IS NULL OR line_start > mark").drop("mark")


def conversation_chunks(exchanges: DataFrame, whole: int = 15, parts: int = 20, least: int = 8) -> DataFrame:
    """`User: …/Agent: …` texts of each session; over `whole` exchanges, in chunks of max(least, ceil(n / parts))."""
    key = Window.partitionBy("archive_path")
    n = F.count(F.lit(1)).over(key)
    place = F.row_number().over(key.orderBy("line_start"))
    size = F.when(n > whole, F.greatest(F.lit(least), F.ceil(n / parts))).otherwise(n)
    rows = exchanges.withColumn("chunk", F.floor((place - 1) / size))
    text = F.concat(F.lit("User: "), "user_message", F.lit("\n\nAgent: "), "assistant_message")
    return rows.groupBy("archive_path", "chunk").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line_start", text.alias("t"))))["t"], "\n\n---\n\n").alias("text"))


def trivial_sessions(exchanges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sessions of one exchange that is `/exit` or under 100 characters in all."""
    text = F.char_length("user_message") + F.char_length("assistant_message")
    keys = keys or ["archive_path"]
    per = exchanges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(text).alias("size"), F.max(F.trim("user_message")).alias("u"))
    return per.filter("n = 1 AND (u = '/exit' OR size < 100)").select(*keys)
