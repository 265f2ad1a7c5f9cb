"""Chat formatting with Spark expressions only (operator 7).

Format of a conversation: for each run of turns of one role, START role SEP text (SEP text)* END.
Every mark begins with `<|`. Texts and roles are escaped so that neither these marks nor the listed
control strings of other templates occur in them; the escape adds one backslash behind the first
character of a control string (before those that are there), and unescaping takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"
CONTROL = r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"([<\[])(\\*)(?={CONTROL})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={CONTROL})", "$1$2")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): `turns` has conv_id, turn, role, text; other columns are ignored.

    Null roles and texts count as empty; turns are sorted by (turn, role, text), null turns first;
    repeated rows are turns of their own; a null conv_id is one conversation; no rows give no rows.
    A conversation is one string in the end, so its turns meet in one task; conversations don't.
    """
    listed = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("x")).alias("t")
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # first turns of the runs of one role, then one struct for each run
    starts = F.filter(
        F.sequence(F.lit(0), F.size("ts") - 1),
        lambda i: (i == 0) | (F.get("ts", i)["r"] != F.get("ts", i - 1)["r"]),
    )
    runs = listed.withColumn("ss", starts).withColumn(
        "runs",
        F.transform("ss", lambda s, j: F.struct(
            F.get("ts", s)["r"].alias("role"),
            F.slice("ts", s + 1, F.coalesce(F.get("ss", j + 1), F.size("ts")) - s)["x"].alias("texts"),
        )),
    )
    body = F.transform("runs", lambda r: F.concat(
        F.lit(START), escaped(r["role"]), F.lit(SEP), F.array_join(F.transform(r["texts"], escaped), SEP), F.lit(END)
    ))
    return runs.select("conv_id", F.array_join(body, "").alias("formatted"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, runs array<struct<role, texts>>) read back from the formatted strings alone."""
    blocks = F.filter(F.split("formatted", r"<\|start\|>"), lambda b, i: i > 0)
    cut = F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"<\|end\|>\n$", ""), r"<\|sep\|>"))
    return formatted.withColumn("runs", F.transform(cut, lambda p: F.struct(
        unescaped(F.get(p, F.lit(0))).alias("role"),
        F.transform(F.slice(p, F.lit(2), F.size(p) - 1), unescaped).alias("texts"),
    )))


def chat_digests(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """What a reader of the format gets back: turns, their digest, and the text under the loss mask."""
    parsed = parse_chats(format_chats(turns))
    said = F.array_join(F.transform("runs", lambda r: F.array_join(
        F.transform(r["texts"], lambda t: F.concat(r["role"], F.lit("\n"), t, F.lit("\n"))), "")), "")
    loss = F.array_join(F.transform(F.filter("runs", lambda r: r["role"] == loss_role), lambda r: F.array_join(r["texts"], "")), "")
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + F.size(r["texts"]))
    return parsed.select("conv_id", "formatted", "runs", n.alias("n_turns"), said.alias("said"), loss.alias("loss")).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("runs").cast("long").alias("n_runs"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe,
    )
    return chat_digests(turns.unionByName(extra))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
  regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS esc,
  regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS esc_role FROM c),
a AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum(length(esc) + 7 + CASE WHEN before IS NULL OR before <> role THEN 9 + 8 + length(esc_role) ELSE 0 END) AS formatted_chars,
  count(*) FILTER (WHERE before IS NULL OR before <> role) AS n_runs
  FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, n_runs
FROM a
"""
