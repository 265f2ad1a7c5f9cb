"""The archive tables as views over the given tables: messages, exchanges, vectors, attempts, entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators.assemble import assemble_exchanges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a transcript line: path, project, session_id, line_no, role, text, ts_raw, is_sidechain."""
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select(
        F.concat(F.lit("/archive/p"), F.col("conv_id") % 7, F.lit("/"), "conv_id", F.lit(".jsonl")).alias("path"),
        F.concat(F.lit("p"), F.col("conv_id") % 7).alias("project"), F.concat(F.lit("s"), "conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("line_no"), "role", "text", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_raw"),
        (F.col("conv_id") % 11 == 0).alias("is_sidechain"),
    )


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_exchanges(messages(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("p"), F.col("vec_id") % 7).alias("project"),
        F.concat(F.lit("/archive/"), F.floor(F.col("vec_id") / 5)).alias("archive_path"),
        F.col("embedding").cast("array<double>").alias("embedding"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return vectors(spark, sf_dir).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded attempts: task = user, snapshot and run by event, turns from the JSON column."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.pmod("event_id", F.lit(2)).alias("snapshot_id"),
        F.pmod("event_id", F.lit(3)).alias("run_id"), (F.col("value") > 10).alias("passed"),
        F.get_json_object("props", "$.k").cast("long").alias("turns"), "event_type", "ts")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("locate", "recall", "when", "multi"))), (F.col("task_id") % 4 + 1).cast("int"))
    return attempts(spark, sf_dir).select("task_id").distinct().select(
        "task_id", kind.alias("kind"), (F.col("task_id") % 3 + 1).alias("tier"), F.concat(F.lit("p"), F.col("task_id") % 5).alias("project"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned entries: key (kind, project, slug) by brand and type, version by part key."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), F.col("p_type").alias("slug"), F.col("p_partkey").alias("version"),
        F.element_at(F.array(*map(F.lit, ("instruction", "skill", "reflection"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*map(F.lit, ("active", "candidate", "retired"))), (F.col("p_partkey") % 5 % 3 + 1).cast("int")).alias("status"),
        F.col("p_name").alias("body"))


SQL = """
v_messages AS (SELECT '/archive/p' || (conv_id % 7) || '/' || conv_id || '.jsonl' AS path, 'p' || (conv_id % 7) AS project,
  's' || conv_id AS session_id, turn + 1 AS line_no, role, text,
  strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts_raw,
  conv_id % 11 = 0 AS is_sidechain FROM conversations),
v_grouped AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS ex_no
  FROM v_messages WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
v_exchanges AS (SELECT md5(archive_path || ':' || line_start || '-' || line_end) AS id, * FROM (
  SELECT path AS archive_path, project, session_id, is_sidechain,
    max(text) FILTER (WHERE role = 'user') AS user_message,
    string_agg(text, chr(10) || chr(10) ORDER BY line_no) FILTER (WHERE role = 'assistant') AS assistant_message,
    min(line_no) AS line_start, max(line_no) FILTER (WHERE role = 'assistant') AS line_end,
    max(ts_raw) FILTER (WHERE role = 'assistant') AS ts_raw
  FROM v_grouped WHERE ex_no > 0 GROUP BY path, project, session_id, is_sidechain, ex_no)
  WHERE line_end IS NOT NULL),
v_vectors AS (SELECT vec_id AS id, 'p' || (vec_id % 7) AS project, '/archive/' || (vec_id // 5) AS archive_path,
  CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
v_queries AS (SELECT id AS query_id, embedding AS query FROM v_vectors WHERE id % 50 = 0),
v_attempts AS (SELECT event_id AS id, user_id AS task_id, event_id % 2 AS snapshot_id, event_id % 3 AS run_id, value > 10 AS passed,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS turns, event_type, ts FROM events),
v_tasks AS (SELECT DISTINCT task_id, (['locate', 'recall', 'when', 'multi'])[task_id % 4 + 1] AS kind, task_id % 3 + 1 AS tier,
  'p' || (task_id % 5) AS project FROM v_attempts),
v_entries AS (SELECT p_partkey AS id, p_brand AS project, p_type AS slug, p_partkey AS version,
  (['instruction', 'skill', 'reflection'])[p_partkey % 3 + 1] AS kind,
  (['active', 'candidate', 'retired'])[p_partkey % 5 % 3 + 1] AS status, p_name AS body FROM part)
"""
