"""States of summaries, backfills, tasks and attempts, checks of incoming queries, and what a hit shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.search import address_join


def with_summary(hits: DataFrame, summaries: DataFrame, cap: int = 2000) -> DataFrame:
    """hits with the summary (archive_path, text) of their conversation, cut to `cap` characters and an ellipsis; null without one."""
    own = summaries.select("archive_path", F.when(F.char_length("text") > cap, F.concat(F.substring("text", 1, cap), F.lit("…"))).otherwise(F.col("text")).alias("summary"))
    return hits.join(own, "archive_path", "left")


def query_status(queries: DataFrame) -> DataFrame:
    """F8: queries (concepts: array, limit) with `error` (null for good ones) and the limit in force, 10 by default."""
    lengths = F.transform("concepts", lambda c: F.char_length(c))
    error = (
        F.when(F.col("concepts").isNull() | (F.size("concepts") < 1), "no query")
        .when(F.exists(lengths, lambda n: n.isNull() | (n < 2)), "query too short")
        .when(F.size("concepts") > 5, "too many concepts")
        .when((F.col("limit") < 1) | (F.col("limit") > 50), "bad limit")
    )
    return queries.withColumn("error", error).withColumn("limit", F.coalesce("limit", F.lit(10)))


def validate_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F8: the good queries and the bad ones with their errors."""
    told = query_status(queries)
    return told.filter("error IS NULL").drop("error"), told.filter("error IS NOT NULL")


def _any_of(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """All rows without a list; none for an empty one."""
    return df if values is None else df.filter(F.col(column).isin(values)) if values else df.filter(F.lit(False))


def list_tasks(tasks: DataFrame, split: str, kinds: list | None = None, tiers: list | None = None, project: str | None = None,
               ids: list | None = None, include_stale: bool = False) -> DataFrame:
    """tasks of a split; stale ones are hidden unless asked for."""
    own = tasks.filter(F.col("split") == split)
    if not include_stale:
        own = own.filter(F.coalesce(F.col("status"), F.lit("")) != "stale")
    if project is not None:
        own = own.filter(F.col("project") == project)
    return _any_of(_any_of(_any_of(own, "kind", kinds), "tier", tiers), "task_id", ids)


def list_attempts(attempts: DataFrame, run: int | None = None, tasks: list | None = None, role: str | None = None, outcome: str | None = None) -> DataFrame:
    """attempts under all of the given conditions."""
    for column, value in (("run_id", run), ("role", role), ("outcome", outcome)):
        if value is not None:
            attempts = attempts.filter(F.col(column) == value)
    return _any_of(attempts, "task_id", tasks)


def fold_heuristic(events: DataFrame, key: str, gain: float = 0.1, loss: float = 0.2) -> DataFrame:
    """Confidence, support and contradictions of each heuristic after its events (seq, start, reinforces), in order.

    The events of one heuristic are folded in one row; a heuristic gets one a review, so they are few.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "reinforces"))), lambda e: e["reinforces"])
    step = lambda c, up: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(up, c + (1 - c) * gain).otherwise(c - c * loss)))
    return events.groupBy(key).agg(F.first("start").alias("start"), ordered.alias("es")).select(
        key, F.round(F.aggregate("es", F.col("start").cast("double"), step), 6).alias("confidence"),
        F.size(F.filter("es", lambda e: e)).cast("long").alias("support"), F.size(F.filter("es", lambda e: ~e)).cast("long").alias("contradictions"))


def summary_state(manifest: DataFrame, summaries: DataFrame) -> DataFrame:
    """Manifest (path) with the state of its summary (path, text, attempts, reason, gave_up); attempts is null without a record.

    pending: no summary; empty texts are unexplained without a record, retrying with one that neither has a reason nor gave up, else terminal.
    """
    own = summaries.withColumn("_there", F.lit(True))
    ended = F.coalesce("gave_up", F.lit(False)) | F.coalesce(F.col("reason") != "", F.lit(False))
    state = (
        F.when(F.col("_there").isNull(), "pending").when(F.coalesce(F.trim("text"), F.lit("")) != "", "done")
        .when(F.col("attempts").isNull(), "unexplained").when(ended, "terminal").otherwise("retrying")
    )
    return manifest.join(own, "path", "left").withColumn("state", state).drop("_there")


def backfill_candidates(states: DataFrame, marked: DataFrame, excluded: DataFrame) -> DataFrame:
    """Paths of a manifest with states (path, project, session_id, state) to summarise, by project and then path.

    Not of excluded projects, not marked (path), with a session id, and pending, unexplained or retrying.
    """
    open_ = states.filter(F.col("session_id").isNotNull() & (F.col("session_id") != "") & F.col("state").isin("pending", "unexplained", "retrying"))
    left = open_.join(excluded.select("project"), "project", "left_anti").join(marked.select("path"), "path", "left_anti")
    return left.select("project", "path", "state").orderBy("project", "path")


def batch_verdict(batches: DataFrame, by: str) -> DataFrame:
    """Verdict of each batch (seq, deferred, attempted, succeeded, remaining) of a backfill, given the batch before."""
    before = F.lag("remaining").over(Window.partitionBy(by).orderBy("seq"))
    verdict = (
        F.when(F.col("deferred"), "deferred").when(F.col("remaining") == 0, "done")
        .when((F.col("attempted") >= 3) & (F.col("succeeded") == 0), "backend-down")
        .when(F.col("remaining") >= before, "no-progress").otherwise("continue")
    )
    return batches.select(by, "seq", verdict.alias("verdict"))


def stale_tasks(tasks: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Tasks (task_id, refs: array of path, line_start, line_end) with no ref, or a ref that no exchange overlaps any more."""
    refs = tasks.select("task_id", F.posexplode_outer("refs").alias("i", "r"))
    asked = refs.filter("r IS NOT NULL").select(F.struct("task_id", "i").alias("ref_id"), "r.path", "r.line_start", "r.line_end")
    met = address_join(asked, exchanges.select("id", F.col("archive_path").alias("path"), "line_start", "line_end")).select("ref_id").distinct()
    lost = asked.join(met, "ref_id", "left_anti").select(F.col("ref_id.task_id").alias("task_id"))
    return lost.unionByName(refs.filter("r IS NULL").select("task_id")).distinct()


def attempts_exist(groups: DataFrame, attempts: DataFrame) -> DataFrame:
    """group_id, found: whether a group's list of attempt ids isn't empty and all are stored."""
    each = groups.select("group_id", F.explode_outer("ids").alias("id"))
    held = each.join(attempts.select("id").distinct().withColumn("_held", F.lit(True)), "id", "left")
    return held.groupBy("group_id").agg(F.bool_and(F.coalesce("_held", F.lit(False))).alias("found"))


def normalize_handoff(note: Column, redact=lambda c: c, cap: int = 500) -> Column:
    """A note, redacted, on one line, cut to `cap` characters with `...` at the end; null when nothing is left."""
    line = F.btrim(F.regexp_replace(redact(note), r"\s+", " "))
    return F.when(line == "", None).when(F.char_length(line) > cap, F.concat(F.substring(line, 1, cap - 3), F.lit("..."))).otherwise(line)
