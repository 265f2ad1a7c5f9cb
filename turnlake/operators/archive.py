"""Statistics, lifecycle, windows, sampling and evaluation over archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.assemble import trivial_sessions
from turnlake.operators.ranking import first_rows, ranked


def index_stats(ex: DataFrame, summaries: DataFrame) -> DataFrame:
    """G1: one row: paths, exchanges, first and last time, projects, and paths with and without a summary."""
    some = summaries.filter("text IS NOT NULL AND text <> ''").select("archive_path").distinct().withColumn("has", F.lit(1))
    per = ex.groupBy("archive_path").agg(F.count(F.lit(1)).alias("n"), F.min("ts_raw").alias("lo"), F.max("ts_raw").alias("hi")).join(some, "archive_path", "left")
    one = per.agg(F.count(F.lit(1)).alias("conversations"), F.sum("n").alias("exchanges"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"),
                  F.count("has").alias("with_summary"))
    return one.crossJoin(ex.agg(F.count_distinct("project").alias("projects"))).withColumn("without_summary", F.col("conversations") - F.col("with_summary"))


def top_projects(ex: DataFrame, k: int = 10) -> DataFrame:
    """Projects by conversations."""
    return ex.groupBy("project").agg(F.count_distinct("archive_path").alias("conversations")).orderBy(F.desc("conversations"), "project").limit(k)


def eligible_projects(ex: DataFrame, least: int = 20) -> DataFrame:
    """Projects with enough exchanges off sidechains."""
    return ex.filter(~F.coalesce("is_sidechain", F.lit(False))).groupBy("project").agg(
        F.count(F.lit(1)).alias("exchanges"), F.count_distinct("session_id").alias("sessions"), F.min("ts_raw").alias("first_ts"), F.max("ts_raw").alias("last_ts"),
    ).filter(F.col("exchanges") >= least)


def session_rollup(ex: DataFrame) -> DataFrame:
    """First and last time of each session."""
    return ex.filter("session_id IS NOT NULL").groupBy("project", "session_id").agg(F.min("ts_raw").alias("start_ts"), F.max("ts_raw").alias("end_ts"))


def tool_usage(calls: DataFrame) -> DataFrame:
    """`name(count)` of an exchange's tools in the order of their first call."""
    per = calls.groupBy("exchange_id", "tool_name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    said = F.struct("first", "tool_name", F.concat("tool_name", F.lit("("), "n", F.lit(")")).alias("t"))
    return per.groupBy("exchange_id").agg(F.array_join(F.array_sort(F.collect_list(said))["t"], ", ").alias("tools"))


def session_siblings(ex: DataFrame) -> DataFrame:
    """For each exchange, its session's time range and the first other exchange by (time, id)."""
    key = ["project", "session_id"]
    w = Window.partitionBy(*key).orderBy("ts_raw", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, second = F.first("id").over(w), F.nth_value("id", 2).over(w)
    return ex.select("id", F.min("ts_raw").over(w).alias("start_ts"), F.max("ts_raw").over(w).alias("end_ts"), F.when(F.col("id") != first, first).otherwise(second).alias("sibling"))


def diff_manifest(source: DataFrame, archive: DataFrame) -> DataFrame:
    """What a copy would do for each path (path, mtime)."""
    s, a = source.select("path", F.col("mtime").alias("s")), archive.select("path", F.col("mtime").alias("a"))
    return s.join(a, "path", "full").select("path", F.when(F.col("s").isNull(), "archived only").when(F.col("a").isNull() | (F.col("a") < F.col("s")), "copied").otherwise("skipped").alias("action"))


def slice_lines(requests: DataFrame, lines: DataFrame, max_bytes: int) -> DataFrame:
    """Line count and bytes of each requested range (req_id, path, start, stop), with a status."""
    low = F.greatest(F.col("start"), F.lit(1))
    asked = requests.withColumn("low", low)
    hit = asked.join(lines.select("path", "line_no", (F.octet_length("text") + 1).alias("bytes")), "path", "left").filter("line_no BETWEEN low AND stop OR stop < low OR line_no IS NULL")
    per = hit.groupBy("req_id", "low", "stop").agg(F.coalesce(F.sum(F.when(F.col("line_no").between(F.col("low"), F.col("stop")), F.col("bytes"))), F.lit(0)).alias("bytes"))
    return per.select("req_id", F.col("bytes").cast("long").alias("bytes"), F.when(F.col("stop") < F.col("low"), "bad range").when(F.col("bytes") > max_bytes, "too large").otherwise("ok").alias("status"))


def upsert(current: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows of both by id; the batch wins, in it the last by `seq`."""
    one = batch.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(seq)))).filter("_n = 1").drop("_n", seq)
    return current.join(one.select("id"), "id", "left_anti").unionByName(one)


def delete_for_archive(ex: DataFrame, paths: DataFrame) -> DataFrame:
    """S9 for one table: without the rows of the given archive paths."""
    return ex.join(paths.select("archive_path"), "archive_path", "left_anti")


def prune_counts(ex: DataFrame, projects: DataFrame) -> DataFrame:
    """S10, dry run: what deleting projects would free, in characters and bytes."""
    own = ex.join(projects.select("project"), "project", "left_semi")
    text = F.concat("user_message", "assistant_message")
    return own.agg(F.count(F.lit(1)).alias("exchanges"), F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("chars_freed"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes_freed"))


def newest_attempt(attempts: DataFrame, by: tuple[str, ...] = ("task_id", "run_id", "snapshot_id")) -> DataFrame:
    """The largest id for each (task, run, snapshot), or other keys, among graded attempts, with its usd where there is one."""
    more = [F.max_by("usd", "id").alias("usd")] if "usd" in attempts.columns else []
    return attempts.filter("passed IS NOT NULL").groupBy(*by).agg(F.max("id").alias("id"), F.max_by("passed", "id").alias("passed"), F.max_by("turns", "id").alias("turns"), *more)


#: The tasks that tell a difference.
SIGNAL_KINDS, SIGNAL_TIERS = ("locate", "when", "multi"), (2, 3)


def pass_rate(tasks: DataFrame, attempts: DataFrame, split: str | None = None, signal_only: bool = False) -> DataFrame:
    """Newest attempts, over all tasks and by kind and tier, for each run and snapshot.

    Tasks whose `status` is not ok don't count, nor those of another `split`, nor, with `signal_only`, those of other kinds and tiers.
    """
    if "status" in tasks.columns:
        tasks = tasks.filter("status = 'ok'")
    if split is not None:
        tasks = tasks.filter(F.col("split") == split)
    if signal_only:
        tasks = tasks.filter(F.col("kind").isin(*SIGNAL_KINDS) & F.col("tier").isin(*SIGNAL_TIERS))
    rows = newest_attempt(attempts).join(tasks.select("task_id", "kind", "tier"), "task_id")
    more = [F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd")] if "usd" in attempts.columns else []
    return rows.groupingSets([["run_id", "snapshot_id"], ["run_id", "snapshot_id", "kind", "tier"]], "run_id", "snapshot_id", "kind", "tier").agg(
        F.sum(F.col("passed").cast("long")).alias("passed"), F.count(F.lit(1)).alias("total"), F.round(F.coalesce(F.avg("turns"), F.lit(0.0)), 6).alias("mean_turns"), *more)


def failing_tasks(attempts: DataFrame, across_runs: bool = False) -> DataFrame:
    """Tasks whose newest attempt in a snapshot failed, in each run or across all runs."""
    by = ("task_id", "snapshot_id") if across_runs else ("task_id", "run_id", "snapshot_id")
    return newest_attempt(attempts, by).filter("NOT passed").select(*by)


def post_leaf_passed(attempts: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row, passed: how many of the tasks (task_id) pass by their newest graded attempt in any of the runs (run_id)."""
    own = attempts.join(runs.select("run_id").distinct(), "run_id", "left_semi").join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    return newest_attempt(own, ("task_id",)).agg(F.count_if("passed").alias("passed"))


def latest_version(entries: DataFrame) -> DataFrame:
    """The newest row of each (kind, project, slug)."""
    return entries.groupBy("kind", "project", "slug").agg(F.max("version").alias("version"), F.max_by("id", "version").alias("id"))


def entry_counts(entries: DataFrame, statuses: tuple[str, ...] = ("active", "candidate", "retired")) -> DataFrame:
    """Kinds by status."""
    return entries.groupBy("kind").pivot("status", list(statuses)).count().na.fill(0)


def activate(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The given ids become active, other active rows of their keys superseded."""
    key = ["kind", "project", "slug"]
    won = entries.join(ids.select("id"), "id", "left_semi").groupBy(*key).agg(F.max("id").alias("winner"))
    return entries.join(won, key, "left").select("id", F.when(F.col("id") == F.col("winner"), "active").when(F.col("winner").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status")).alias("status"))


def list_active(entries: DataFrame, kinds: list[str], project: str | None = None) -> DataFrame:
    """E9, with Q8's order as a column: instructions, skills, reflections, then project and slug.

    With a project, its own rows and behind them those of `*`. Superseded rows don't count where `superseded_by` is told.
    """
    rank = F.when(F.col("kind") == "instruction", 0).when(F.col("kind") == "skill", 1).when(F.col("kind") == "reflection", 2).otherwise(3)
    own = entries.filter((F.col("status") == "active") & F.col("kind").isin(kinds))
    if "superseded_by" in entries.columns:
        own = own.filter("superseded_by IS NULL")
    if project is None:
        return own.select("id", "kind", "project", "slug", rank.alias("kind_order"))
    own = own.filter(F.col("project").isin(project, "*")).withColumns({"kind_order": rank, "shared": (F.col("project") == "*").cast("int")})
    return own.orderBy("shared", "kind_order", "project", "slug", "id").select("id", "kind", "project", "slug", "kind_order", "shared")


def stale_vectors(ex: DataFrame, vectors: DataFrame, version: int) -> DataFrame:
    """Ids of an older version or without a vector."""
    return ex.join(vectors.select("id", F.lit(1).alias("has")), "id", "left").filter(F.col("has").isNull() | (F.col("embedding_version") < version)).select("id")


def insert_new(entries: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't there yet, one for a key."""
    return new.join(entries.select(*key), key, "left_anti").dropDuplicates(key)


def seeded_rank(by: list[str], key: str, seed: str) -> Column:
    """Deterministic order of rows within groups, by a hash of seed and key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key))


def select_source_exchanges(ex: DataFrame, per_project: int, seed: str, least: int = 20) -> DataFrame:
    """Q2: a seeded sample of substantial exchanges from each project that has enough of them."""
    fit = ex.filter("NOT coalesce(is_sidechain, false) AND char_length(user_message) >= 80 AND char_length(assistant_message) >= 200")
    enough = fit.groupBy("project").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    hashed = fit.select("id", "project", F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"))).alias("h"))
    return first_rows(hashed, ["project"], ["h", "id"], per_project).join(enough, "project", "left_semi").select("id", "project")


def stratified_quota(drafts: DataFrame, most: int, seed: str) -> DataFrame:
    """Q3: `most` rows shared out over (project, tier); the first strata get one more where it doesn't divide."""
    strata = drafts.select("project", "tier").distinct().withColumns({
        "place": F.row_number().over(Window.orderBy("project", "tier")), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    quota = strata.select("project", "tier", (F.floor(F.lit(most) / F.col("n")) + (F.col("place") <= F.lit(most) % F.col("n")).cast("int")).alias("quota"))
    ranked = drafts.withColumn("r", seeded_rank(["project", "tier"], "task_id", seed))
    return ranked.join(F.broadcast(quota), ["project", "tier"]).filter(F.col("r") <= F.col("quota")).select("task_id", "project", "tier")


def split_train_test(tasks: DataFrame, share: float = 0.6) -> DataFrame:
    """Q4: the first round(n * share) of each (project, tier), by kind and id, are for training."""
    placed = ranked(tasks.select("project", "tier", "kind", "task_id"), ["project", "tier"], ["kind", "task_id"])
    return placed.select("task_id", F.when(F.col("rank") <= F.floor(F.col("size") * share + 0.5), "train").otherwise("test").alias("split"))


def pack_until_full(blocks: DataFrame, by: list[str], order: list[str], budget: int) -> DataFrame:
    """Blocks in order up to the first that doesn't fit. Each that isn't empty takes a character, so one more than `budget` decide."""
    some = F.char_length("text") > 0
    blocks = first_rows(blocks.filter(some), by, order, budget + 1).unionByName(blocks.filter(~some))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("used", F.sum(F.char_length("text")).over(w)).filter(F.col("used") <= budget)


def sidechain_segments(messages: DataFrame) -> DataFrame:
    """Runs of equal sidechain flags within a path: start, end and length."""
    w = Window.partitionBy("path").orderBy("line_no")
    new = F.when(F.lag("is_sidechain").over(w).eqNullSafe(F.col("is_sidechain")), 0).otherwise(1)
    runs = messages.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("path", "run", "is_sidechain").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("n"))


def suspect_tasks(attempts: DataFrame) -> DataFrame:
    """Tasks with two failed attempts or more that name two different places or more."""
    return attempts.filter("NOT passed").groupBy("task_id").agg(F.count(F.lit(1)).alias("failed"), F.count_distinct(F.lower("event_type")).alias("places")).filter("failed >= 2 AND places >= 2")


def fold_success_rate(events: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Exponentially weighted success of each key in order, from 0.5, and the events of a key; ungraded ones don't count.

    The weight of an event depends on how many are behind it, so a rank and a sum do, and no key's events have to meet.
    """
    graded = events.filter("passed IS NOT NULL").select("task_id", "id", F.col("passed").cast("double").alias("ok"))
    behind = F.pow(F.lit(1 - alpha), F.col("size") - F.col("rank"))
    return ranked(graded, ["task_id"], ["id"]).groupBy("task_id").agg(
        F.round(0.5 * F.pow(F.lit(1 - alpha), F.count(F.lit(1))) + F.sum(alpha * F.col("ok") * behind), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


def plan_compression(entries: DataFrame, today: str, least_sessions: int = 5, least_days: int = 2) -> DataFrame:
    """Entries (tier, project, period_start, period_end, handoff, superseded_by) that fold into a wider one: tier, project, first_day, n, period_end.

    Only active entries that are no handoff notes count: past days of a project with more than `least_sessions` session
    entries fold into a day entry, finished ISO weeks (from Monday) with more than `least_days` day entries into a week entry.
    """
    live = entries.filter(~F.coalesce("handoff", F.lit(False)) & F.col("superseded_by").isNull())
    day = F.substring("period_start", 1, 10)
    week = F.date_trunc("WEEK", F.to_date(day)).cast("date")

    def folded(tier: str, into: str, first: Column, over: Column, least: int) -> DataFrame:
        return live.filter((F.col("tier") == tier) & over).groupBy("project", first.cast("string").alias("first_day")).agg(
            F.count(F.lit(1)).alias("n"), F.max("period_end").alias("period_end")).filter(F.col("n") > least).select(F.lit(into).alias("tier"), "project", "first_day", "n", "period_end")

    return folded("session", "day", day, day < today, least_sessions).unionByName(
        folded("day", "week", week, F.date_add(week, 7) <= F.lit(today).cast("date"), least_days))


def digest_candidates(ex: DataFrame, digest: DataFrame, now: str, limit: int) -> DataFrame:
    """Quiet sessions without an entry, newest first; trivial ones (A13) don't count."""
    open_ = session_rollup(ex).join(digest.select("project", F.col("period_start").alias("start_ts")), ["project", "start_ts"], "left_anti")
    telling = open_.join(trivial_sessions(ex, ["project", "session_id"]), ["project", "session_id"], "left_anti")
    return telling.filter(F.col("end_ts") <= now).orderBy(F.desc("end_ts"), "session_id").limit(limit)
