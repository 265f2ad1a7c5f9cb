"""Citations, verification, grading, decisions and orders over the archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.text import cited_ids
from turnlake.operators.ranking import ranked
from turnlake.operators.search import top_k


def _marks(entries: DataFrame) -> DataFrame:
    """entry_id, mark: every exchange id that an entry's text cites, repeats kept."""
    return entries.select(F.col("id").alias("entry_id"), F.explode(F.regexp_extract_all("text", F.lit("#([0-9a-f]{32})"), 1)).alias("mark"))


def resolve_citations(entries: DataFrame, ex: DataFrame) -> DataFrame:
    """The exchanges that each entry (id, text) cites, once each, with their address."""
    known = ex.select(F.col("id").alias("mark"), "archive_path", "line_start", "line_end", "session_id")
    return _marks(entries).distinct().join(known, "mark").withColumnRenamed("mark", "exchange_id")


def unresolved_citations(entries: DataFrame, ex: DataFrame) -> DataFrame:
    """Entries with unknown ids and how many; an id that is cited twice counts twice."""
    return _marks(entries).join(ex.select(F.col("id").alias("mark")), "mark", "left_anti").groupBy("entry_id").agg(F.count(F.lit(1)).alias("missing"))


def remove_derived(entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries (id, text, superseded_by) without the lines that cite removed ids.

    An entry that loses its last line goes, and what it superseded is active again. Lines are rows, so the removed
    ids are joined and never collected.
    """
    lines = entries.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    hit = lines.select("id", "pos", F.explode(cited_ids(F.col("line"))).alias("mark")).join(
        removed.select(F.col("id").alias("mark")), "mark", "left_semi").select("id", "pos").distinct()
    kept = lines.join(hit, ["id", "pos"], "left_anti").filter("trim(line) <> ''").groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    left = entries.drop("text").join(kept, "id")
    alive = left.select(F.col("id").alias("superseded_by")).withColumn("alive", F.lit(True))
    return left.join(alive, "superseded_by", "left").select(
        "id", "text", F.when(F.col("alive"), F.col("superseded_by")).alias("superseded_by"))


def verify_index(manifest: DataFrame, ex: DataFrame, summaries: DataFrame, marked: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Path, issue. Files without a summary are missing, then those changed since are outdated; rows without a file,
    or of a marked one, are orphaned; files that nobody can read are corrupted and nothing else, and their rows stay.
    manifest (path, mtime), ex (path, last_indexed), summaries, marked and unreadable (path)."""
    if unreadable is not None:
        bad = manifest.join(unreadable.select("path").distinct(), "path", "left_semi").select("path", F.lit("corrupted").alias("issue"))
        good = verify_index(manifest.join(bad, "path", "left_anti"), ex.join(bad, "path", "left_anti"), summaries, marked)
        return good.unionByName(bad)
    newest = ex.groupBy("path").agg(F.max("last_indexed").alias("last"))
    files = manifest.join(marked, "path", "left_anti")
    checked = files.join(summaries.select("path", F.lit(True).alias("has")), "path", "left").join(newest, "path", "left")
    bad = checked.select("path", F.when(F.col("has").isNull(), "missing").when(F.floor("mtime") > F.coalesce("last", F.lit(0)), "outdated").alias("issue"))
    gone = newest.join(files, "path", "left_anti").select("path", F.lit("orphaned").alias("issue"))
    return bad.filter("issue IS NOT NULL").unionByName(gone)


def repair_plan(issues: DataFrame, marked: DataFrame) -> DataFrame:
    """Orphans are deleted; what is missing or outdated is read again unless marked; the rest is reported."""
    m = marked.select("path", F.lit(True).alias("marked"))
    return issues.join(m, "path", "left").filter("issue IN ('orphaned', 'corrupted') OR marked IS NULL").select(
        "path", F.when(F.col("issue") == "orphaned", "delete").when(F.col("issue") == "corrupted", "report").otherwise("reindex").alias("action")).distinct()


def gain_decision(cells: DataFrame, by: list[str], least: float = 10.0) -> DataFrame:
    """By, side (before/after), graded, passed, turns, usd → savings in percent in turns and USD a task, whether to keep, and the reason.

    A saving is 0 where a side is unmeasured or nothing was used before. A side with other tasks is no evidence.
    """
    at = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c)))
    two = cells.groupBy(*by).agg(*[F.coalesce(at(s, c), F.lit(0)).alias(f"{s}_{c}") for s in ("before", "after") for c in ("graded", "passed", "turns", "usd")])
    measured = (F.col("before_graded") > 0) & (F.col("after_graded") > 0)
    mean = lambda s, c: F.col(f"{s}_{c}") / F.col(f"{s}_graded")
    saved = lambda c: F.when(measured & (F.col(f"before_{c}") > 0), 100 * (mean("before", c) - mean("after", c)) / mean("before", c)).otherwise(0.0)
    reason = (F.when(~measured, "unmeasured").when(F.col("before_graded") != F.col("after_graded"), "unequal-coverage").when(F.col("after_passed") < F.col("before_passed"), "pass-rate-fell")
              .when((F.col("turns") >= least) | (F.col("usd") >= least), "saving").otherwise("no-saving"))
    return two.withColumn("turns", saved("turns")).withColumn("usd", saved("usd")).select(
        *by, F.round("turns", 4).alias("turn_saving"), F.round("usd", 4).alias("usd_saving"), (reason == "saving").alias("keep"), reason.alias("reason"))


def merge_check(before: DataFrame, now: DataFrame) -> DataFrame:
    """Tasks that passed before and don't now; both sides hold the last attempt of a task."""
    b, n = before.filter("passed").select("task_id"), now.filter("NOT passed").select("task_id", "id")
    return n.join(b, "task_id", "left_semi")


def merge_evidence(before: DataFrame, after: DataFrame) -> DataFrame:
    """run_id, the record of a check: tasks graded, of those passed before, passed and graded after, regressions, mean turns and usd.

    before (run_id, task_id) passed; after (run_id, id, task_id, passed: null if not graded, turns, usd) are all attempts of
    the check. A task's last attempt counts, turns and usd of all.
    """
    key = ["run_id", "task_id"]
    tasks = after.groupBy(*key).agg(F.max_by("passed", "id").alias("ok"), F.sum("turns").alias("turns"), F.count("turns").alias("n"), F.sum("usd").alias("usd"))
    was = before.select(*key).distinct().withColumn("was", F.lit(True))
    ok, held = F.coalesce("ok", F.lit(False)), F.coalesce("was", F.lit(False))
    return tasks.join(was, key, "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sample"), F.count_if(held).alias("passed_before"), F.count_if(ok).alias("passed_after"), F.count_if(held & ~ok).alias("regressions"),
        F.count_if(F.col("ok").isNotNull()).alias("graded_after"), F.round(F.sum("turns") / F.sum("n"), 6).alias("mean_turns_after"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd_after"))


def split_failures(failures: DataFrame, leaf_max: int, assignment: DataFrame | None = None) -> DataFrame:
    """Failures counted by project, and by category too where a project has more than leaf_max.

    With an assignment (task_id, category) the categories are its, if it is a partition of the failed tasks: each once,
    and no other. If it isn't, projects stay whole.
    """
    if assignment is not None:
        tasks = failures.select("task_id").distinct()
        named = assignment.groupBy("task_id").agg(F.count(F.lit(1)).alias("times"), F.first("category").alias("category"))
        both = tasks.withColumn("failed", F.lit(True)).join(named, "task_id", "full")
        fits = both.agg(F.coalesce(F.bool_and(F.col("failed").isNotNull() & F.col("times").eqNullSafe(F.lit(1))), F.lit(True)).alias("fits"))
        own = failures.drop("category").join(named.select("task_id", "category"), "task_id", "left")
        failures = own.crossJoin(F.broadcast(fits)).withColumn("category", F.when(F.col("fits"), F.col("category")))
    leaves = failures.groupBy("project", "category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("project"))
    named = leaves.withColumn("leaf", F.when(total > leaf_max, F.col("category")))
    return named.groupBy("project", "leaf").agg(F.sum("n").alias("n"))


def merge_candidates(kept: DataFrame, least: int = 2) -> DataFrame:
    """Keys (kind, project, slug) that at least `least` runs kept, with their distinct sources in order."""
    found = kept.groupBy("kind", "project", "slug").agg(F.count_distinct("run_id").alias("runs"), F.array_sort(F.collect_set("source")).alias("sources"))
    return found.filter(F.col("runs") >= least)


def insert_entries(entries: DataFrame, proposals: DataFrame, key: list[str]) -> DataFrame:
    """Proposals whose body differs from the latest version's, as its next version with the parent's id."""
    latest = entries.groupBy(*key).agg(F.max_by(F.struct("id", "version", "body"), F.struct("version", "id")).alias("last"))
    return proposals.join(latest, key, "left").filter("last IS NULL OR NOT (last.body <=> body)").select(
        *key, "body", (F.coalesce("last.version", F.lit(0)) + 1).alias("version"), F.col("last.id").alias("parent"))


def entry_rank() -> Column:
    """Q8 within a project: kind instruction, skill, reflection, other; then slug, then id."""
    place = F.array_position(F.array(*map(F.lit, ("instruction", "skill", "reflection"))), F.col("kind"))
    return F.row_number().over(Window.partitionBy("project").orderBy(F.when(place == 0, 4).otherwise(place), "slug", "id")).cast("long")


def match_procedures(contexts: DataFrame, procedures: DataFrame, k: int, least: float = 0.01, selected: float = 0.3) -> DataFrame:
    """Jaccard of token sets of contexts (context, text) and procedures (id, text), the best k of each context.

    Candidates come from a join on tokens. The contexts are the stated, small side.
    """
    def tokens(df: DataFrame, name: str) -> DataFrame:
        words = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
        kept = F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= 2))
        return df.select(F.col(name), F.size(kept).alias(f"{name}_n"), F.explode(kept).alias("token"))

    shared = tokens(procedures, "id").join(tokens(contexts, "context"), "token").groupBy("context", "id", "context_n", "id_n").agg(F.count(F.lit(1)).alias("s"))
    scored = shared.withColumn("score", F.round(F.col("s") / (F.col("context_n") + F.col("id_n") - F.col("s")), 6)).filter(F.col("score") >= least)
    ranked = top_k(scored, ["context"], [F.desc("score"), F.col("id")], k)
    return ranked.select("context", "id", "score", (F.col("score") >= selected).alias("selected"), "rank")


def grade_locate(answers: DataFrame) -> DataFrame:
    """Answers (id, path, line_start, line_end, true_path, true_start, true_end) with score and failure mode."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    same = F.col("path") == F.col("true_path")
    overlap = (F.col("line_start") <= F.col("true_end")) & (F.col("true_start") <= F.col("line_end"))
    score = F.when(same & F.coalesce(overlap, F.lit(False)), 1.0).when(same | (base("path") == base("true_path")), 0.5).otherwise(0.0)
    return answers.select("id", score.alias("score"), F.when(F.col("path").isNull(), "no-location").when(score == 1, None)
                          .when(score == 0.5, "wrong-lines-or-date").otherwise("wrong-target").alias("failure"))


def fold_session_status(events: DataFrame, most: int = 3) -> DataFrame:
    """Events (session, seq, ok) folded: done at the first success, rejected at the `most`th failure; later ones don't count."""
    order = Window.partitionBy("session").orderBy("seq")
    failed = F.count_if(~F.col("ok")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = events.withColumn("failed", failed)
    ended = F.col("ok") | (F.col("failed") >= most)
    first = F.min_by(F.struct("ok", "failed"), F.when(ended, F.col("seq")))
    got = run.groupBy("session").agg(first.alias("end"), F.bool_or(ended).alias("over"), F.max("failed").alias("failed"))
    return got.select("session", F.when(~F.col("over"), "pending").when(F.col("end.ok"), "done").otherwise("rejected").alias("status"),
                      F.when(F.col("over"), F.col("end.failed")).otherwise(F.col("failed")).alias("attempts"))


def unit_seq(units: DataFrame, previous: DataFrame) -> DataFrame:
    """Units (project, unit_id, slug, pos) keep their seq; new ones follow the project's largest in (slug, pos) order."""
    top = previous.groupBy("project").agg(F.max("seq").alias("top"))
    key = ["project", "unit_id"]
    old = units.join(previous, key).select(*key, "seq")
    fresh = ranked(units.join(previous, key, "left_anti").select("project", "slug", "pos", "unit_id"), ["project"], ["slug", "pos", "unit_id"])
    return old.unionByName(fresh.join(top, "project", "left").select(*key, (F.coalesce("top", F.lit(0)) + F.col("rank")).alias("seq")))


def approval_gate(candidates: DataFrame) -> DataFrame:
    """K6: candidates (id, status, graded_before, graded_after, passed_before, passed_after, regressions) with the first reason that holds."""
    rate = F.col("passed_after") * F.col("graded_before") < F.col("passed_before") * F.col("graded_after")
    equal = F.col("graded_after") == F.col("graded_before")
    return candidates.select("id", F.when(F.col("status") == "active", "already-active").when(F.col("status") == "retired", "retired")
                             .when(F.col("graded_after").isNull(), "no-record").when(F.col("graded_after") == 0, "unmeasured")
                             .when(F.col("regressions") > 0, "regression").when(~equal & rate, "lower-rate")
                             .when(equal & (F.col("passed_after") < F.col("passed_before")), "lower-count").otherwise("approvable").alias("verdict"))
