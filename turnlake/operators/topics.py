"""Topic documents in Markdown: fences, headings, units and their ids, statements, edits and candidates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.text import overlaps, start_of
from turnlake.operators.ranking import running_sums
from turnlake.operators.search import top_k
from turnlake.operators.text_index import bm25_scores, for_all, term_classes
from turnlake.streaming.streams import shared_root

#: The shapes of Markdown lines.
FENCE = r"^ {0,3}(`{3,}|~{3,})"
FENCE_ALONE = r"^ {0,3}(`{3,}|~{3,})\s*$"
HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
DEFINITION = r"^\[\^([^\]\s]+)\]:\s*(.*)$"
REFERENCE = r"\[\^([^\]\s]+)\]"
LEVELS = range(1, 7)
#: The lines that open and close the blocks of an answer.
FILE_LINE = r"^=== FILE(?:\s+(.*))?$"
DELETE_LINE = r"^=== DELETE(?:\s+(.*))?$"
END_LINE = r"^=== END\s*$"


def fence_after(open_: Column, line: Column) -> Column:
    """The fence that is open behind a line, empty without one: one is closed by as many of its characters or more, alone."""
    opens, closes = F.regexp_extract(line, FENCE, 1), F.regexp_extract(line, FENCE_ALONE, 1)
    ended = (closes != "") & (F.substring(closes, 1, 1) == F.substring(open_, 1, 1)) & (F.char_length(closes) >= F.char_length(open_))
    return F.when(open_ == "", opens).when(ended, "").otherwise(open_)


def fence_mask(lines: Column) -> Column:
    """For each line of an array, whether it is of a code fence; one that nothing closes runs to the end."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("mask"))

    def step(s, line):
        fenced = (s["open"] != "") | (F.regexp_extract(line, FENCE, 1) != "")
        return F.struct(fence_after(s["open"], line).alias("open"), F.concat(s["mask"], F.array(fenced)).alias("mask"))

    return F.aggregate(F.transform(lines, lambda x: F.coalesce(x, F.lit(""))), start, step)["mask"]


def topic_lines(docs: DataFrame) -> DataFrame:
    """slug, line_no, line, fenced, ending for each line of documents (slug, text); null texts are empty, the last line has no ending."""
    text, newline = F.coalesce("text", F.lit("")), r"\r?\n"
    lines = docs.select("slug", F.split(text, newline).alias("ls"), F.regexp_extract_all(text, F.lit(newline), 0).alias("ends"))
    both = F.arrays_zip(F.col("ls").alias("line"), fence_mask(F.col("ls")).alias("fenced"), F.col("ends").alias("ending"))
    return lines.select("slug", F.posexplode(both).alias("line_no", "x")).select("slug", "line_no", "x.line", "x.fenced", F.coalesce("x.ending", F.lit("")).alias("ending"))


def heading_path(lines: DataFrame) -> DataFrame:
    """Lines with `heading` (its level, null for others) and `path`: the names of the open headings, joined by ` > `.

    A heading closes those of its own level and deeper ones. A document's lines meet in one task, as its text is one value.
    """
    w = Window.partitionBy("slug").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(~F.col("fenced"), F.nullif(F.char_length(F.regexp_extract("line", HEADING, 1)), F.lit(0)))
    told = lines.withColumn("heading", level)
    at = F.struct("line_no", F.regexp_extract("line", HEADING, 2).alias("name"))
    for k in LEVELS:
        told = told.withColumn(f"_{k}", F.last(F.when(F.col("heading") == k, at), True).over(w))
    names = []
    for k in LEVELS:
        place = F.col(f"_{k}.line_no")
        above = [F.coalesce(F.col(f"_{j}.line_no"), F.lit(-1)) for j in LEVELS if j < k]
        names.append(F.when(place > (F.greatest(*above) if len(above) > 1 else above[0]), F.col(f"_{k}.name")) if above else F.col("_1.name"))
    return told.withColumn("path", F.concat_ws(" > ", *names)).drop(*(f"_{k}" for k in LEVELS))


def topic_units(docs: DataFrame) -> DataFrame:
    """Slug, line_no, path, text, unit_id of each paragraph: lines between blank ones, headings, definitions and fences.

    unit_id is a last line `^id` of a paragraph of more lines, which its text then lacks; null without one.
    """
    told = heading_path(topic_lines(docs))
    breaks = F.col("fenced") | F.col("heading").isNotNull() | (F.trim("line") == "") | F.col("line").rlike(DEFINITION)
    w = Window.partitionBy("slug").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    runs = told.withColumn("_break", breaks).withColumn("_run", F.count_if("_break").over(w)).filter(~F.col("_break"))
    units = runs.groupBy("slug", "_run").agg(F.min("line_no").alias("line_no"), F.first("path").alias("path"), F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("ls"))
    unit_id = F.when(F.size("ls") > 1, F.nullif(F.regexp_extract(F.element_at("ls", -1), r"^\^(\S+)\s*$", 1), F.lit("")))
    kept = F.when(F.col("unit_id").isNull(), F.col("ls")).otherwise(F.slice("ls", 1, F.size("ls") - 1))
    return units.withColumn("unit_id", unit_id).select("slug", "line_no", "path", F.array_join(kept, "\n").alias("text"), "unit_id")


def topic_definitions(docs: DataFrame) -> DataFrame:
    """Slug, line_no, label, body, time, sources of footnote definitions, and whether the label came before or the body is malformed."""
    lines = topic_lines(docs).filter(~F.col("fenced") & F.col("line").rlike(DEFINITION))
    shape = r"^Time:\s*([^;]*?)\s*;\s*Sources:\s*(.*?)\s*$"
    body, w = F.regexp_extract("line", DEFINITION, 2), Window.partitionBy("slug", "label").orderBy("line_no")
    return lines.withColumn("label", F.regexp_extract("line", DEFINITION, 1)).select(
        "slug", "line_no", "label", F.regexp_extract(body, shape, 1).alias("time"),
        F.filter(F.transform(F.split(F.regexp_extract(body, shape, 2), ","), lambda s: F.trim(s)), lambda s: s != "").alias("sources"),
        (F.row_number().over(w) > 1).alias("repeated"), (~body.rlike(shape)).alias("malformed"))


def parse_topic_answers(answers: DataFrame) -> DataFrame:
    """Id, n, kind, slug, text of the blocks of answers (id, text), n-th in order: `file`, `delete`, or `error` for a file that nothing ends.

    Lines of a file's code fences are text, whatever they say; other lines outside the blocks are left out. An answer is one
    value, so its lines are folded in its row. Null and empty answers have no blocks.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.lit("").alias("fence"), F.array().cast("array<struct<n:int,role:string,line:string>>").alias("out"))

    def step(s, line):
        file, delete, held = line.rlike(FILE_LINE), line.rlike(DELETE_LINE), s["fence"] != ""
        ends = s["open"] & ~held & line.rlike(END_LINE)
        text = s["open"] & (held | (~file & ~delete & ~ends))
        opener = ~text & ~ends & (file | delete)
        role = F.when(text, "text").when(ends, "end").when(opener & file, "file").when(opener, "delete").otherwise("other")
        n = s["n"] + opener.cast("int")
        return F.struct(n.alias("n"), F.when(opener, file).otherwise(s["open"] & ~ends).alias("open"), F.when(text, fence_after(s["fence"], line)).otherwise("").alias("fence"),
                        F.concat(s["out"], F.array(F.struct(n.alias("n"), role.alias("role"), line.alias("line")))).alias("out"))

    told = answers.select("id", F.posexplode(F.aggregate(lines, start, step)["out"]).alias("at", "x")).select("id", "at", "x.*").filter("role <> 'other'")
    is_ = lambda r: F.col("role") == r
    texts = F.transform(F.array_sort(F.collect_list(F.when(is_("text"), F.struct("at", "line")))), lambda x: x["line"])
    shape = F.when(is_("file"), F.regexp_extract("line", FILE_LINE, 1)).when(is_("delete"), F.regexp_extract("line", DELETE_LINE, 1))
    blocks = told.groupBy("id", "n").agg(F.max(F.regexp_replace(shape, r"^\s+|\s+$", "")).alias("slug"), F.max(is_("delete")).alias("gone"), F.max(is_("end")).alias("ended"), texts.alias("ls"))
    kind = F.when(F.col("gone"), "delete").when(F.col("ended"), "file").otherwise("error")
    return blocks.select("id", "n", kind.alias("kind"), "slug", F.when(kind == "file", F.concat(F.array_join("ls", "\n"), F.lit("\n"))).alias("text"))


def assign_unit_ids(units: DataFrame, digits: int = 8) -> DataFrame:
    """Units (project, slug, line_no, text, and unit_id where they have one) with `unit_id`: hex digits of a hash of project, slug and text.

    Units without one choose in the order of slug and line: the hash, or that with the least number behind it, which no
    other has. All choose at once, and the later of two with one id chooses on, which ends at the same ids; each round
    looks only at what moved and whom it met.
    """
    spark, base = units.sparkSession, f"{shared_root(units.sparkSession)}/unit-ids-{uuid.uuid4().hex}"
    key = ["project", "slug", "line_no"]
    given = F.col("unit_id") if "unit_id" in units.columns else F.lit(None).cast("string")

    def hashed(n: Column) -> Column:
        parts = F.concat_ws("\0", "project", "slug", "text")
        return F.substring(F.sha1(F.when(n == 0, parts).otherwise(F.concat_ws("\0", parts, n.cast("string"))).cast("binary")), 1, digits)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    # the n-th repetition of a paragraph can't get one of the first n ids, so it starts behind them
    order = Window.partitionBy("project", "slug", "text", "fixed").orderBy("line_no")
    first = units.withColumn("fixed", given.isNotNull()).withColumn("turn", F.when(~F.col("fixed"), F.row_number().over(order) - 1))
    first = kept(first.withColumn("unit_id", F.coalesce(given, hashed(F.col("turn")))), "first")
    place = F.struct(~F.col("fixed"), F.col("slug"), F.col("line_no"))
    columns = ["project", "slug", "line_no", "text", "fixed", "turn", "unit_id"]

    def decided(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("project", "unit_id").agg(F.min(place).alias("best"))
        return rows.join(best, ["project", "unit_id"]).withColumn("stays", F.col("fixed") | (place == F.col("best"))).select(*columns, "stays")

    # only ids that several have are looked at
    shared = first.groupBy("project", "unit_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("project", "unit_id")
    met = kept(decided(first.join(shared, ["project", "unit_id"], "left_semi").select(*columns)), "met-0")
    moved, round_ = None, 0
    while True:
        moving = met.filter("NOT stays").drop("stays").withColumn("turn", F.col("turn") + 1)
        moving = moving.withColumn("unit_id", hashed(F.col("turn")))
        # what has moved before, now where it is
        settled = met.filter("stays AND NOT fixed AND turn IS NOT NULL").drop("stays")
        moved = settled if moved is None else moved.join(met.select(*key), key, "left_anti").unionByName(settled)
        moved = kept(moved, f"moved-{round_}")
        if met.filter("NOT stays").isEmpty():
            break
        round_ += 1
        moving = kept(moving, f"moving-{round_}")
        landing = moving.select("project", "unit_id").distinct()
        there = first.select(*columns).join(moved.select(*key), key, "left_anti").join(moving.select(*key), key, "left_anti").unionByName(moved)
        met = kept(decided(there.join(landing, ["project", "unit_id"], "left_semi").unionByName(moving)), f"met-{round_}")
    now = moved.select(*key, F.col("unit_id").alias("_new"))
    return first.drop("fixed", "turn").join(now, key, "left").withColumn("unit_id", F.coalesce("_new", "unit_id")).drop("_new")


def footnote_statements(units: DataFrame, key: str) -> DataFrame:
    """Key, label, statement: what stands between a label's first reference and the reference before; all of the text if that is nothing."""
    pieces = F.arrays_zip(F.regexp_extract_all("text", F.lit(REFERENCE), 1).alias("label"), F.split("text", REFERENCE, -1).alias("piece"))
    each = units.select(key, "text", F.posexplode(pieces).alias("i", "p")).filter("p.label IS NOT NULL")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    said = F.coalesce(F.nullif(trimmed(F.col("p.piece")), F.lit("")), trimmed(F.col("text")))
    return each.groupBy(key, F.col("p.label").alias("label")).agg(F.min_by(said, "i").alias("statement"))


def install_edit(docs: DataFrame, shown: DataFrame, edit: DataFrame) -> DataFrame:
    """Documents (slug, text, updated_at) after an edit (slug, text: null deletes, updated_at), or as they were if it is stale.

    Stale: a shown document (slug, updated_at) is missing or was updated since. The decision is one row.
    """
    now = docs.select("slug", F.col("updated_at").alias("_now"))
    stale = shown.join(now, "slug", "left").agg(F.coalesce(F.bool_or(F.coalesce(F.col("_now") != F.col("updated_at"), F.lit(True))), F.lit(False)).alias("stale"))
    old, new = docs.select("slug", "text", "updated_at"), edit.select("slug", "text", "updated_at")
    given = new.withColumn("_new", F.lit(True)).select("slug", F.struct("text", "updated_at", "_new").alias("e"))
    both = old.select("slug", F.struct("text", "updated_at").alias("o")).join(given, "slug", "full").crossJoin(F.broadcast(stale))
    take = F.col("e._new") & ~F.col("stale")
    pick = lambda c: F.when(take, F.col(f"e.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.filter(F.when(take, F.col("e.text").isNotNull()).otherwise(F.col("o").isNotNull())).select("slug", pick("text"), pick("updated_at"))


def topic_candidates(sessions: DataFrame, status: DataFrame, since: str, quiet_before: str, limit: int = 3) -> DataFrame:
    """The oldest sessions (session_id, start_ts, last_ts, trivial) since a time that are quiet, not trivial, and neither done nor rejected."""
    over = status.filter("state IN ('done', 'rejected')").select("session_id")
    own = sessions.filter((F.col("start_ts") >= since) & (F.col("last_ts") <= quiet_before) & ~F.col("trivial"))
    return own.join(over, "session_id", "left_anti").orderBy("start_ts", "session_id").limit(limit)


def choose_shown_docs(docs: DataFrame, by: str, most: int, line: int = 240) -> DataFrame:
    """Documents (by, slug, title, headings, text, updated_at), the last updated first, with the `inventory` line and whether the text is `shown`.

    A text is shown while those up to it have at most `most` characters in all. Null headings are none.
    """
    entry = F.concat(F.lit("- "), "slug", F.lit(": "), "title", F.lit(" | "), F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " / "))
    cut = F.when(F.char_length(entry) > line, F.concat(F.substring(entry, 1, line - 1), F.lit("…"))).otherwise(entry)
    sized = docs.select(by, "slug", "updated_at", cut.alias("inventory"), F.char_length("text").alias("size"))
    return running_sums(sized, [by], [F.desc("updated_at"), F.asc("slug")], "size").select(by, "slug", "inventory", (F.col("total") <= most).alias("shown"))


def event_times(events: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """unit_id, times of the events (unit_id, time) that meet a range, by their start and then as written."""
    return events.filter(overlaps(F.col("time"), F.lit(first), F.lit(last))).groupBy("unit_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(start_of(F.col("time")).alias("start"), "time"))), lambda x: x["time"]).alias("times"))


def _best_units(hits: DataFrame, met: DataFrame, k: int) -> DataFrame:
    best = top_k(hits, ["query_id"], [F.desc("score"), F.col("unit_id")], k).join(met, "unit_id", "left")
    return best.select("query_id", "unit_id", "score", F.coalesce("times", F.array().cast("array<string>")).alias("times"), "rank")


def search_topics(hits: DataFrame, events: DataFrame, k: int, first: str | None = None, last: str | None = None) -> DataFrame:
    """query_id, unit_id, score, times, rank: of scored hits (query_id, unit_id, score) the best k a query.

    With a range only units with an event (unit_id, time) in it, before the limit; `times` are those of such events, all
    without a range, by their start and then as written.
    """
    met = event_times(events, first, last)
    return _best_units(hits if first is None and last is None else hits.join(met.select("unit_id"), "unit_id", "left_semi"), met, k)


def search_units(queries: DataFrame, postings: DataFrame, events: DataFrame, k: int, first: str | None = None, last: str | None = None) -> DataFrame:
    """J11 of queries (query_id, text) over postings by unit_id: search_topics() of their hits, where units without an event in the range are not scored.

    Counts are over all units. Queries of the same terms are answered once.
    """
    own, members = term_classes(queries)
    met = event_times(events, first, last).persist()
    hits = bm25_scores(own, postings, "unit_id", among=None if first is None and last is None else met)
    return for_all(_best_units(hits, met, k), members)


def timeline_order() -> list[Column]:
    """Q7: by the start of the interval, then the time as written, then the unit's place."""
    return [F.asc("start"), F.asc("time"), F.asc("seq")]
