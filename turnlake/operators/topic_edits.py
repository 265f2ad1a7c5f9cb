"""Links, events and checks of topic documents (slug, text) of one project."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.text import is_valid_time, overlaps, start_of
from turnlake.operators.ranking import ranked
from turnlake.operators.topics import DEFINITION, HEADING, REFERENCE, footnote_statements, heading_path, topic_definitions, topic_lines, topic_units
from turnlake.streaming.streams import shared_root

#: Links to a unit, other targets in Markdown files, and the shapes of sources, slugs and unit ids.
LINK = r"\[[^\]]*\]\(([^()\s#]+)\.md#\^([^()\s]*)\)"
MD_TARGET = r"\]\(([^()\s]*\.md(?:#[^()\s]*)?)\)"
WELL_FORMED = r"^[^()\s#]+\.md#\^[^()\s]*\z"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
SOURCES = r"^(\[\^[^\]\s]+\]:\s*Time:\s*[^;]*;\s*Sources:\s*)(.*?)(\s*)$"
SLUG = r"^[a-z0-9][a-z0-9-]{0,63}\z"
EXAMPLE_SLUG = "example-topic"
UNIT_ID = r"^[0-9a-f]{8}\z"
#: The characters of a document and the documents of a project at most.
MAX_CHARS, MAX_DOCS = 8000, 50
#: What stands for the slug in errors of all documents together.
PROJECT = "(project)"


def joined(lines: DataFrame, by: list[str], line) -> DataFrame:
    """by, text: the lines in order, each with its own ending."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.concat(line, "ending").alias("line"))))
    return lines.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("text"))


def topic_links(docs: DataFrame) -> DataFrame:
    """Slug, line_no, unit_id, n, to_slug, to_unit, malformed of the links of units, n-th of its kind in the unit.

    A link names a unit; another target in a Markdown file that is no address is `malformed`, and names none.
    """
    units = topic_units(docs)
    found = lambda g: F.regexp_extract_all("text", F.lit(LINK), g)
    links = units.select("slug", "line_no", "unit_id", F.posexplode(F.arrays_zip(found(1).alias("to_slug"), found(2).alias("to_unit"))).alias("n", "x")).select(
        "slug", "line_no", "unit_id", "n", "x.*", F.lit(None).cast("string").alias("malformed"))
    bad = F.filter(F.regexp_extract_all("text", F.lit(MD_TARGET), 1), lambda t: ~t.rlike(WELL_FORMED) & ~t.rlike(SCHEME))
    none = F.lit(None).cast("string")
    others = units.select("slug", "line_no", "unit_id", F.posexplode(bad).alias("n", "malformed")).select("slug", "line_no", "unit_id", "n", none.alias("to_slug"), none.alias("to_unit"), "malformed")
    return links.unionByName(others)


def rewrite_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """T4: slug, text with the bare numbers in the Sources of definitions as #id where `marks` (slug, mark, id) knows them; fences stay."""
    known = marks.groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct(F.col("mark").cast("string"), "id"))).alias("known"))
    lines = topic_lines(docs).join(known, "slug", "left")

    def part(s):
        told = F.try_element_at("known", F.regexp_extract(s, r"^\s*0*(\d+)\s*$", 1))
        return F.when(told.isNotNull(), F.concat(F.regexp_extract(s, r"^\s*", 0), F.lit("#"), told, F.regexp_extract(s, r"\s*$", 0))).otherwise(s)

    got = lambda g: F.regexp_extract("line", SOURCES, g)
    line = F.when(~F.col("fenced") & F.col("line").rlike(SOURCES), F.concat(got(1), F.array_join(F.transform(F.split(got(2), ","), part), ","), got(3))).otherwise(F.col("line"))
    return joined(lines, ["slug"], line)


def rewrite_link_slugs(docs: DataFrame, units: DataFrame) -> DataFrame:
    """T4: slug, text with the slug of each link as that of the document that holds its unit now, where `units` (unit_id, slug) knows it.

    A link's text may run over lines, so lines of prose are looked at together; headings, definitions and fences stay.
    """
    prose = ~F.col("fenced") & ~F.col("line").rlike(HEADING) & ~F.col("line").rlike(DEFINITION)
    w = Window.partitionBy("slug").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = topic_lines(docs).withColumn("prose", prose).withColumn("run", F.count_if(~F.col("prose")).over(w))
    runs = joined(lines, ["slug", "run", "prose"], F.col("line"))
    found = lambda g: F.when(F.col("prose"), F.regexp_extract_all("text", F.lit(LINK), g)).otherwise(F.array().cast("array<string>"))
    told = runs.select("slug", "run", "prose", F.explode(F.array_distinct(found(2))).alias("unit_id")).join(units.select("unit_id", F.col("slug").alias("now")), "unit_id")
    told = told.groupBy("slug", "run", "prose").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "now"))).alias("known"))

    def link(x):
        now, cut = F.try_element_at("known", x["unit"]), F.locate("](", x["whole"]) + 1
        return F.when(now.isNull(), x["whole"]).otherwise(F.concat(F.substring(x["whole"], F.lit(1), cut), now, F.substring(x["whole"], cut + 1 + F.char_length(x["old"]), F.char_length(x["whole"]))))

    zipped = F.arrays_zip(F.split("text", LINK, -1).alias("piece"), found(0).alias("whole"), found(1).alias("old"), found(2).alias("unit"))
    new = F.array_join(F.transform(zipped, lambda x: F.concat(x["piece"], F.coalesce(link(x), F.lit("")))), "")
    rows = runs.join(told, ["slug", "run", "prose"], "left").select("slug", "run", "prose", F.when(F.col("known").isNull(), F.col("text")).otherwise(new).alias("text"))
    # the line that ends a run is before the run that has its number
    ordered = F.array_sort(F.collect_list(F.struct("run", "prose", "text")))
    return rows.groupBy("slug").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def topic_events(docs: DataFrame) -> DataFrame:
    """slug, line_no, unit_id, path, label, time, statement, sources: each label of a unit with its first definition in the document and the statement it supports."""
    units = topic_units(docs).withColumn("unit", F.struct("slug", "line_no"))
    defined = topic_definitions(docs).filter("NOT repeated").select("slug", "label", "time", "sources")
    told = footnote_statements(units, "unit").join(units.select("unit", "slug", "line_no", "unit_id", "path"), "unit")
    return told.join(defined, ["slug", "label"]).select("slug", "line_no", "unit_id", "path", "label", "time", "statement", "sources")


def topic_timeline(events: DataFrame, by: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """Events (topic_events, more columns in `by`) that meet a range of times, with their `place` (Q7) in each group `by`."""
    met = events.filter(overlaps(F.col("time"), F.lit(first), F.lit(last))).withColumn("start", start_of(F.col("time")))
    return ranked(met, by, ["start", "time", "slug", "line_no", "label"]).withColumnRenamed("rank", "place").drop("size")


def validate_topic_edit(before: DataFrame, blocks: DataFrame, shown: DataFrame, ex: DataFrame, max_chars: int = MAX_CHARS, max_docs: int = MAX_DOCS) -> DataFrame:
    """T5: slug, check, error, n: what is wrong with an edit, by check.

    before: documents (slug, text); blocks: n, kind (file, delete), slug, text, as T11 gives them; shown: slugs of the
    documents that the writer saw; ex: ids of exchanges. Of several blocks of a slug the last decides. Structure, times,
    sources and sizes are checked in written documents; unit ids, links and lost citations over all documents after the edit.
    """
    spark, base = before.sparkSession, f"{shared_root(before.sparkSession)}/topic-edit-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    told = blocks.filter("kind IN ('file', 'delete')").select("n", "kind", F.coalesce("slug", F.lit("")).alias("slug"), F.coalesce("text", F.lit("")).alias("text"))
    bad, example = ~F.col("slug").rlike(SLUG), (F.col("kind") == "file") & (F.col("slug") == EXAMPLE_SLUG)
    valid = told.filter(~bad & ~example)
    last = valid.groupBy("slug").agg(F.count(F.lit(1)).alias("blocks"), F.max_by(F.struct("kind", "text"), "n").alias("x")).select("slug", "blocks", "x.*")
    old, new = before.select("slug", "text"), last.filter("kind = 'file'").select("slug", "text")
    after = kept(old.join(last, "slug", "left_anti").withColumn("written", F.lit(False)).unionByName(new.withColumn("written", F.lit(True))), "after")
    written = after.filter("written")
    units = kept(topic_units(after).select(
        "slug", "line_no", "unit_id", F.regexp_extract_all("text", F.lit(REFERENCE), 1).alias("refs")).join(after.select("slug", "written"), "slug"), "units")
    defined = kept(topic_definitions(after).join(after.select("slug", "written"), "slug"), "definitions")
    links = topic_links(after)
    own, notes = units.filter("written"), defined.filter("written")

    # the first line that is not blank has to be the only title
    items = heading_path(topic_lines(written)).filter(F.col("fenced") | F.col("line").rlike(r"\S"))
    titles = items.groupBy("slug").agg(F.count_if(F.col("heading") == 1).alias("h1"), F.min_by(F.coalesce(F.col("heading") == 1, F.lit(False)), "line_no").alias("first"))
    titles = written.select("slug").join(titles, "slug", "left").select("slug", F.coalesce("h1", F.lit(0)).alias("h1"), F.coalesce("first", F.lit(False)).alias("first"))
    used = own.select("slug", F.explode("refs").alias("label")).groupBy("slug", "label").agg(F.count(F.lit(1)).alias("uses"))
    labels = notes.select("slug", "label").distinct()
    refs = notes.select("slug", F.explode("sources").alias("ref"))
    cited = lambda d: d.select("slug", F.explode("sources").alias("ref")).filter("startswith(ref, '#')").groupBy(F.expr("substr(ref, 2)").alias("id")).agg(F.min("slug").alias("slug"))
    sourced = refs.filter(r"ref RLIKE '^#\\S+\\z'").select("slug", F.expr("substr(ref, 2)").alias("id"))
    sound = units.filter(F.col("unit_id").rlike(UNIT_ID))
    owners = kept(sound.groupBy("unit_id").agg(F.min(F.struct("slug", "line_no")).alias("owner")), "owners")
    missing = lambda df, there, on: df.join(there.select(on).distinct(), on, "left_anti")
    several = after.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs).select(F.lit(PROJECT).alias("slug"))

    found = [
        (1, "bad slug", told.filter(bad)), (1, "slug of the example", told.filter(~bad & example)), (1, "repeated slug", last.filter("blocks > 1")),
        (2, "nothing to delete", missing(valid.filter("kind = 'delete'"), old, "slug")), (3, "not shown", missing(valid.join(old.select("slug"), "slug", "left_semi"), shown, "slug")),
        (4, "no single title", titles.filter("h1 <> 1")), (4, "title not first", titles.filter("h1 = 1 AND NOT first")),
        (5, "malformed definition", notes.filter("malformed")), (5, "repeated label", notes.filter("repeated")), (5, "paragraph without reference", own.filter(F.size("refs") == 0)),
        (5, "undefined label", used.join(labels, ["slug", "label"], "left_anti")), (5, "label used again", used.filter("uses > 1")), (5, "unused label", notes.join(used, ["slug", "label"], "left_anti")),
        (6, "bad time", notes.filter(~is_valid_time(F.col("time")))), (7, "no source", notes.filter(F.size("sources") == 0)), (7, "unknown mark", refs.filter(r"ref RLIKE '^\\d+\\z'")),
        (7, "unknown source", missing(sourced, ex, "id")), (7, "malformed source", refs.filter(r"NOT ref RLIKE '^\\d+\\z' AND NOT ref RLIKE '^#\\S+\\z'")),
        (8, "no unit id", units.filter("unit_id IS NULL")), (8, "bad unit id", units.filter(~F.col("unit_id").rlike(UNIT_ID))),
        (8, "repeated unit id", sound.join(owners, "unit_id").filter(F.struct("slug", "line_no") != F.col("owner"))),
        (9, "broken link", missing(links.filter("malformed IS NULL").withColumnRenamed("unit_id", "of").withColumnRenamed("to_unit", "unit_id"), owners, "unit_id")),
        (9, "malformed link", links.filter("malformed IS NOT NULL")), (10, "too long", written.filter(F.char_length("text") > max_chars)), (10, "too many documents", several),
        # a citation may move to another document, but not go
        (11, "lost citation", missing(cited(topic_definitions(before)), cited(defined), "id")),
    ]
    rows = None
    for check, name, df in found:
        one = df.select("slug", F.lit(check).alias("check"), F.lit(name).alias("error"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("slug", "check", "error").agg(F.count(F.lit(1)).alias("n"))
