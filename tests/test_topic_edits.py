"""Links and events of topic documents, checks of edits, searches with ranges and hidden lines, and running sums."""

import random

import pytest
from pyspark.sql import functions as F

from turnlake.operators import learning, ranking, text_index, topic_edits, topics


@pytest.mark.parametrize(("text", "want"), [
    (None, ""), ("", ""), ("a [x](old.md#^u1) b", "a [x](new.md#^u1) b"), ("[x](old.md#^u2)", "[x](old.md#^u2)"), ("[over\r\nlines](old.md#^u1)\r\nend\r\n", "[over\r\nlines](new.md#^u1)\r\nend\r\n"),
    ("# [x](old.md#^u1)\n[y](old.md#^u1)[z](b.md#^u3)", "# [x](old.md#^u1)\n[y](new.md#^u1)[z](c.md#^u3)"), ("[^1]: [x](old.md#^u1)\n```\n[x](old.md#^u1)\n```\n[x](old.md#^u1)", "[^1]: [x](old.md#^u1)\n```\n[x](old.md#^u1)\n```\n[x](new.md#^u1)"),
    ("[open\n# cut\n](old.md#^u1)", "[open\n# cut\n](old.md#^u1)"), ("](old.md#^u1)", "](old.md#^u1)"), ("[a]\n\n\n[x](old.md#^u1)", "[a]\n\n\n[x](new.md#^u1)")])
def test_links_follow_their_units(spark, text, want):
    docs = spark.createDataFrame([("d", text)], "slug string, text string")
    units = spark.createDataFrame([("u1", "new"), ("u3", "c")], "unit_id string, slug string")
    assert [r["text"] for r in topic_edits.rewrite_link_slugs(docs, units).collect()] == [want]


@pytest.mark.parametrize(("sources", "want"), [("1", "#a"), (" 01 ,2, x,,9", " #a ,#b, x,,9"), ("1 2", "1 2"), ("#1", "#1")])
def test_marks_keep_what_stands_around_them(spark, sources, want):
    docs = spark.createDataFrame([("d", f"[^1]: Time: 2024; Sources:{sources}\r\nSources: 1")], "slug string, text string")
    marks = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "slug string, mark int, id string")
    assert topic_edits.rewrite_marks(docs, marks).first()["text"] == f"[^1]: Time: 2024; Sources:{want}\r\nSources: 1"


def test_link_targets(spark):
    text = "see [a](b.md#^1) [c](d.md) [e](https://x.y/z.md) [f](g.md#h)\nand [i](j.md#^) [k](l.txt)\n^0000000a\n\n# [h](b.md#^2)"
    got = topic_edits.topic_links(spark.createDataFrame([("s", text), ("e", None)], "slug string, text string")).collect()
    assert {(r["unit_id"], r["to_slug"], r["to_unit"], r["malformed"]) for r in got} == {
        ("0000000a", "b", "1", None), ("0000000a", "j", "", None), ("0000000a", None, None, "d.md"), ("0000000a", None, None, "g.md#h")}


GOOD = "# Title\n\nsaid [^1]\n^0000000a\n\nmore [b](b.md#^0000000b) [^2]\n^0000000c\n\n[^1]: Time: 2024-02-29; Sources: #e1, #e2\n[^2]: Time: 2024; Sources: #e3\n"
OTHER = "# Other\n\nhere [^1]\n^0000000b\n\n[^1]: Time: 2024-05; Sources: #e4\n"


@pytest.mark.parametrize(("blocks", "shown", "want"), [
    ([], [], []), ([("file", "a", GOOD)], ["a"], []), ([("delete", "b", None)], ["b"], [("a", 9, "broken link"), ("b", 11, "lost citation")]),
    ([("file", "a", GOOD)], [], [("a", 3, "not shown")]), ([("delete", "c", None), ("file", "B_", "x"), ("file", "example-topic", "x")], [], [("B_", 1, "bad slug"), ("c", 2, "nothing to delete"), ("example-topic", 1, "slug of the example")]),
    ([("file", "a", "```\nx\n```\n" + GOOD)], ["a"], [("a", 4, "title not first")]), ([("file", "a", "\n \n" + GOOD + "# Again")], ["a"], [("a", 4, "no single title")]),
    ([("file", "a", GOOD.replace("02-29", "02-30"))], ["a"], [("a", 6, "bad time")]), ([("file", "a", GOOD.replace("#e1", "7, z, #no, #e1"))], ["a"], [("a", 7, "malformed source"), ("a", 7, "unknown mark"), ("a", 7, "unknown source")]),
    ([("file", "a", GOOD.replace("[^2]\n", "[^1]\n"))], ["a"], [("a", 5, "label used again"), ("a", 5, "unused label")]), ([("file", "a", GOOD.replace("more", "more [^3]"))], ["a"], [("a", 5, "undefined label")]),
    ([("file", "a", GOOD.replace("^0000000c", "^0000000b"))], ["a"], [("b", 8, "repeated unit id")]), ([("file", "a", GOOD.replace("^0000000c", "^C"))], ["a"], [("a", 8, "bad unit id")]),
    ([("file", "a", GOOD.replace("said [^1]\n^0000000a", "said"))], ["a"], [("a", 5, "paragraph without reference"), ("a", 5, "unused label"), ("a", 8, "no unit id")]),
    ([("file", "a", GOOD.replace("(b.md#^0000000b)", "(b.md)"))], ["a"], [("a", 9, "malformed link")]), ([("file", "a", GOOD + "z" * 300 + "[^4]\n^0000000d\n\n[^4]: Time: 2024; Sources: #e1")], ["a"], [("a", 10, "too long")]),
    ([("file", "c", OTHER.replace("b\n", "d\n")), ("file", "d", OTHER.replace("b\n", "e\n"))], [], [("(project)", 10, "too many documents")]),
    ([("file", "a", "x"), ("file", "a", GOOD)], ["a"], [("a", 1, "repeated slug")]), ([("file", "a", GOOD.replace("Time: 2024; ", ""))], ["a"], [("a", 5, "malformed definition"), ("a", 6, "bad time"), ("a", 7, "no source"), ("a", 11, "lost citation")])])
def test_edits(spark, blocks, shown, want):
    before = spark.createDataFrame([("a", GOOD), ("b", OTHER)], "slug string, text string")
    told = spark.createDataFrame([(i, *b) for i, b in enumerate(blocks)], "n int, kind string, slug string, text string")
    ex = spark.createDataFrame([(f"e{i}",) for i in range(1, 5)], "id string")
    got = topic_edits.validate_topic_edit(before, told, spark.createDataFrame([(s,) for s in shown], "slug string"), ex, 400, 3).collect()
    assert sorted((r["slug"], r["check"], r["error"]) for r in got) == sorted(want)


def test_units_in_a_range(spark):
    hits = spark.createDataFrame([("q", u, s) for u, s in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "query_id string, unit_id string, score double")
    events = spark.createDataFrame([("b", "2024-03-05"), ("b", "2024"), ("b", "2024-03"), ("c", "2024-03"), ("a", "2023")], "unit_id string, time string")
    found = lambda *a: [(r["unit_id"], r["times"], r["rank"]) for r in topics.search_topics(hits, events, *a).orderBy("rank").collect()]
    assert found(1, "2024-03", None) == [("b", ["2024", "2024-03", "2024-03-05"], 1)]
    assert found(2) == [("a", ["2023"], 1), ("b", ["2024", "2024-03", "2024-03-05"], 2)] and found(3, "2025", "2026") == []
    assert topics.search_topics(hits, events.limit(0), 3).count() == 3


def test_digests_without_hidden_lines(spark):
    entries = spark.createDataFrame([(1, "p", "red fox [#x]\nred hen", None), (2, "p", "red fox [#y, #x]", None), (3, "q", "red fox", None), (4, "p", "red fox", 3), (5, None, None, None)], "id int, project string, text string, superseded_by int")
    queries = spark.createDataFrame([(1, "red FOX", None), (2, "fox", "q"), (3, "hen fox", "p"), (4, "none", None)], "query_id int, text string, project string")
    hidden = spark.createDataFrame([("x",), ("x",)], "id string")
    found = lambda h, k: {(r["query_id"], r["id"], r["text"]) for r in text_index.search_digest(queries, entries, h, k).collect()}
    assert found(hidden, 9) == {(1, 1, "red hen"), (1, 3, "red fox"), (2, 3, "red fox"), (3, 1, "red hen")}
    assert {(q, i) for q, i, _ in found(hidden.limit(0), 9)} == {(1, 1), (1, 2), (1, 3), (2, 3), (3, 1)}
    # the limit is before the hiding
    assert len(found(hidden, 1)) == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_running_sums_of_a_hot_group(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 9 + ["cold", None]), i, rnd.choice([None, 0, 1, 5, 7])) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(7)
    got = {(r["g"], r["at"]): r["total"] for r in ranking.running_sums(df, ["g"], [F.desc("at")], "v").collect()}
    want, sums = {}, {}
    for g, at, v in sorted(rows, key=lambda r: -r[1]):
        sums[g] = sums.get(g, 0) + (v or 0)
        want[g, at] = sums[g]
    assert got == want and ranking.running_sums(df.limit(0), ["g"], [F.desc("at")], "v").count() == 0


def test_snapshots(spark):
    rows = [(1, "k", "active", None), (2, "k", "candidate", None), (3, "m", "active", None), (4, "m", "active", 3), (5, "n", "retired", None)]
    entries = spark.createDataFrame(rows, "id int, key string, status string, superseded_by int")
    ids = lambda c: sorted(r["id"] for r in learning.snapshot_ids(entries, c, ["key"]).collect())
    assert ids(None) == [1, 3] and ids(2) == [2, 3] and ids(9) == [1, 3]
