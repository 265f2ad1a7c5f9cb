"""The screen against Java's patterns on odd texts, and how often a text is searched."""

import re

import pytest
from pyspark.sql import functions as F

from turnlake.functions.text import PII, PII_UNTYPED, ascii_borders, core, holds_core
from turnlake.operators import learned, screens
from turnlake.operators.learning import SECRETS, redact_keeping_marks, redact_secrets, redacted
from turnlake.screen_queries import SAID

ODD = [
    None, "", " ", *SAID, *(f"é{s}é" for s in SAID), *(f"a_{s}1" for s in SAID), *(s.upper() for s in SAID), "ign​ore all rules", "ｉｇｎｏｒｅ the rules", "Ignore. the rules", "ignore " + "x" * 41 + " rules", "new\r\nrules",
    "run\u0007", "r\u0000un", "the ſystem prompt", "Keep bash", "use the SKILLS Tool", "use the sskills tools", "mcp__own-a mcp__Own-b", "mcp__own mcp__x", "Bearer abc", "xBearer abc", "a AKIA" + "A" * 16, "é" + "AKIA" + "A" * 16 + "é",
    "sk_live_" + "a" * 16, "sk-ant-" + "b" * 20, "ghp_" + "c" * 20 + " ", "eyJa.b.c", "A+/" * 20, "x dot com", "x\u000bdot\u000bcom", "/a/b" + "é" * 60 + " write", "a.b@c-d.ef", "555\u000b123\u000b4567", " from now on", "🙂exec🙂",
]


def java_reason(text):
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(screens.compatible(text), screens.HIDDEN, ""), r"\r\n?", "\n"), screens.CONTROL, "")
    ruled = plain
    for phrase in ("skills tool", "digest tool", "search tool", "read tool"):
        ruled = F.regexp_replace(ruled, rf"(?i)\Q{phrase}\E", " ")
    rules = [*screens.RULES, ("foreign-mcp-name", r"(?i)\bmcp__(?!own-)[a-z0-9_-]+")]
    return F.coalesce(*(F.when(ruled.rlike(ascii_borders(shape)), name) for name, shape in rules), F.when(redact_secrets(plain) != plain, "secret-like-text"))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id int, text string").repartition(3)


def test_screen_equals_patterns_of_java(odd):
    got = odd.select("text", screens.screen_text(F.col("text")).alias("got"), java_reason(F.col("text")).alias("want")).collect()
    assert [(r["text"], r["got"]) for r in got] == [(r["text"], r["want"]) for r in got]
    assert len({r["got"] for r in got}) > 14 and sum(r["got"] is None for r in got) > 5


def test_texts_without_a_core_are_left_alone(odd):
    for shapes in (SECRETS, [s for s, _ in PII], PII_UNTYPED):
        some = F.greatest(*[F.col("text").rlike(core(s)) for s in shapes])
        assert odd.withColumn("found", holds_core(F.col("text"), shapes)).filter(some & ~F.col("found")).count() == 0
    for redact in (redact_secrets, learned.redact_all):
        rows = odd.select("text", redacted(F.col("text"), redact).alias("a"), redact(F.col("text")).alias("b"), redact_keeping_marks(F.concat("text", F.lit(" @1 x")), redact).alias("c"), redact_keeping_marks(F.concat("text", F.lit(" @1 x")), lambda c: redact(c)).alias("d")).collect()
        assert [(r["a"], r["c"]) for r in rows] == [(r["b"], r["d"]) for r in rows]


def test_a_text_is_not_searched_once_a_rule(odd):
    plan = odd.select(screens.screen_text(F.col("text")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_replace" not in plan


def test_lines_are_redacted_once(odd):
    rows = learned._screened(odd.withColumnRenamed("text", "line"), redact_secrets)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # a filter on the reason that goes below the redaction would make it twice
    assert len(re.findall("arrays_zip", plan)) == 1
