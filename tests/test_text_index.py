"""Stems, folded letters and phrases."""

import duckdb
import pytest

from turnlake.functions.stems import stem, stems_sql
from turnlake.operators import text_index as I

#: Words and stems of the published description of the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll yes ye toy toi by by as as""".split()


def test_stems_equal_the_published_table():
    words, want = STEMS[0::2], STEMS[1::2]
    got = [stem(w) for w in words]
    assert got == want
    quoted = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    assert duckdb.sql(f"SELECT {stems_sql(quoted)}").fetchall()[0][0] == got


@pytest.fixture(scope="module")
def postings(spark):
    docs = [(1, "The quick foxes were jumping over it", "a_b"), (2, "jumped fox quick", "b a"), (3, "Crème brûlée, jump quickly", None), (4, "quick quick fox fox", "a b"), (5, None, "")]
    return I.postings_of(I.analysed_texts(spark.createDataFrame(docs, "id int, text string, title string"), "id", ["text", "title"]), "id").persist()


@pytest.mark.parametrize(("text", "want"), [
    ("quick fox", [4, 2, 1]), ("quick_fox", [4, 1]), ("fox a_b", [4, 1]), ("JUMPS", [3, 2, 1]), ("creme BRULEE", [3]), ("creme_brulee", [3]), ("a b", [4, 2, 1]), ("b_a", [2]), ("quick_quick", [4]),
    ("quick_quick_quick", []), ("fox unknown", []), ("?! ...", []), ("", []), ("__", []), ("fox fox fox", [4, 2, 1]), ("Creme\u0301 \u0301", [3])])
def test_phrases(spark, postings, text, want):
    asked = spark.createDataFrame([(7, text)], "query_id int, text string")
    got = sorted((r["rank"], r["id"]) for r in I.text_search(asked, postings, "id", 10).collect())
    assert [i for _, i in got] == want


def test_newest_and_limit(spark, postings):
    asked = spark.createDataFrame([(7, "quick"), (8, "jump")], "query_id int, text string")
    newest = spark.createDataFrame([(1, "2024"), (2, "2023"), (3, "2025")], "id int, newest string")
    got = {(r["query_id"], r["rank"]): r["id"] for r in I.text_search(asked, postings, "id", 1, newest=newest).collect()}
    assert got == {(7, 1): 1, (8, 1): 3}


def test_saved_postings_are_not_moved(spark, postings):
    saved = I.save_postings(postings, "postings_by_term", 4)
    terms = spark.createDataFrame([("quick",), ("fox",)], "term string").repartition(4, "term")
    plan = saved.hint("merge").join(terms, "term")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    assert sorted(r["id"] for r in I.text_search(spark.createDataFrame([(7, "quick_fox")], "query_id int, text string"), saved, "id", 9).collect()) == [1, 4]
    spark.sql("DROP TABLE postings_by_term")
