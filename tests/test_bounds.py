"""Results against brute force, with bounds on the rows that a node of the plan makes."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from turnlake import topic_queries
from turnlake.functions.text import rounded
from turnlake.operators import learning, search, text_index, topics
from turnlake.queries import queries


def made_rows(df):
    """Rows of df, and the most rows that one node of its plan made."""
    rows = df.collect()

    def of(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(plan.plan())
        own, children = plan.metrics().get("numOutputRows"), plan.children()
        return max([own.get().value() if own.isDefined() else 0, *(of(children.apply(i)) for i in range(children.size()))])

    return rows, of(df._jdf.queryExecution().executedPlan())


def test_conflicts_meet_few_pairs(spark):
    rnd = random.Random(3)
    sets = [set(rnd.sample(range(120), 12)) for _ in range(580)]
    sets += [set(rnd.sample(sorted(s), rnd.randint(5, 12))) for s in sets[:20]]
    rows = [(i, " ".join(f"w{t}x" for t in s), f"act {i % 7}") for i, s in enumerate(sets)]
    got, made = made_rows(learning.heuristic_conflicts(spark.createDataFrame(rows, "id int, condition string, action string")))
    share = lambda a, b: len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b]))
    want = {(a, b, share(a, b)) for b in range(600) for a in range(b) if a % 7 != b % 7 and share(a, b) >= 0.5}
    assert {(r["a"], r["b"], r["overlap"]) for r in got} == want and len(got) == len(want) > 10
    assert made < 40_000, made


def test_entries_meet_by_distinct_texts(spark):
    bodies = ["red ring", "Red red bolt", "blue", None]
    rows = [(i, "active" if i % 9 else "retired", i if i % 11 == 0 else None, "s", "t", bodies[i % 4], "p") for i in range(2000)]
    entries = spark.createDataFrame(rows, "id int, status string, superseded_by int, slug string, title string, body string, project string")
    asked = [(i, ["red ring", "ring  red", "blue blue", "none", " ", None][i % 6]) for i in range(120)]
    got, made = made_rows(search.search_entries(spark.createDataFrame(asked, "query_id int, text string"), entries, 5))
    want = set()
    for q, text in asked:
        told = []
        for i, status, by, *parts in rows:
            counts = [" ".join(p for p in parts if p is not None).lower().count(w) for w in {*(text or "").split()}]
            if status == "active" and by is None and any(counts):
                told.append((-sum(c > 0 for c in counts), -sum(counts), i))
        want |= {(q, i, -p, -h, r) for r, (p, h, i) in enumerate(sorted(told)[:5], 1)}
    assert {(r["query_id"], r["id"], r["points"], r["hits"], r["rank"]) for r in got} == want and len(got) == len(want) > 0
    assert made < 20_000, made


def test_failures_meet_by_distinct_texts(spark):
    texts = [("red ring", "big", "x"), ("ring", "red", None), (None, "RED", "red"), ("none", "b", "c")]
    rows = [(i, "resolved" if i % 9 == 0 else "open", *texts[i % 4]) for i in range(4000)]
    failures = spark.createDataFrame(rows, "failure_id int, status string, hint string, context string, attempted string")
    asked = [("a", "red ring red"), ("b", "ring"), ("c", "x nothing")]
    got, made = made_rows(learning.lookup_failures(spark.createDataFrame(asked, "context_id string, text string"), failures, 5))
    want = set()
    for c, text in asked:
        told = []
        for i, status, *parts in rows:
            score = sum(w for word in text.split() if len(word) > 1 for w, p in zip((3, 2, 1), parts) if word in (p or "").lower())
            if status == "open" and score:
                told.append((-score, i))
        want |= {(c, i, -s) for s, i in sorted(told)[:5]}
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 10
    assert made < 5_000, made


def test_unit_ids_equal_the_sql_where_they_clash(spark, monkeypatch):
    """Lines whose ids share their first eight digits, found by trying."""
    found, no = {}, 0
    while True:
        h = hashlib.sha1(f"s\0d1\0{no}".encode()).hexdigest()[:8]
        if h in found:
            break
        found[h] = no
        no += 1
    rows = [("d1", "s", f"{found[h]}\n\n{no}", 1)]
    monkeypatch.setattr(topic_queries, "docs", lambda *_: spark.createDataFrame(rows, "slug string, project string, text string, doc_id int"))
    assert [r["unit_id"] for r in topic_queries.t2_assign_unit_ids(spark, None).collect()] == [h, h]


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "NEAREST", (7, 150))
    monkeypatch.setattr(search, "ALL", (9, 100))
    rnd = random.Random(5)
    vectors = [(i, f"p{i % 3}", [float(rnd.randint(0, 2)) for _ in range(4)]) for i in range(700)]
    queries = [(i, [0.5 * rnd.randint(0, 4) for _ in range(4)]) for i in range(30)]
    v, q = spark.createDataFrame(vectors, "id int, project string, embedding array<double>"), spark.createDataFrame(queries, "query_id int, query array<double>")
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5
    want = {(n, i, p, round(d, 6), r) for n, y in queries for r, (d, i, p) in enumerate(sorted((far(x, y), i, p) for i, p, x in vectors)[:9], 1)}
    got, made = made_rows(search.knn_search(q, v, 9))
    assert {(r["query_id"], r["id"], r["project"], r["distance"], r["rank"]) for r in got} == want and len(got) == len(want)
    assert made < 5_000, made
    every = {(r["query_id"], r["id"], r["distance"]) for r in search.all_distances(q, v).collect()}
    assert every == {(n, i, round(far(x, y), 6)) for n, y in queries for i, _, x in vectors}
    assert search.knn_search(q.limit(0), v, 9).count() == search.knn_search(q, v.limit(0), 9).count() == search.all_distances(q.limit(0), v).count() == 0


def moved_rows(df):
    """Rows of df, and the rows that the exchanges of its plan wrote."""
    rows, seen = df.collect(), {}

    def of(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(plan.plan())
        if name == "ShuffleExchangeExec":
            seen[plan.id()] = plan.metrics().get("shuffleRecordsWritten").get().value()
        for i in range(plan.children().size()):
            of(plan.children().apply(i))

    of(df._jdf.queryExecution().executedPlan())
    return rows, sum(seen.values())


def test_distances_move_no_copies(spark, monkeypatch):
    monkeypatch.setattr(search, "ALL", (3, 20))
    monkeypatch.setattr(search, "NEAREST", (3, 20))
    rnd = random.Random(7)
    vectors = [(i, None if i == 9 else [float(rnd.randint(0, 3)) for _ in range(3)]) for i in range(300)]
    v, q = spark.createDataFrame(vectors, "id int, embedding array<double>"), spark.createDataFrame([(i, x) for i, x in vectors if i < 30], "query_id int, query array<double>")
    far = {(n, i): round(math.dist(x, y), 6) for n, y in vectors[:30] if y for i, x in vectors if x}
    for limit in (search.VECTOR_LIMIT, 0) if hasattr(search, "VECTOR_LIMIT") else (None,):
        monkeypatch.setattr(search, "VECTOR_LIMIT", limit, raising=False)
        got, moved = moved_rows(search.all_distances(q, v))
        assert {(r["query_id"], r["id"]): r["distance"] for r in got} == far and len(got) == len(far)
        assert moved < 2 * 330, moved
        best = {(r["query_id"], r["id"], r["rank"]) for r in search.knn_search(q, v, 4).collect()}
        assert best == {(n, i, k) for n in range(30) if n != 9 for k, (_, i) in enumerate(sorted((d, i) for (m, i), d in far.items() if m == n)[:4], 1)}


def test_halves_are_rounded_away_from_zero(spark):
    values = [2.5, -2.5, 0.5, -0.5, 0.49999999999999994, 1.4, -1.6, 0.0, None]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in rows.select(rounded(F.col("x"), 0)).collect()] == [3.0, -3.0, 1.0, -1.0, 0.0, 1.0, -2.0, 0.0, None]
    assert [r[0] for r in rows.select(rounded(F.col("x") / 1e6, 6)).collect()][:4] == [3e-6, -3e-6, 1e-6, -1e-6]


def test_similarities_are_of_all_pairs(spark):
    path = "/root/testdata/sf0.01"
    ids = [r[0] for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id").collect()]
    got = {(r["query_id"], r["id"]) for r in queries()["f7_l2_to_cosine"](spark, path).collect()}
    assert got == {(q, i) for q in ids if q % 50 == 0 for i in ids}


def test_scores_cost_no_row_for_each_document_of_a_frequent_term(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(["the", "of", *(f"w{rnd.randint(0, 99)}" for _ in range(6))])) for i in range(900)]
    asked = [(i, ["the of w3", "W3 the of", "the w7 w8", "of nowhere", "w5 w5"][i % 5]) for i in range(100)]
    postings = text_index.build_postings(spark.createDataFrame(docs, "id int, text string"), "id", ["text"])
    queries_ = spark.createDataFrame(asked, "query_id int, text string")
    got, made = made_rows(text_index.bm25_search(queries_, postings, "id", 4))
    words = [t.split() for _, t in docs]
    want, mean = set(), sum(map(len, words)) / len(words)
    for q, text in asked:
        terms = {*text.lower().split()}
        df = {t: sum(t in w for w in words) for t in terms}
        score = lambda w: sum(math.log((900 - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms)
        told = sorted((-round(score(w), 6), i) for i, w in enumerate(words) if terms <= {*w})[:4]
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(told, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0
    assert made < 20_000, made


def test_pairs_of_frequent_terms_are_no_rows(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(w for j in rnd.sample(range(24), 12) for w in [f"w{j}"] * rnd.randint(1, 3))) for i in range(400)]
    asked = [(i, " ".join(f"w{j}" for j in rnd.sample(range(24), 6))) for i in range(60)]
    postings = text_index.build_postings(spark.createDataFrame(docs, "id int, text string"), "id", ["text"])
    queries_ = spark.createDataFrame(asked, "query_id int, text string")
    got, made = made_rows(text_index.bm25_scores(queries_, postings, "id"))
    words, want = [t.split() for _, t in docs], {}
    mean = sum(map(len, words)) / 400
    df = {f"w{j}": sum(f"w{j}" in w for w in words) for j in range(24)}
    part = lambda t, w: math.log((400 - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
    for q, text in asked:
        want |= {(q, i): sum(part(t, w) for t in text.split()) for i, w in enumerate(words) if {*text.split()} <= {*w}}
    assert {(r["query_id"], r["id"]) for r in got} == {*want} and len(got) == len(want) > 20
    assert all(abs(r["score"] - want[r["query_id"], r["id"]]) < 1e-5 for r in got)
    # about 11,000 pairs share the rarest term of the query
    assert made < 6_000, made
    few = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "id int")
    some = text_index.bm25_scores(queries_, postings, "id", among=few).collect()
    assert {tuple(r) for r in some} == {tuple(r) for r in got if r["id"] % 3 == 0} and len(some) > 20


def test_units_of_a_range_are_those_of_all_hits(spark, monkeypatch):
    rnd = random.Random(9)
    units = spark.createDataFrame([(f"u{i}", " ".join(f"w{rnd.randint(0, 9)}" for _ in range(8))) for i in range(200)], "unit_id string, text string")
    asked = spark.createDataFrame([(i, f"w{i % 10} w{i % 7}") for i in range(40)], "query_id int, text string")
    events = spark.createDataFrame([(f"u{i}", f"2024-0{rnd.randint(1, 9)}") for i in range(0, 200, 2) for _ in range(2)], "unit_id string, time string")
    postings = text_index.build_postings(units, "unit_id", ["text"])
    found = lambda df: {(r["query_id"], r["unit_id"], tuple(r["times"]), r["rank"]) for r in df.collect()}
    for limit in (text_index.TERM_LIMIT, 0):
        monkeypatch.setattr(text_index, "TERM_LIMIT", limit)
        for span in ((), ("2024-02", "2024-03")):
            want = found(topics.search_topics(text_index.bm25_scores(asked, postings, "unit_id"), events, 3, *span))
            assert found(topics.search_units(asked, postings, events, 3, *span)) == want and len(want) > 40


def test_search_makes_rows_of_chosen_documents_only(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(100)) + (" rare" if i == 7 else "")) for i in range(400)], "id int, text string")
    texts = text_index.analysed_texts(docs, "id", ["text"]).persist()
    asked = spark.createDataFrame([(1, "rare w5")], "query_id int, text string")
    got, made = made_rows(text_index.text_search(asked, text_index.postings_of(texts, "id"), "id", 5))
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(1, 7, 1)]
    assert made < 1_000, made
