"""Ranks and first rows of hot groups, nulls and ties."""

import random

from turnlake.operators.archive import pack_until_full
from turnlake.operators.ranking import first_rows, ranked


def test_ranks_of_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = {r["i"]: (r["rank"], r["size"]) for r in ranked(df, ["g"], ["x", "i"]).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert [got[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]
    first = sorted((str(r["g"]), r["x"], r["i"]) for r in first_rows(df, ["g"], ["x", "i"], 5).collect())
    assert first == sorted((str(g), x, i) for g in {r[0] for r in rows} for x, i in sorted((x, i) for h, x, i in rows if h == g)[:5])
    assert ranked(df.limit(0), ["g"], ["x"]).count() == 0


def test_packing_with_empty_texts(spark):
    texts = ["", "aa", "", "bbb", "", "c", "", "dd"]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, i int, text string")
    assert sorted(r["i"] for r in pack_until_full(df, ["k"], ["i"], 5).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["i"] for r in pack_until_full(df, ["k"], ["i"], 0).collect()) == [0]
