"""Similarity joins against all pairs: near duplicates, lines, and what cuts large groups into parts."""

import random
import re

import numpy as np
import pytest

from turnlake.llm import line_dedup, near_dedup

WHITE = re.compile("[\x20\x09-\x0d]+")


def varied(rnd, base, n, most):
    """Copies of a list of words with up to `most` words changed."""
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randint(0, most)):
            own[rnd.randrange(len(own))] = f"w{rnd.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def words(rnd, n, kinds=400):
    return [f"{rnd.choice('abcdefgh')}{rnd.randint(0, kinds)}" for _ in range(n)]


def shingles(text):
    own = [w for w in WHITE.split(text.translate({i: i + 32 for i in range(65, 91)})) if w]
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def components_of_all_pairs(texts):
    sets, root = {i: shingles(t or "") for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("tile", [1 << 12, 16])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, tile):
    """Large noisy groups whose pairs are on both sides of the limit, chains, small groups, and texts without partners."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rnd = random.Random(11)
    texts = varied(rnd, words(rnd, 90), 120, 9) + varied(rnd, words(rnd, 40), 60, 3) + varied(rnd, words(rnd, 9), 30, 2)
    texts += [" ".join(words(rnd, 60)) for _ in range(60)] + ["", None, "  ", "one two", "One Two", "x" * 3000, " ".join(words(rnd, 9000))]
    rnd.shuffle(texts)
    table = dict(enumerate(texts))
    docs = spark.createDataFrame(list(table.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs).collect()}
    want = components_of_all_pairs(table)
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 50


@pytest.mark.parametrize(("kept", "hot"), [(4, 20_000), (1, 30)])
def test_lines_equal_all_pairs(spark, monkeypatch, kept, hot):
    """Families of like lines, with one partner kept and hot tokens cut into tiles too, against all earlier lines."""
    monkeypatch.setattr(line_dedup, "KEPT", kept)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rnd = random.Random(12)
    lines = varied(rnd, words(rnd, 24, 60), 150, 5) + varied(rnd, words(rnd, 7), 60, 2) + [" ".join(words(rnd, rnd.randint(1, 5), 6)) for _ in range(150)]
    lines += ["", "  ", "same line here again"] * 3 + [" ".join(words(rnd, 4000, 10**5))] * 2
    rnd.shuffle(lines)
    docs = [(i, "\n".join(lines[k : k + 7])) for i, k in enumerate(range(0, len(lines), 7))] + [(900, None), (901, "")]
    got = {r["doc_id"]: list(r["removed_lines"]) for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    earlier, want = [], {}
    for i, text in docs:
        want[i] = []
        for k, line in enumerate((text or "").split("\n")):
            own = {w for w in WHITE.split(line) if w}
            if own:
                if any(100 * len(own & e) >= 75 * len(own | e) for e in earlier):
                    want[i].append(k)
                earlier.append(own)
    assert got == want and sum(map(len, want.values())) > 150


def test_lines_are_decided_without_a_join(spark):
    """All lines meet their decisions in one shuffle by document, a frequent line too; a repeated id has each line once."""
    docs = [(1, "a b c d\n\nx y z"), (1, "q r s t"), (2, "a b c d\na  b c d"), (2, "a b c d\na  b c d"), (3, "x y z\n \nnew words here\n")] + [(i, "the very same line") for i in range(10, 400)]
    out = line_dedup.line_decisions(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    got = sorted(map(tuple, out.collect()))
    same = [(i, 0, i > 10) for i in range(10, 400)]
    assert got == [(1, 0, False), (1, 2, False), (2, 0, True), (2, 1, True), (3, 0, True), (3, 2, False), *same]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_lines_are_cut(spark):
    texts = ["", "a\n\nb b c\n", "", "d\n", "\n\n e f", "g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    every = [(d, k) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    size = lambda wanted: {(r["doc_id"], r["line"]): len(r["tokens"]) // 8 for r in line_dedup.line_sets(docs, spark.createDataFrame(wanted, "doc_id bigint, line int")).collect()}
    assert size(every) == {(1, 0): 1, (1, 2): 2, (3, 0): 1, (4, 2): 2, (5, 0): 1}
    assert size([(1, 2), (4, 2), (4, 0)]) == {(1, 2): 2, (4, 2): 2}


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rnd.integers(0, 60, 30).astype(np.uint64)) for _ in range(2))
        s = line_dedup.sketches(np.concatenate([a, b]), np.array([0, len(a)]))
        assert sum(int(np.bitwise_count(x[0] ^ x[1])) for x in s) <= len(np.setxor1d(a, b))
