"""Training-data operators on small fixtures: nulls, empty and long texts, repeated rows, empty tables, other columns."""

import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnlake.llm import bpe, chat_format, exact_dedup, fingerprints, lexicon, line_dedup, mixing, near_dedup, passages, quality, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, rep string"
rnd = random.Random(3)
PROSE = [" ".join(rnd.choice("alpha beta gamma delta the of and zeta eta theta iota kappa".split()) + str(rnd.randint(0, 99)) for _ in range(90)) for _ in range(6)]


def rows():
    base = PROSE[0].split(" ")
    near = base[:40] + ["changed"] + base[41:]
    texts = [None, "", "  ", PROSE[0], PROSE[0], " ".join(near), PROSE[1] + "\n" + PROSE[2], "x" * 5000, "one two", "One\ttwo", PROSE[3] + " " + " ".join(base[:60]), "a b c d\na b c d\na b c d e"]
    out = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t), "d", "r") for i, t in enumerate(texts)]
    return [*out, (None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None), out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()]
    assert len(got) == len(rows())
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for doc_id, keep, size, _, sha in got:
        same = [r for r in rows() if hashlib.sha256(norm(r[1]).encode()).hexdigest() == sha]
        ids = [r[0] for r in same if r[0] is not None]
        assert size == len(same) and keep == (min(ids) if ids else None)
    assert sum(r[3] for r in got) == len({r[4] for r in got})
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))
    assert kept.columns == docs.columns and kept.count() == len({r[4] for r in got})


def test_near_dedup(docs, empty):
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs).collect() if r["doc_id"] is not None}
    assert got[5]["component_id"] == got[4]["component_id"] == 3 and got[8]["component_id"] == got[9]["component_id"] == 8
    assert got[0]["n_shingles"] == 0 and got[0]["component_id"] == 0 and got[6]["kept"] and got[7]["n_shingles"] == 1
    assert near_dedup.near_dedup(docs).count() == len(rows()) and near_dedup.near_dedup(empty).count() == 0


def test_bpe(docs, empty):
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    want = {t or "": tok.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows()}
    got = bpe.encode_decode(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = list(struct.unpack(f"<{r['n_tokens']}I", r["ids"]))
        assert ids == want[r["decoded"]]
    assert bpe.encode_decode(empty).count() == 0


def test_bpe_odd_texts():
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    vocabulary = bpe.load_vocabulary(bpe.tokenizer_path())
    frequent = [w.encode() for w in (" the", "the", " and", "ing", " a", "ab", "abc", " hello")]
    words = {w: tuple(memoryview(ids).cast("I")) for w, ids in zip(frequent, bpe.merge_all(frequent, vocabulary))}
    block = lexicon.compile_lexicon(words)
    held = lexicon.Lexicon(block)
    assert all(held.get(w) == bpe.id_bytes(ids) for w, ids in words.items()) and held.get(b"th") is None and lexicon.Lexicon(lexicon.compile_lexicon({})).get(b"a") is None
    encoder = bpe.Encoder(vocabulary, block)
    parts = ["a", "'s", "'re", " ", "  ", "\n", "\t", "\r\n", "é", "1", "!", "...", "\x1c", "\x85", "\xa0", " ", "​", "日本", "<|endoftext|>", "<|", "😀", "'", "ll", "\x00", "﻿", "the"]
    parts += ["½", "Ⅷ", "٣", "e\u0301", ",", '"', "-", "_", "x" * 70]
    for _ in range(30):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(100)]
        for text, ids in zip(texts, encoder.encode_all(texts)):
            assert list(memoryview(ids).cast("I")) == tok.encode(text, add_special_tokens=False).ids


def test_bpe_forgets_pieces_and_keeps_their_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "TOGETHER", 3)
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.tokenizer_path()), lexicon.compile_lexicon({}))
    for text in [*PROSE, *PROSE[::-1], "", "a<|endoftext|>b"]:
        assert list(memoryview(encoder.encode(text)).cast("I")) == tok.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, docs):
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    shared = spark.sparkContext.broadcast(bpe.build(docs, bpe.tokenizer_path()))
    edits = spark.createDataFrame([(i, s, a, b, by) for i in range(12) for s, a, b, by in ((2, 3, 9, "'re new\n"), (1, 200, 260, None), (3, 0, 0, "  ok "), (4, 10**6, 10**6, " end"))],
                                  "doc_id bigint, seq int, start long, stop long, by string")
    for r in token_counts.apply_edits(token_counts.build_trees(docs, shared), edits, shared).collect():
        assert r["tokens_after"] == count(r["text"]) and r["node_chars"][1] == len(r["text"])
    assert token_counts.build_trees(docs.limit(0), shared).count() == 0


def test_edits_meet_the_whole_count():
    """Many random edits, after each of which the trees' sums equal a new count; most of a long text isn't encoded again."""
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.tokenizer_path()), lexicon.compile_lexicon({}))
    parts = ["alpha", " ", " beta", "\n", "  ", "'s", "12", "...", "\t", "x" * 300, "é", "<|endoftext|>", "\x1c"]
    text = lambda n: "".join(rnd.choice(parts) for _ in range(n))
    texts = ["", " ", text(3), text(400), text(4000)]
    trees = []
    for t in texts:
        pieces = token_counts.cut(t)
        trees.append(token_counts.Tree.over([len(p) for p in pieces], [len(x) // 4 for x in encoder.encode_all(pieces)]))
    for _ in range(60):
        edits = []
        for t in texts:
            at = rnd.randint(-2, len(t) + 3)
            edits.append([{"start": at, "stop": at + rnd.choice([0, 0, 1, 5, 700]), "by": text(rnd.choice([0, 0, 1, 4, 90]))}])
        texts, encoded = token_counts.edit_all(texts, trees, edits, encoder)
        for t, tree, n in zip(texts, trees, encoded):
            assert tree.chars[1] == len(t) and tree.tokens[1] == len(tok.encode(t, add_special_tokens=False).ids)
            assert sum(tree.tokens[tree.size :]) == tree.tokens[1]
        assert encoded[-1] < len(texts[-1]) / 2


def test_counts_meet_the_library(monkeypatch):
    """White space of all kinds, marks and special strings; pieces of a text without special strings aren't cut one by one."""
    own, tok = random.Random(7), Tokenizer.from_file(bpe.tokenizer_path())
    encoder = bpe.Encoder(bpe.load_vocabulary(bpe.tokenizer_path()), lexicon.compile_lexicon({}))
    parts = ["alpha", " ", "  ", " beta", "\n", "\r\n", "\t", "'s", "don't", "'tis", "12", "...", "x" * 70, "é", "É,", "\x1c", "\x1c ", "\u00a0", "\u2003",
             "\u3000", "\x85", "—", "—,", "日本", "\U0001f600", "_", "a_b", "\x0b", "\u200b", "a\u0301", "Ⅷ", "\u1680", "\u2028", "ß"]
    random_text = lambda n: "".join(own.choice(parts) for _ in range(n))
    texts = ["", " ", *(random_text(own.choice([1, 2, 3, 5, 9, 40, 300])) for _ in range(1500)), ""]
    special = [random_text(9) + "<|endoftext|>" + random_text(9), "<|endoftext|>"]
    cut = []
    monkeypatch.setattr(bpe.Encoder, "cut", lambda self, text, whole=bpe.Encoder.cut: cut.append(text) or whole(self, text))
    trees = [token_counts.Tree([], []) for _ in texts + special]
    got, _ = token_counts.edit_all([""] * len(trees), trees, [[{"start": 0, "stop": 0, "by": t}] for t in texts + special], encoder)
    assert got == texts + special
    assert [t.tokens[1] for t in trees] == [len(tok.encode(t, add_special_tokens=False).ids) for t in got]
    assert all("<|endoftext|>" in t for t in cut)
    assert encoder.count_all([]) == [] and encoder.count_all(["", ""]) == [0, 0]


def test_merges_of_rows_and_pairs():
    """Merges in columns equal those by a heap; each pair of a full table is found, others are not."""
    own, vocabulary = random.Random(8), bpe.load_vocabulary(bpe.tokenizer_path())
    words = [bytes(own.choices(b"abethion 'THE\xc3\xa9\x00\xff01,.", k=n)) for n in range(70) for _ in range(20)]
    assert bpe.merge_all(words, vocabulary) == [bpe.id_bytes(bpe._merge_long([vocabulary["bytes"][b] for b in w], vocabulary["merges"])) for w in words]
    left, right = (np.array(x, np.int32) for x in zip(*((a, b) for a in range(60) for b in range(60))))
    held = (left * 7 + right) % 3 > 0
    table = {"table": bpe.pair_table((left[held].astype(np.int64) << 32) | right[held], np.arange(held.sum(), dtype=np.int32))}
    ranks = bpe._ranks(left, right, table)
    assert ranks[held].tolist() == list(range(held.sum())) and (ranks[~held] == bpe.NO_MERGE).all()
    assert (bpe._ranks(np.array([-1, 5, -1]), np.array([5, -1, -1]), table) == bpe.NO_MERGE).all()


def test_lists_of_numbers():
    column = pa.array([[1, 2], None, [], [3], [4, 5]], pa.list_(pa.int32()))
    assert token_counts.lists(column) == [[1, 2], [], [], [3], [4, 5]] and token_counts.lists(column.slice(1, 3)) == [[], [], [3]]


def test_token_counts_query(spark, tmp_path):
    """The query's own edits against a new count of the edited text; under half of longer texts is encoded again."""
    tok = Tokenizer.from_file(bpe.tokenizer_path())
    long = " ".join(PROSE * 4)
    spark.createDataFrame([*rows(), (99, long, None, None, None, None, None)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = token_counts.op3_token_counts(spark, str(tmp_path)).collect()
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 99:
            continue
        t = long if r["doc_id"] == 99 else None
        if t:
            n = len(t)
            t = t[: n // 2] + t[n // 2 + 17 :]
            at = min(n * 9 // 10, len(t))
            t = "Now " + t[:at] + long[:23] + t[at:]
            assert r["tokens_after"] == len(tok.encode(t, add_special_tokens=False).ids) and r["edited_sha256"] == hashlib.sha256(t.encode()).hexdigest()
            assert r["reencoded_chars"] < len(t) / 2
    assert len(got) == len(rows()) + 1


def test_line_dedup(docs, empty):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[11]["removed_lines"] == [1, 2] and got[4]["removed_lines"] == [0] and got[3]["n_removed"] == 0 and got[0]["n_lines"] == 0
    assert got[9]["removed_lines"] == [] and line_dedup.line_dedup(docs).count() == len(rows()) and line_dedup.line_dedup(empty).count() == 0
    text = line_dedup.remove_lines(docs, line_dedup.line_dedup(docs)).filter("doc_id = 11").first()["text"]
    assert text == "a b c d"


def test_passages(docs, empty):
    got = {r["doc_id"]: r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {3, 4, 10} or set(got) == {3, 4, 5, 10}
    assert [tuple(s) for s in got[10]["spans"]] == [(90, 150)] and not got[3]["later_spans"]
    assert passages.repeated_passages(empty).count() == 0


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    own, after = PROSE[0], rows()[5][1]
    k = len(own) // 4
    assert by[4]["edited_sha256"] == hashlib.sha256((own[: len(own) - k] + after[:k]).encode()).hexdigest()
    assert fingerprints.fingerprints(empty).count() == 0


def test_larger_tables_count_the_difference(spark):
    """Sets far beyond the small table, overlapping ones, equal ones and empty ones, against array_except."""
    sets = spark.range(12).select("id", F.expr("transform(sequence(1, id * id * 40 + 1), x -> xxhash64(x))").alias("a"),
                                  F.expr("transform(sequence(id * 30 + 1, id * id * 41 + 40 * id + 1), x -> xxhash64(x))").alias("b"))
    sets = sets.unionByName(spark.range(50, 52).selectExpr("id", "array(xxhash64(1), xxhash64(2)) AS a", "if(id = 50, array(xxhash64(1), xxhash64(2)), array()) AS b"))
    got = {r["id"]: (r["gone"], r["come"]) for r in fingerprints.larger_difference(sets, ["id"]).collect()}
    want = {r["id"]: (r["g"], r["c"]) for r in sets.selectExpr("id", "size(array_except(a, b)) AS g", "size(array_except(b, a)) AS c").collect()}
    assert got == want


def test_null_ids_are_compared_with_an_empty_text(spark):
    docs = spark.createDataFrame([(None, "some words here"), (None, "some words here"), (None, None), (1, "more words")], "doc_id long, text string")
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == 4 and sorted(r["n_chars"] for r in got) == [0, 10, 15, 15]
    assert all(r["near_next"] == (0.0 if r["n_chars"] else 1.0) for r in got if r["doc_id"] is None)


def test_peeling_gives_the_difference(spark):
    a, b = list(range(1, 40)), list(range(20, 61))
    df = spark.createDataFrame([(a, b), (a, a), ([], [5])], "a array<bigint>, b array<bigint>")
    hashed = df.select(*[F.transform(c, lambda k: F.xxhash64(k)).alias(c) for c in "ab"])
    r = hashed.select(fingerprints.last_difference(F.col("a"), F.col("b")).alias("r"), F.size(F.array_except("a", "b")).alias("g"), F.size(F.array_except("b", "a")).alias("c")).collect()
    assert all(len(x["r"]["gone"]) == x["g"] and len(x["r"]["come"]) == x["c"] for x in r)


def test_mixing(docs, empty):
    got = mixing.mix(docs, target_entropy=None, max_repeats=1.5, cover=True)
    assert got.count() >= len(rows()) and got.filter("source IS NULL").count() == 0
    assert mixing.mix(docs, target_entropy=0.9).count() > 0 and mixing.mix(empty).count() == 0


def test_mixing_keeps_documents_without_tokens(spark):
    """A hot source whose target is under its tokens, with empty texts that lie behind the target in its order."""
    rows = [(i, PROSE[i % 6], "hot") for i in range(300)] + [(1000 + i, ("", None, " \t")[i % 3], "hot") for i in range(200)] + [(2000 + i, PROSE[i % 6], "rare") for i in range(6)] + [(3000, "", "none"), (3000, None, "none")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), target_entropy=0.9).collect()
    empty = [r for r in got if r["n_tokens"] == 0]
    assert sorted(r["doc_id"] for r in empty) == [*range(1000, 1200), 3000, 3000] and {(r["epoch"], r["slot"], r["start_token"]) for r in empty} == {(0, 0, 0)}
    target = {r["source"]: r["target_tokens"] for r in got}
    assert target["hot"] < 300 * 90 and target["none"] == 0 and len({r["doc_id"] for r in got if r["doc_id"] < 300}) < 300
    for source in ("hot", "rare"):
        dealt = sum(r["n_tokens"] for r in got if r["source"] == source)
        assert target[source] <= dealt < target[source] + 90


def test_chat_format(spark):
    turns = spark.createDataFrame([
        (1, 2, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a <|end|>\n \\<\\| <\\|sep|>"), (1, 3, "user", "</s>[INST] x"), (2, 0, None, "only"), (None, 0, "user", "null id"), (None, 0, "user", "null id")],
        "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.chat_digests(turns).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    a = "a <|end|>\n \\<\\| <\\|sep|>"
    assert got[1]["n_turns"] == 4 and got[1]["n_runs"] == 3 and got[1]["loss_sha256"] == sha(a + "b") and got[1]["loss_chars"] == len(a) + 1
    assert got[1]["turns_sha256"] == sha(f"user\n\nassistant\n{a}\nassistant\nb\nuser\n</s>[INST] x\n") and got[2]["n_turns"] == 1 and got[None]["n_turns"] == 2
    assert chat_format.chat_digests(turns.limit(0)).count() == 0


def test_quality(spark, docs, empty):
    good, bad = [(i, PROSE[i % 6], 1) for i in range(60)], [(100 + i, "BUY!! NOW!! FREE!! " * 20, 0) for i in range(60)]
    table = spark.createDataFrame([(i, t, None, None, len(t), None, None) for i, t, _ in good + bad], SCHEMA)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(table, labels).collect()}
    assert all(got[i]["predicted"] == q for i, _, q in good + bad if got[i]["held_out"])
    assert quality.classify(docs, labels).count() == len(rows()) and quality.classify(empty, labels.limit(0)).count() == 0


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null ids with several texts, bad ones among them, and an id with several texts, against brute force."""
    import corpus_pipeline

    prose = lambda: " ".join(rnd.choice("alpha beta gamma delta the of and".split()) + str(rnd.randint(0, 999)) for _ in range(80))
    good, bad = [(i, prose()) for i in range(60)], [(100 + i, "BUY!! NOW!! FREE!! " * (18 + i % 5)) for i in range(60)]
    near = good[5][1].rsplit(" ", 1)[0] + " changed"
    clean = [*good, *[(None, prose()) for _ in range(4)], *[(7, prose()) for _ in range(2)], (90, prose()), (90, prose())]
    gone = [*bad, (None, bad[0][1]), (None, "BUY!! NOW!! FREE!! " * 30), (7, near), (90, good[3][1].replace(" ", "  ")), (None, good[4][1]), good[6], (7, "BUY!! NOW!! FREE!! " * 25)]
    spark.createDataFrame([(i, t, None, f"s{len(t) % 2}", len(t), "d", "r") for i, t in clean + gone], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, _ in good if i != 7] + [(i, 0, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in clean}


def test_passages_behind_boilerplate(spark):
    """Passages that end or begin in words that many documents have, against all windows of 50 words."""
    words = lambda n: [f"{rnd.choice('abcdef')}{rnd.randint(0, 10**6)}" for _ in range(n)]
    plate, texts = words(40), {}
    for i in range(150):
        own = words(20)
        for copy in (i, 500 + i):
            texts[copy] = words(30 + i % 9) + (own + plate if i % 2 else plate + own) + words(40)
    for i in range(1000, 1150):
        texts[i] = words(35) + plate + words(35)
    texts[2000] = texts[3][:200] + texts[8]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string").repartition(5)
    held = {}
    for i, t in texts.items():
        for k in range(len(t) - 49):
            held.setdefault(tuple(t[k : k + 50]), set()).add(i)

    def covered(i, use):
        at = [k for k in range(len(texts[i]) - 49) if use(held[tuple(texts[i][k : k + 50])])]
        return sorted({x for k in at for x in range(k, k + 50)})

    got = {r["doc_id"]: [[x for s in r[c] for x in range(s["start"], s["stop"])] for c in ("spans", "later_spans")] for r in passages.repeated_passages(table).collect()}
    want = {i: [covered(i, lambda d: len(d) > 1), covered(i, lambda d: min(d) < i)] for i in texts}
    assert got == {i: w for i, w in want.items() if w[0]} and len(got) == 301


def test_fingerprints_do_not_depend_on_the_length(spark):
    """Near copies, and edited texts, on both sides of 400 and 1,200 code points."""
    def prose(n):
        text = ""
        while len(text) < n:
            text += rnd.choice("alpha beta gamma delta the of and".split()) + str(rnd.randint(0, 999)) + rnd.choice(["", "", "", "", "."]) + " "
        return text[: n - 1] + "x"

    rows = []
    for i, n in enumerate((395, 1190)):
        own = prose(n)
        rows += [(4 * i, own), (4 * i + 1, own + " and more" + "y" * 10), (4 * i + 2, prose(n + 55)), (4 * i + 3, "a text of 20 letters")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (0, 4):
        assert got[i]["near_next"] > 0.7 and got[i + 2]["near_edited"] > 0.5, (i, got[i], got[i + 2])
