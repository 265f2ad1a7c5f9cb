"""Decontamination, filter audit and fill-in-middle against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from turnlake.llm import common, decontamination, exact_dedup, fill_middle, filter_audit, line_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
rnd = random.Random(11)
POOL = [f"w{i}" for i in range(12)]
SCHEMA = "doc_id bigint, text string, source string, lang string, gram string, window string, start string, mask string, part string, digest string, form string, n string"
EXTRA = ("x",) * 8


def lowered(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(text, items):
    """(n_words, n_hit, ids) by trying every window of every item at every place."""
    words, hit, ids = lowered(text), set(), set()
    for item_id, t in items:
        w = lowered(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(ids)


@pytest.fixture(scope="module")
def texts():
    base = [" ".join(rnd.choice(POOL) for _ in range(60)) for _ in range(12)]
    shared = "The Quick brown fox, jumps-over the lazy dog: ÄÖ again and"
    docs = [None, "", " \t", "...", base[0], base[0], shared, "before " + shared + " after " + shared, shared.replace("lazy", "idle"), "short ITEM here", "a short item", "only", "only only",
            "same " * 40, "日本 語 " + base[1][:90], base[2] + "|" + shared.upper(), ("filler text " * 4000) + shared + (" more text" * 4000)]
    docs += [" ".join([*base[i].split()[:30], *base[i + 1].split()[20:50]]) for i in range(10)]
    return [(i, t) for i, t in enumerate(docs)] + [(4, "another text of the same id " + base[3]), (None, base[4]), (None, None), (5, base[0])]


def test_decontamination_meets_all_windows(spark, texts):
    base = [t for _, t in texts if t]
    items = [(1, base[5]), (2, "the quick BROWN fox jumps over the lazy dog äÖ again and"), (3, "short item"), (4, "only"), (5, "same same same"), (6, None), (7, "?!"), (7, "item here"),
             (None, "filler text filler"), (8, base[2]), (9, base[2]), (10, " ".join(base[-3].split()[5:40])), (11, "same " * 15)]
    docs = spark.createDataFrame([(i, t, None, *EXTRA, None) for i, t in texts], SCHEMA).repartition(3)
    got = decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id int, text string").withColumn("window", F.lit(1))).collect()
    want = sorted(((i, *brute_hits(t, items)) for i, t in texts), key=repr)
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=repr) == sorted(
        ((i, n, h, len(ids), sha(ids), h > 0) for i, n, h, ids in want), key=repr)
    assert sum(h > 0 for _, _, h, _ in want) > 10


def test_decontamination_of_nothing(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    got = decontamination.decontaminate(docs, nothing).collect()
    assert len(got) == len(texts) and not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in got)
    assert decontamination.decontaminate(docs.limit(0), nothing).count() == 0


def test_spans_are_the_longest_runs(spark):
    item = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, f"x {item} y a b c d e f g h i j z"), (2, "a b c d e f g h i x j k l m n")], "doc_id bigint, text string")
    found = decontamination.Matches(docs, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert sorted((r["doc_id"], r["start"], r["stop"]) for r in found.spans().collect()) == [(1, 1, 15), (1, 16, 26)]


def brute_mask(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(f for f, bad in zip("ABCD", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))) if bad)


def brute_report(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    masks = []
    for i, text, source in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (text or "") for j, u, _ in rows)
        masks.append((source or "", set(brute_mask(text or "") + "E" * copy), i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [m for m in own if not m[1] & set(order[:k])]
                gone = [m for m in here if f in m[1]]
                total[f] += len(gone)
                out[part, order, k + 1] = [len(here) - len(gone), len(gone), sum(f in m[1] for m in own) - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def reported(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in df.collect()}


@pytest.fixture(scope="module")
def audited():
    long = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", "  ", long, long + " #", "ABC " + long, long.upper(), "one one " * 40, "ÉÉ é\x0b$", "x" * 20000 + " A|"]
    rows = [(i, texts[i * 7 % 10], ("hot", "hot", "b", None)[i % 4]) for i in range(40)]
    rows += [(3, texts[4], "hot"), (3, texts[4], "b"), (3, texts[4], "b"), (None, texts[3], "b"), (None, "unlike", "hot"), (-5, long, "late")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(0, 1, 0), (None, 1, 1), (3, None, None), (-5, 1, 1)]
    return rows, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def write(spark, rows, path, files):
    for k in range(files):
        # later files hold smaller ids, so that earlier masks are retracted
        part = rows[::-1][k::files] if files > 1 else rows
        spark.createDataFrame([(*r, *EXTRA, None) for r in part], SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 6])
def test_filter_audit(spark, audited, tmp_path, files):
    rows, labels = audited
    write(spark, rows, str(tmp_path / "documents.parquet"), files)
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert reported(filter_audit.filter_audit(spark, str(tmp_path / "documents.parquet"), said, batches=files)) == brute_report(rows, labels)


def test_filter_audit_goes_on_and_batches_run_twice(spark, audited, tmp_path):
    rows, labels = audited
    said, path, folder = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), str(tmp_path / "documents.parquet"), str(tmp_path / "state")
    first = [r for r in rows if r[0] is None or r[0] % 3 == 2]
    write(spark, first, path, 2)
    audit = filter_audit.FilterAudit(spark, said, folder)
    assert reported(filter_audit.report(audit.run(path, 2).counters())) == brute_report(first, labels)
    # a batch that had been taken in before its commit was lost
    again = filter_audit.masked(spark.createDataFrame(rows[:7], "doc_id bigint, text string, source string"))
    audit.ingest(again, 2)
    rest = [r for r in rows if r not in first]
    write(spark, rest, path, 1)
    # a new session of the same folder takes batch 2 anew, with the files that it had not seen
    audit = filter_audit.FilterAudit(spark, said, folder).run(path, 1)
    assert reported(filter_audit.report(audit.counters())) == brute_report(rows, labels)


def test_filter_audit_of_nothing(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(path)
    assert filter_audit.filter_audit(spark, path, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_arranged(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark):
    parts = [" ", "  ", "\n", "\t\x0b", "\x1c", "\x85", "\xa0", "é", "日本", "😀", "<", "<P", "S>", "<M", "a", "word", "\x00", ">"]
    texts = [None, "", " ", "\n\t ", "one", " one ", "<P>", "a <S> b", "<M", "x" * 70000 + " end", "word " * 20000]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    rows = [(i - 3, t, None, *EXTRA, None) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "no id here", None, *EXTRA, None), (5, "other text of an id", None, *EXTRA, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    two_steps, one_step = fill_middle.restore(fill_middle.fill_middle(docs)), fill_middle.transform_and_restore(docs)
    want = sorted((repr((r[0], *brute_arranged(r[0], r[1]), r[1] or "")) for r in rows))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for df in (two_steps, one_step):
        got = df.collect()
        assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"])) for r in got) == want
        assert all(r["output_sha256"] == sha(r["output"]) and r["restored_sha256"] == sha(r["restored"]) for r in got)
        assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    marks = "<P><S><M>".encode()
    for r in got:
        buffers = {"text": r["restored"].encode(), "marks": marks}
        assert b"".join(buffers[p["buffer"]][p["start"] : p["start"] + p["length"]] for p in r["pieces"]).decode() == r["output"]
    assert fill_middle.transform_and_restore(docs.limit(0)).count() == 0


def test_piece_table_cuts_and_orders():
    table = fill_middle.PieceTable.of(memoryview(b"abcdef")).cut([0, 2, 2, 6])
    assert [bytes(p) for p in table.parts()] == [b"", b"ab", b"", b"cdef", b""]
    assert [bytes(p) for p in table.cut([1, 3]).parts()] == [b"", b"a", b"b", b"", b"c", b"def", b""]
    order = (3, 0, 4, 2, 1)
    assert table.arranged(order).restored(order).pieces == table.pieces and table.arranged(order).sha256() == hashlib.sha256(b"cdefab").hexdigest()


def test_sql_of_the_new_operators(spark, tmp_path):
    """The SQL of operators 11 to 13 on texts that the given tables don't have."""
    rows = [(1, "A\x0bB  c <P>", "s"), (2, "é" * 3 + " Ünï cödé " * 12, None), (3, "é" * 3 + " Ünï cödé " * 12, "s"), (4, None, "s"), (5, "\x1cq 0-9 z", "")]
    c = duckdb.connect()
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "Ünï cödé ünï"), (2, "q 0")], "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(2, 1, 0), (3, 1, 1)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for query, sql in ((decontamination.op11_decontamination, decontamination.OP11_SQL), (filter_audit.op12_filter_audit, filter_audit.OP12_SQL), (fill_middle.op13_fill_middle, fill_middle.OP13_SQL)):
        got = query(spark, str(tmp_path))
        want = c.sql(sql)
        assert sorted(map(repr, (tuple(r[k] for k in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


HELPERS = "_id _key _copy _sha _score _text _n _rows _kept_id _kept_sha _of _gone _stays".split()


def test_columns_may_be_called_as_helpers(spark, tmp_path):
    """Extra columns with the names that stages use inside come out as they went in, and stages decide as without them."""
    import corpus_pipeline

    words = "alpha beta gamma delta of the".split()
    prose = lambda i: " ".join(f"{words[(i * j) % 6]}{(i * 31 + j * j) % 997}" for j in range(90))
    rows = [(i, prose(i), "en", f"s{i % 2}", 9) for i in range(1, 50)] + [(i + 100, "BUY!! NOW!! FREE!! " * (18 + i % 5), "en", "s0", 9) for i in range(50)] + [(60, prose(3), "en", "s1", 9), (7, prose(8), "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    more = docs.select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in HELPERS])
    labels = [(i, 1, 0) for i in range(1, 50)] + [(i + 100, 0, 0) for i in range(50)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plain, named = docs, more
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, named = [common.stored(stage(spark, d, str(tmp_path)), name) for d in (plain, named)]
        assert named.columns == more.columns, name
        kept = sorted(map(tuple, plain.collect()))
        assert kept == sorted(map(tuple, named.select(*docs.columns).collect())) and len(kept) >= 40, name
        assert named.filter(" OR ".join(f"{c} <> concat('{c} ', doc_id)" for c in HELPERS)).isEmpty(), name
    lines = spark.createDataFrame([(1, "a b c d\nx y", "o", "g"), (2, "a b c d", "p", "h")], "doc_id bigint, text string, _of string, _gone string")
    gone = spark.createDataFrame([(1, 1, [0])], "doc_id bigint, n_removed bigint, removed_lines array<int>")
    assert sorted(map(tuple, line_dedup.remove_lines(lines, gone).collect())) == [(1, "x y", "o", "g"), (2, "a b c d", "p", "h")]


def test_digest_index_outlives_its_session(spark, tmp_path, monkeypatch):
    """A second session finds the first one's entries; many batches are made one file a bucket; a broken compaction costs nothing."""
    path = str(tmp_path / "index")
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    decided = lambda docs, index: {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, index).collect()}
    before = spark.sql("SHOW TABLES").count()
    first = exact_dedup.DigestIndex(spark, "kept_one", path, buckets=3)
    one = batch((5, "a  b"), (6, "a b"), (7, None), (9, "c"))
    assert decided(one, first) == {5: (5, 2, True), 6: (5, 2, False), 7: (7, 1, True), 9: (9, 1, True)}
    # the catalog of the first session goes with it, the folder stays
    spark.sql(f"DROP TABLE {first.table}")
    second = exact_dedup.DigestIndex(spark, "kept_two", path, buckets=5)
    assert second.buckets == 3 and second.read().count() == 3
    assert decided(batch((1, "a\tb"), (2, ""), (3, "new"), (9, "c")), second) == {1: (5, 1, False), 2: (7, 1, False), 3: (3, 1, True), 9: (9, 1, True)}
    assert decided(one, second)[5] == (5, 2, True)
    # a generation that is not whole is passed over
    (tmp_path / "index" / "g000007-b3").mkdir()
    assert exact_dedup.DigestIndex(spark, "kept_three", path).read().count() == 4
    monkeypatch.setattr(exact_dedup.DigestIndex, "MOST_FILES", 1)
    for i in range(4):
        second.ingest(exact_dedup.digests(batch(*[(100 + i * 10 + j, f"t{i}{j}") for j in range(9)])))
    assert second.generation > 7 and len(second.read().inputFiles()) <= 2 * 3 and second.read().count() == 40
    again = exact_dedup.DigestIndex(spark, "kept_four", path)
    assert again.generation == second.generation and again.read().count() == 40
    for index in (second, again, exact_dedup.DigestIndex(spark, "kept_three", path)):
        spark.sql(f"DROP TABLE IF EXISTS {index.table}")
    spark.sql("DROP TABLE IF EXISTS kept_three_g0")
    exact_dedup.exact_dedup(one).collect()
    assert spark.sql("SHOW TABLES").count() == before
