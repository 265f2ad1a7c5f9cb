"""Document fingerprints as invertible Bloom lookup sketches (operator 4), in native expressions.

A text is cut into paragraphs, each paragraph is a 64-bit digest, and each digest is added to one cell in
each of three groups of a table: a cell holds a count, the XOR of its digests and the XOR of their checks.
The table of one version subtracted from that of another holds only the digests that differ, which peeling
recovers: a cell with one digest gives it up and it leaves its other cells. When the small table that is
the fingerprint doesn't peel, a larger one with SPREAD cells a digest in each group is built from both
digest sets, as rows of the cells that are touched; should that fail too, dense tables of 64 and 512 cells a group are tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.common import documents, whole_text

#: Cells in each of the three groups: of the fingerprint, and of the last tables.
BASE, LAST = 5, (1 << 6, 1 << 9)
#: Cells a group of the larger table: so many for each digest, and so many at least.
SPREAD, LEAST = 64, 64
ROUNDS = 6
#: Paragraphs end at line ends, and where white space follows one of these marks, letters or digits: about every
#: tenth word, in texts of any length.
WHITE, END = " \t\n\x0b\f\r", r"\s*\n\s*|(?<=[.!?;:kuxyz05])\s+"
#: Tasks to each shuffle partition: the larger tables of a task's pairs are held in memory.
FINER = 4
#: Guests of blocks are broadcast up to this count (16 bytes each).
BROADCAST_IDS = 100_000
BLOCK = 128


def paragraphs(text: Column) -> Column:
    """Where a paragraph ends depends on the letter at its end and the white space behind it alone, not on the text's length."""
    return F.split(F.btrim(text, F.lit(WHITE)), END)


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the non-empty paragraphs, sorted."""
    parts = F.filter(paragraphs(text), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def check_of(key: Column) -> Column:
    return F.xxhash64(key)


def place(key: Column, group: int, cells: int) -> Column:
    """The cell of a digest in a group: groups use different bits of it."""
    return (F.pmod(F.shiftrightunsigned(key, 19 * group + 3), F.lit(cells)) + group * cells).cast("int")


def placed(key: Column, cells: int) -> list[Column]:
    return [place(key, g, cells).alias(f"p{g}") for g in range(3)]


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(keys: Column, cells: int) -> Column:
    """The table of a digest set: 3 * cells structs (c, k, h)."""
    ready = F.transform(keys, lambda k: F.struct(k.alias("k"), check_of(k).alias("h"), *placed(k, cells)))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("c"), zero.alias("k"), zero.alias("h"))

    def cell(own: Column) -> Column:
        return F.aggregate(own, start, lambda s, x: F.struct(
            (s["c"] + 1).alias("c"), s["k"].bitwiseXOR(x["k"]).alias("k"), s["h"].bitwiseXOR(x["h"]).alias("h")))

    def group_cells(xs: Column, group: int) -> Column:
        each = F.sequence(F.lit(group * cells), F.lit((group + 1) * cells - 1))
        return F.transform(each, lambda j: cell(F.filter(xs, lambda x: x[f"p{group}"] == j)))

    return bound(ready, lambda xs: F.concat(*[group_cells(xs, g) for g in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(table: Column, cells: int) -> Column:
    """struct(ok, gone, come): digests recovered with count 1 (only in a) and -1 (only in b)."""
    kind = "struct<k:bigint,c:bigint,h:bigint,p0:int,p1:int,p2:int>"
    start = F.struct(table.alias("t"), F.array().cast(f"array<{kind}>").alias("found"))

    def one_round(s: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(
            F.filter(s["t"], lambda c: (F.abs(c["c"]) == 1) & (check_of(c["k"]) == c["h"])),
            lambda c: F.struct(c["k"].alias("k"), c["c"].alias("c"), c["h"].alias("h"), *placed(c["k"], cells))))

        def taken(p: Column, c: Column, j: Column) -> Column:
            mine = F.filter(p, lambda x: (x["p0"] == j) | (x["p1"] == j) | (x["p2"] == j))
            return F.aggregate(mine, c, lambda a, x: F.struct(
                (a["c"] - x["c"]).alias("c"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h")))

        return bound(pure, lambda p: F.when(F.size(p) == 0, s).otherwise(F.struct(
            F.transform(s["t"], lambda c, j: taken(p, c, j)).alias("t"), F.concat(s["found"], p).alias("found"))))

    def result(s: Column) -> Column:
        keys = lambda sign: F.transform(F.filter(s["found"], lambda x: x["c"] == sign), lambda x: x["k"])
        return F.struct(
            F.forall(s["t"], lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["h"] == 0)).alias("ok"),
            keys(1).alias("gone"), keys(-1).alias("come"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round, result)


def last_difference(a: Column, b: Column, sizes: tuple[int, ...] = LAST) -> Column:
    """Peels ever larger dense tables; the last resort compares the sets. Two sets come here about once in 10^9 pairs."""
    if not sizes:
        return F.struct(F.lit(True).alias("ok"), F.array_except(a, b).alias("gone"), F.array_except(b, a).alias("come"))
    tried = peel(subtract(sketch(a, sizes[0]), sketch(b, sizes[0])), sizes[0])
    return bound(tried, lambda r: F.when(r["ok"], r).otherwise(last_difference(a, b, sizes[1:])))


def spot(key: Column, group: Column, size: Column) -> Column:
    """The cell of a digest in a group of a large table."""
    return F.pmod(F.xxhash64(key, group), size)


def larger_difference(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gone, come (counts) for rows (keys, a, b) of digest sets; keys[0] is what the rows are partitioned by.
    Pairs whose larger table doesn't peel in one round are left out.

    A row for each digest and group goes into aggregates that need no shuffle, since rows of one pair are
    in one partition already; digests on both sides cancel there. A digest alone in any of its cells is found;
    all are found when the found ones add up to the cells of the first group, which hold every digest once.
    """
    size = F.greatest(F.lit(LEAST), SPREAD * (F.size("a") + F.size("b")).cast("long"))
    signed = F.concat(_signed("a", 1), _signed("b", -1))
    each = pairs.select(*keys, size.alias("n"), F.explode(signed).alias("x")).select(
        *keys, "n", F.col("x.k").alias("k"), F.col("x.c").alias("c"), check_of(F.col("x.k")).alias("h"),
        F.explode(F.array(*[F.lit(g) for g in range(3)])).alias("g"),
    )
    cells = each.groupBy(*keys, "g", spot(F.col("k"), F.col("g"), F.col("n")).alias("i")).agg(
        F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"),
    )
    pure, first = (F.abs("c") == 1) & (check_of(F.col("k")) == F.col("h")), F.col("g") == 0
    # mixed and emptied cells share the null key; a digest found in several groups is one row
    found = cells.groupBy(*keys, F.when(pure, F.col("k")).alias("key"), F.when(pure, F.col("c")).alias("sign")).agg(
        F.sum(F.when(first, F.col("c"))).alias("c0"), F.bit_xor(F.when(first, F.col("k"))).alias("k0"), F.bit_xor(F.when(first, F.col("h"))).alias("h0"))
    zero = F.lit(0).cast("long")
    whole = lambda agg, col: F.coalesce(agg(col), zero)
    sums = found.groupBy(*keys).agg(
        F.count_if(F.col("sign") == 1).alias("gone"), F.count_if(F.col("sign") == -1).alias("come"),
        *[whole(agg, col).alias(name) for name, agg, col in (
            ("c0", F.sum, "c0"), ("k0", F.bit_xor, "k0"), ("h0", F.bit_xor, "h0"), ("k1", F.bit_xor, "key"))],
        whole(F.bit_xor, F.when(F.col("key").isNotNull(), check_of(F.col("key")))).alias("h1"))
    return sums.filter("c0 = gone - come AND k0 = k1 AND h0 = h1").select(*keys, F.col("gone").cast("int").alias("gone"), F.col("come").cast("int").alias("come"))


def _signed(name: str, sign: int) -> Column:
    return F.transform(name, lambda k: F.struct(k.alias("k"), F.lit(sign).cast("long").alias("c")))


def likeness(size: Column, gone: Column, come: Column) -> Column:
    """Shared paragraphs over all paragraphs of two texts with `size` in sum; two texts without any are alike."""
    d = gone + come
    return F.when(size + d == 0, 1.0).otherwise((size - d) / (size + d)).cast("double")


def written(table: Column) -> Column:
    """The fingerprint string of a table: count, digests and checks of each cell in hexadecimal."""
    return F.array_join(F.transform(table, lambda c: F.concat(F.hex(c["c"]), F.lit("."), F.hex(c["k"]), F.lit("."), F.hex(c["h"]))), ":")


def with_next(docs: DataFrame) -> DataFrame:
    """block, kind, row, doc_id, text, next_text: the text of the next doc_id, of the first one for the last.

    Ids are cut into blocks of BLOCK; the first document of each block is also a guest at the end of the
    block before, so texts are shuffled once and no task gets more than a block and a guest.
    Rows that repeat a doc_id follow one another in the order of their texts, each the next of the one before.
    """
    block = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 20))).otherwise(F.floor(F.col("doc_id") / BLOCK))
    rows = docs.select("doc_id", whole_text().alias("text"), F.when(F.col("doc_id").isNull(), "null").otherwise("id").alias("kind"), block.alias("block"))
    # block firsts in two levels: the window without a key sees one row for BLOCK * BLOCK ids
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("block").agg(F.min("doc_id").alias("first_id")).withColumn("super", F.floor(F.col("block") / BLOCK))
    tops = firsts.groupBy("super").agg(F.max("block").alias("last_block")).withColumn(
        "before_super", F.lag("last_block").over(Window.orderBy("super")))
    last = tops.agg(F.max("last_block").alias("end"))
    guests = firsts.join(tops, "super").crossJoin(F.broadcast(last)).select(
        F.col("first_id"), F.coalesce(F.lag("block").over(Window.partitionBy("super").orderBy("block")), "before_super", "end").alias("home"))
    few = guests.count() <= BROADCAST_IDS
    guests = F.broadcast(guests) if few else guests
    visiting = rows.join(guests, rows["doc_id"] == guests["first_id"]).select(
        F.col("home").alias("block"), "kind", F.lit(1).alias("guest"), "doc_id", "text")
    n = FINER * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.select("block", "kind", F.lit(0).alias("guest"), "doc_id", "text").unionByName(visiting).repartition(n, "block")
    order = Window.partitionBy("block", "kind").orderBy("guest", "doc_id", "text")
    following = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order)).otherwise("")
    return both.withColumns({"next_text": following, "row": F.row_number().over(order)}).filter("guest = 0").select(
        "block", "kind", "row", "doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """`text` with its last quarter of code points replaced by the first as many of `following`."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses and the digests that differ.

    Null texts are empty; rows with a null doc_id have no place in the order and are compared with an empty
    text; an empty text has the empty table as its fingerprint; equal texts have equal fingerprints.
    """
    texts = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text"))).select(
        "block", "kind", "row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("edited")).alias("new"),
        paragraph_digests(F.col("next_text")).alias("following"),
    )
    tables = texts.select("*", *[sketch(F.col(c), BASE).alias(f"{c}_table") for c in ("own", "new", "following")])
    peeled = lambda c: peel(subtract(F.col("own_table"), F.col(f"{c}_table")), BASE)
    tried = tables.select("*", peeled("new").alias("to_edited"), peeled("following").alias("to_next"))
    # two rows for the comparisons of a document; those whose fingerprints don't peel go on
    each = tried.select(
        "block", "kind", "row", F.posexplode(F.array(
            F.struct("to_edited.ok", F.col("own").alias("a"), F.col("new").alias("b")),
            F.struct("to_next.ok", F.col("own").alias("a"), F.col("following").alias("b")),
        )).alias("pair", "x")).filter("NOT x.ok").select("block", "kind", "row", "pair", "x.a", "x.b")
    larger = larger_difference(each, ["block", "kind", "row", "pair"])
    none = F.lit(None).cast("int")
    main = tried.select(
        "block", "kind", "row", none.alias("pair"), none.alias("gone"), none.alias("come"), F.struct(
            "doc_id", "n_chars", "edited_sha256", written(F.col("own_table")).alias("fingerprint"),
            written(F.col("new_table")).alias("edited_fingerprint"),
            (F.size("own") + F.size("new")).alias("size_edited"), (F.size("own") + F.size("following")).alias("size_next"),
            F.size("own").cast("long").alias("n_paragraphs"), "own", "new", "following",
            F.col("to_edited.ok").alias("ok_edited"), F.col("to_next.ok").alias("ok_next"),
            *[F.size(f"to_{p}.{k}").alias(f"{k}_{p}") for p in ("edited", "next") for k in ("gone", "come")],
        ).alias("m"))
    late = larger.select("block", "kind", "row", "pair", "gone", "come", F.lit(None).cast(main.schema["m"].dataType).alias("m"))
    pick = lambda i, c: F.max(F.when(F.col("pair") == i, F.col(c))).alias(f"late_{c}_{i}")
    both = main.unionByName(late).groupBy("block", "kind", "row").agg(
        F.first("m", True).alias("m"), *[pick(i, c) for i in (0, 1) for c in ("gone", "come")])
    def counts(i: int, name: str, other: str) -> Column:
        first = F.struct(F.col(f"m.gone_{name}").alias("gone"), F.col(f"m.come_{name}").alias("come"))
        second = F.struct(F.col(f"late_gone_{i}").alias("gone"), F.col(f"late_come_{i}").alias("come"))
        third = bound(last_difference(F.col("m.own"), F.col(f"m.{other}")), lambda r: F.struct(
            F.size(r["gone"]).alias("gone"), F.size(r["come"]).alias("come")))
        return F.when(F.col(f"m.ok_{name}"), first).when(F.col(f"late_gone_{i}").isNotNull(), second).otherwise(third)

    out = both.select("m.*", counts(0, "edited", "new").alias("e"), counts(1, "next", "following").alias("x"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("size_edited"), F.col("e.gone"), F.col("e.come")).alias("near_edited"),
        likeness(F.col("size_next"), F.col("x.gone"), F.col("x.come")).alias("near_next"),
        "n_paragraphs", F.col("e.gone").cast("long").alias("n_removed"), F.col("e.come").cast("long").alias("n_added"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
