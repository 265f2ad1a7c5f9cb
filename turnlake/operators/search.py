"""Search: exact nearest neighbours, substring text search, hybrid and multi-concept ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from turnlake.functions.text import l2_to_cosine


def metadata_filter(df: DataFrame, after: str | None = None, before: str | None = None, **exact: str) -> DataFrame:
    """all of the given conditions; times are compared as strings, so a bare day as `before` ends at its midnight."""
    for name, value in exact.items():
        df = df.filter(F.col(name) == value)
    if after is not None:
        df = df.filter(F.col("ts_raw") >= after)
    return df.filter(F.col("ts_raw") <= before) if before is not None else df


def exclude_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """an anti-join, which nulls don't empty."""
    return df.join(ids.select("id"), "id", "left_anti")


def main_thread(df: DataFrame) -> DataFrame:
    """without sidechains; null counts as the main thread."""
    return df.filter(~F.coalesce("is_sidechain", F.lit(False)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Q1: the first k rows of each group; plans WindowGroupLimit, so a task passes on k rows a group at most."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("long"))


def l2_distance(a: Column, b: Column) -> Column:
    """L2 distance; vectors of unequal width are an error."""
    width = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal width")))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(width.cast("double"))


def register_functions(spark: SparkSession) -> None:
    """The SQL function vec_distance_l2(a, b) of the session, an expression as l2_distance()."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION vec_distance_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE DETERMINISTIC
      RETURN CASE WHEN size(a) = size(b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0.0D, (s, x) -> s + x))
                  WHEN size(a) <> size(b) THEN CAST(raise_error('vectors of unequal width') AS DOUBLE) END""")


#: Queries that are broadcast at most by text.
QUERY_BLOCK = 2000
#: Queries whose vectors are broadcast at most.
VECTOR_LIMIT = 50_000
#: Queries and vectors whose distances are worked out at once: of which a few are kept, and of which all pairs are.
NEAREST, ALL = (1000, 16384), (512, 2048)
#: Queries whose distances to a part of the vectors are worked out at once.
TILE = 16


def _stacked(vectors: pa.Array, width: int) -> np.ndarray:
    if (pc.list_value_length(vectors).to_numpy(zero_copy_only=False) != width).any():
        raise ValueError("vectors of unequal width")
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def _blocks(df: DataFrame, key: str, count: int, size: int, name: str) -> DataFrame:
    """Rows of df, about `size` by a hash in an array, one array a row."""
    n = max(1, -(-count // size))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n))).repartition(n, "_block")
    return dealt.groupBy("_block").agg(F.collect_list(F.struct(*df.columns)).alias(name)).drop("_block")


def _met(queries: DataFrame, vectors: DataFrame, k: int | None, places: int | None = None) -> DataFrame:
    """query_id, distance and the columns of the vectors but `embedding`: the k nearest of each part, or all pairs.

    Both sides are dealt into blocks once, and each block of vectors meets all blocks of queries, one after the other: these are
    broadcast up to VECTOR_LIMIT queries and read again for each beyond it, so no copy of either side is written. Squares are
    summed in the order of l2_distance(), so that distances equal its; `places` rounds them, halves up. Null vectors have none.
    """
    q_size, v_size = NEAREST if k else ALL
    kept = [c for c in vectors.columns if c != "embedding"]
    asked, known = queries.select("query_id", "query").filter("query IS NOT NULL"), vectors.filter("embedding IS NOT NULL")
    n = asked.count()
    right = _blocks(asked, "query_id", n, q_size, "_queries")
    pairs = _blocks(known, "id", known.count(), v_size, "_vectors").crossJoin(F.broadcast(right) if n <= VECTOR_LIMIT else right)
    schema = StructType([queries.schema["query_id"], *[vectors.schema[c] for c in kept], StructField("distance", DoubleType())])

    def distances(left: pa.StructArray, right: pa.StructArray) -> pa.RecordBatch:
        if k:
            # vectors by id, so that the first of those at one distance are those of the least ids
            right = right.take(pc.sort_indices(right.field("id")))
        width = len(right.field("embedding")[0])
        q, v = _stacked(left.field("query"), width), np.ascontiguousarray(_stacked(right.field("embedding"), width).T)
        rows, at, far = [], [], []
        for start in range(0, len(left), TILE):
            tile = q[start:start + TILE]
            total, gap = np.zeros((len(tile), v.shape[1])), np.empty((len(tile), v.shape[1]))
            for i in range(width):
                np.subtract(v[i], tile[:, i, None], out=gap)
                np.multiply(gap, gap, out=gap)
                np.add(total, gap, out=total)
            np.sqrt(total, out=total)
            if places is not None:
                total *= 10.0 ** places
                np.floor(total, out=gap)
                gap += total - gap >= 0.5
                np.divide(gap, 10.0 ** places, out=total)
            for j, d in enumerate(total):
                found = np.arange(len(d))
                if k and k < len(d):
                    found = np.flatnonzero(~(d > np.partition(d, k - 1)[k - 1]))
                    found = found[np.argsort(d[found], kind="stable")[:k]]
                rows.append(np.full(len(found), start + j))
                at.append(found)
                far.append(d[found])
        out, who = pa.array(np.concatenate(at)), pa.array(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([left.field("query_id").take(who), *[right.field(c).take(out) for c in kept], pa.array(np.concatenate(far))], schema.names)

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield distances(batch.column("_queries")[i].values, batch.column("_vectors")[i].values)

    return pairs.mapInArrow(meet, schema)


def all_distances(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, id and the distance, rounded to 6 places, of every query (query_id, query) to every vector (id, embedding)."""
    return _met(queries, vectors.select("id", "embedding"), None, 6)


def knn_search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The exact k nearest vectors of each query (query_id, query), filters on `vectors` applied before.

    Each task keeps k rows a query before the shuffle. Ranks follow the distance as computed, which is given rounded to 6 places.
    """
    return top_k(_met(queries, vectors, k), ["query_id"], [F.col("distance"), F.col("id")], k).withColumn("distance", F.round("distance", 6))


def text_search_contains(queries: DataFrame, docs: DataFrame, fields: list[str], order: list[Column], k: int) -> DataFrame:
    """Documents that hold every white-space word of a query (query_id, text) in one of the fields, ASCII case ignored.

    A text is lower-cased once, and meets the whole, stated query table, which is broadcast up to QUERY_BLOCK rows; the
    longest word of a query, which fewest texts hold, is looked for first.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    longest_first = F.array_sort(words, lambda a, b: F.char_length(b) - F.char_length(a))
    asked = queries.select("query_id", longest_first.alias("words"))
    few = asked.count() <= QUERY_BLOCK
    lowered = docs.withColumn("_text", F.lower(F.concat_ws("\n", *fields)))
    hit = lowered.crossJoin(F.broadcast(asked) if few else asked).filter(F.forall("words", lambda w: F.contains(F.col("_text"), w)))
    return top_k(hit.drop("words", "_text"), ["query_id"], order, k)


def hybrid_search(near: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """Ranks of both lists in turn, vector first; the first place counts; text-only hits have no distance."""
    both = near.select("query_id", "id", (2 * F.col("rank")).alias("pos"), "distance").unionByName(
        text.select("query_id", "id", (2 * F.col("rank") + 1).alias("pos"), F.lit(None).cast("double").alias("distance")))
    one = both.groupBy("query_id", "id").agg(F.min("pos").alias("pos"), F.max("distance").alias("distance"))
    return top_k(one, ["query_id"], [F.col("pos"), F.col("id")], k)


def multi_concept_search(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """Conversations that every concept of a group hit: average best similarity, and the best hit of the first concept.

    hits: k nearest of each query_id; concepts: group_id, query_id, the lowest of a group being its first. rank is by the
    average, then by path.
    """
    sizes = concepts.groupBy("group_id").agg(F.count(F.lit(1)).alias("concepts"), F.min("query_id").alias("first_id"))
    own = hits.join(F.broadcast(concepts) if concepts.count() <= QUERY_BLOCK else concepts, "query_id").withColumn("similarity", l2_to_cosine(F.col("distance")))
    best = own.groupBy("group_id", "archive_path", "query_id").agg(F.max("similarity").alias("best"), F.min_by("id", F.struct("distance", "id")).alias("id"))
    found = best.join(sizes, "group_id").groupBy("group_id", "archive_path", "concepts").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("best"), 6).alias("average"), F.max(F.when(F.col("query_id") == F.col("first_id"), F.col("id"))).alias("representative"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("average"), "archive_path")).cast("long")
    return found.filter(F.col("n") == F.col("concepts")).select("group_id", "archive_path", "average", "representative", rank.alias("rank"))


def search_entries(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Active entries that nothing supersedes, by distinct query terms that they hold, then by occurrences, then by id.

    Queries of the same terms are one, and so are entries of the same text: only distinct ones meet. Of the texts' least ids
    the best k decide which texts count, and of a text its first k entries do.
    """
    own = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")))
    asked = queries.select("query_id", own.alias("terms"))
    terms = asked.select("terms").distinct()
    few = terms.count() <= QUERY_BLOCK
    live = entries.filter((F.col("status") == "active") & F.col("superseded_by").isNull())
    texts = live.select("id", F.lower(F.concat_ws(" ", "slug", "title", "body", "project")).alias("_text"))
    first = top_k(texts, ["_text"], [F.col("id")], k).drop("rank")
    counts = F.transform("terms", lambda t: ((F.char_length("_text") - F.char_length(F.replace(F.col("_text"), t, F.lit("")))) / F.char_length(t)).cast("long"))
    one = texts.groupBy("_text").agg(F.min("id").alias("least"))
    scored = one.crossJoin(F.broadcast(terms) if few else terms).withColumn("counts", counts).select(
        "terms", "_text", "least", F.size(F.filter("counts", lambda c: c > 0)).cast("long").alias("points"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c).alias("hits"))
    best = top_k(scored.filter("points > 0"), ["terms"], [F.desc("points"), F.desc("hits"), F.col("least")], k).drop("rank", "least")
    found = top_k(best.join(first, "_text").drop("_text"), ["terms"], [F.desc("points"), F.desc("hits"), F.col("id")], k)
    return asked.join(found, "terms").drop("terms")


def address_join(refs: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Refs (ref_id, path, line_start, line_end) and the ranges of the same path that overlap them.

    Both sides are dealt to bins of `width` lines, so that a path with very many ranges has many keys; a pair is
    kept in the bin of its larger start alone.
    """
    def binned(df: DataFrame) -> DataFrame:
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.col("line_end") / width))))

    r, x = binned(refs).alias("r"), binned(ranges).alias("x")
    overlap = (F.greatest("r.line_start", "x.line_start") <= F.least("r.line_end", "x.line_end"))
    first = F.col("r.bin") == F.floor(F.greatest("r.line_start", "x.line_start") / width)
    return r.join(x, (F.col("r.path") == F.col("x.path")) & (F.col("r.bin") == F.col("x.bin")) & overlap & first).select("r.ref_id", "x.id")
