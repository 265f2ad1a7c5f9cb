"""Text index: postings, conjunctive search by recency and ranked search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.stems import with_terms
from turnlake.functions.text import cited_ids
from turnlake.operators.search import top_k

#: Distinct terms of a query table, or keys of documents, that are broadcast at most.
TERM_LIMIT = 100_000


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def texts_of(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, text of each field; null texts are empty."""
    return docs.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields])).alias("x")).select(key, "x.field", "x.text")


def analysed_texts(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, terms: the stems of each field's text in order, about as large as the texts; what an index of J2 is made of."""
    return with_terms(texts_of(docs, key, fields), "text")


def postings_of(texts: DataFrame, key: str) -> DataFrame:
    """One row a token occurrence of analysed texts: key, field, pos, term."""
    return texts.select(key, "field", F.posexplode("terms").alias("pos", "term"))


def build_postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a token occurrence, as it stands in lower case: key, field, pos, term."""
    return postings_of(texts_of(docs, key, fields).select(key, "field", tokens(F.col("text")).alias("terms")), key)


def save_postings(postings: DataFrame, table: str, buckets: int) -> DataFrame:
    """The postings as a table bucketed and sorted by term, which later searches join without moving it."""
    postings.repartition(buckets, "term").write.mode("overwrite").format("parquet").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)
    return postings.sparkSession.table(table)


def query_phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase, offset, term, size, phrases of queries (query_id, text): each run of letters, digits and _ is a phrase.

    A run of several terms, as `a_b`, is a phrase of its parts; a run without any is left out, and so is a query without words.
    """
    runs = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), 1))).alias("run"))
    cut = with_terms(runs, "run").withColumnRenamed("terms", "p").filter(F.size("p") > 0)
    each = cut.groupBy("query_id").agg(F.array_sort(F.collect_set("p")).alias("ps")).select("query_id", F.size("ps").alias("phrases"), F.posexplode("ps").alias("phrase", "p"))
    return each.select("query_id", "phrases", "phrase", F.size("p").alias("size"), F.posexplode("p").alias("offset", "term"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, n_terms of queries (query_id, text)."""
    found = F.array_distinct(tokens(F.col("text")))
    return queries.select("query_id", F.explode(found).alias("term"), F.size(found).alias("n_terms"))


def _few(terms: DataFrame) -> bool:
    return terms.limit(TERM_LIMIT + 1).count() <= TERM_LIMIT


def _wanted(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the queries' terms; the terms are broadcast up to TERM_LIMIT, so frequent terms aren't shuffled."""
    return postings.join(F.broadcast(terms) if _few(terms) else terms, "term")


def text_search(queries: DataFrame, postings: DataFrame, key: str, k: int, newest: DataFrame | None = None) -> DataFrame:
    """Documents that hold each phrase of a query in some field, the newest first.

    Phrases may lie in different fields; one of several terms needs them side by side, so positions less offsets meet.
    `newest` (key, newest) restricts and orders the documents; without it larger keys are newer. Only documents with the
    query's rarest term are looked at further, and a frequent term costs no row for each query that has it.
    """
    asked = query_phrases(queries)
    counts = _wanted(postings.select("term"), asked.select("term").distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    # a frequent term is in many queries, so documents are chosen before their postings meet queries
    pairs = _wanted(postings.select("term", key), rarest).select("query_id", key).distinct().persist()
    few = pairs.limit(TERM_LIMIT + 1).count() <= TERM_LIMIT
    # as a semi-join, the documents are chosen before their terms become rows
    chosen = pairs.select(key).distinct()
    own = postings.join(F.broadcast(chosen) if few else chosen, key, "left_semi")
    met = own.join(F.broadcast(pairs) if few else pairs, key).join(asked, ["query_id", "term"])
    starts = met.groupBy("query_id", key, "phrases", "phrase", "size", "field", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("here"))
    hits = starts.filter("here = size").groupBy("query_id", key, "phrases").agg(F.count_distinct("phrase").alias("found")).filter("found = phrases")
    if newest is None:
        return top_k(hits, ["query_id"], [F.desc(key)], k).select("query_id", key, "rank")
    return top_k(hits.join(newest.select(key, "newest"), key), ["query_id"], [F.desc("newest"), F.desc(key)], k).select("query_id", key, "rank")


def term_classes(queries: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One query of each set of terms (and `by`), the one of the least id, and query_id, asked: the id that stands for each query."""
    sets = queries.withColumn("_terms", F.array_sort(F.array_distinct(tokens(F.col("text")))))
    one = sets.groupBy("_terms", *by).agg(F.min("query_id").alias("asked"))
    same = F.col("q._terms") == F.col("o._terms")
    for c in by:
        same = same & F.col(f"q.{c}").eqNullSafe(F.col(f"o.{c}"))
    return one.select(F.col("asked").alias("query_id"), F.array_join("_terms", " ").alias("text"), *by), sets.alias("q").join(one.alias("o"), same).select("q.query_id", "o.asked")


def for_all(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits of the queries that stand for others, as rows of each of those."""
    return hits.withColumnRenamed("query_id", "asked").join(members, "asked").drop("asked").select(*hits.columns)


def bm25_scores(queries: DataFrame, postings: DataFrame, key: str, k1: float = 1.2, b: float = 0.75, among: DataFrame | None = None) -> DataFrame:
    """query_id, key, score: BM25 of the documents that hold all terms of a query. Counts are over all documents.

    With `among` (key) only those documents are looked for. A document's terms become one row, which is sent to each term that
    is some query's rarest and that it holds; there it meets the queries, whose other terms are looked up in that row. So
    what is moved grows with the documents and the queries: a pair of both is no row before it is a hit with its score.
    """
    # a row a document, from all of its words, which are cut once for it
    lengths = postings.groupBy(key).agg(F.count(F.lit(1)).alias("len")).persist()
    whole = F.broadcast(lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean")))
    asked = query_terms(queries.filter("query_id IS NOT NULL"))
    terms, own = asked.select("term").distinct(), postings.select(key, "term")
    only = lambda rows, ids: rows.join(F.broadcast(ids) if _few(ids) else ids, key, "left_semi")
    # dealt by the document, as all that follows needs; more terms than are broadcast aren't looked up, as that would move every posting once more
    held = (own.join(F.broadcast(terms), "term") if _few(terms) else own).repartition(key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")).persist()
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")
    told = asked.join(df, "term").crossJoin(whole).groupBy("query_id", "n_terms").agg(F.array_sort(F.collect_list(F.struct("df", "term", idf))).alias("terms"))
    # the rarest term first
    known = told.filter(F.size("terms") == F.col("n_terms")).select("query_id", F.col("terms")[0]["term"].alias("term"), "terms").persist()
    looked = held if among is None else only(held, among.select(key).distinct()).persist()
    places = _wanted(looked.select(key, "term"), known.select("term").distinct()).persist()
    norm = k1 * (1 - b + b * F.col("len") / F.col("mean"))
    rows = only(looked, places.select(key).distinct()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("held"))
    rows = rows.join(lengths, key).crossJoin(whole).select(key, "held", norm.alias("norm"))
    tf = lambda t: F.col("held")[t["term"]]
    hits = places.join(rows, key).join(known, "term").filter(F.forall("terms", lambda t: tf(t).isNotNull()))
    score = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["idf"] * tf(t) * (k1 + 1) / (tf(t) + F.col("norm")))
    return hits.select("query_id", key, F.round(score, 6).alias("score"))


def bm25_search(queries: DataFrame, postings: DataFrame, key: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best k documents a query by BM25 and then key. Queries of the same terms are answered once."""
    own, members = term_classes(queries)
    best = top_k(bm25_scores(own, postings, key, k1, b), ["query_id"], [F.desc("score"), F.col(key)], k)
    return for_all(best.select("query_id", key, "score", "rank"), members)


def search_digest(queries: DataFrame, entries: DataFrame, hidden: DataFrame, k: int) -> DataFrame:
    """query_id, id, text, rank of the best k active entries (id, project, text, superseded_by) for queries (query_id, text, project).

    A query without a project asks all. Lines that cite one of `hidden` (id) go, and entries that then say nothing, behind
    the limit: ranks are those before. Counts are over all entries, the superseded ones too. Null texts match nothing.
    """
    postings = build_postings(entries, "id", ["text"])
    told = bm25_scores(queries, postings, "id").join(entries.filter("superseded_by IS NULL").select("id", "project"), "id")
    told = told.join(queries.select("query_id", F.col("project").alias("_asked")), "query_id").filter("_asked IS NULL OR _asked = project")
    best = top_k(told, ["query_id"], [F.desc("score"), F.col("id")], k).select("query_id", "id", "rank")
    # an entry is looked at once, however many queries found it
    lines = best.select("id").distinct().join(entries.select("id", "text"), "id").select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    cited = lines.select("id", "at", F.explode(cited_ids(F.col("line"))).alias("cited")).join(hidden.select(F.col("id").alias("cited")).distinct(), "cited", "left_semi")
    seen = lines.join(cited, ["id", "at"], "left_anti").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return best.join(seen.filter(F.col("text").rlike(r"\S")), "id").select("query_id", "id", "text", "rank")
