"""Temperature mixing of sources under a token budget (operator 6), in DataFrame expressions.

Source token shares p are raised to an exponent a in [0, 1] and normalised. The exponent is bisected
to the largest one whose weights reach a target entropy (a fraction of the largest possible), or to the
smallest one under which no source is repeated more than a limit. The weights are realised as passes
over permuted blocks of each source, cut at the source's share of the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.common import documents, stored, whole_text

STEPS = 50
NO_SOURCE = "<none>"
#: Up to so many sources are joined by broadcast (under 10 MB); more are sort-merge joined.
BROADCAST_SOURCES = 50_000


def n_tokens(text: str | Column = "text") -> Column:
    """Tokens for shares and budgets: runs of characters that are not ASCII white space."""
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tempered(shares: Column, a: Column) -> Column:
    raised = F.transform(shares, lambda p: F.pow(p, a))
    return F.transform(raised, lambda r: r / F.aggregate(raised, F.lit(0.0), lambda s, x: s + x))


def entropy(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda s, w: s - F.when(w > 0, w * F.ln(w)).otherwise(0.0))


def bisected(shares: Column, spread: Column, keep_low) -> Column:
    """The exponent after STEPS halvings of [0, 1]; keep_low(a): the sought exponent is a or above."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = keep_low(mid)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    return F.when(spread, F.lit(1.0)).otherwise(found["lo"])


def source_plan(
    per_source: DataFrame, target_entropy: float | None = 0.92, max_repeats: float | None = None,
    budget: int | None = None, cover: bool = False,
) -> DataFrame:
    """(source, tokens, weight, target_tokens, exponent) from (source, tokens).

    target_entropy: fraction of ln(number of sources); max_repeats: limit on passes over any source; where
    both are given, the entropy rules. budget: tokens to deal out, by default as many as there are;
    cover: instead, the least budget under which every source is passed over once at least.
    Sources without tokens have weight 0. Nothing is met by one source or by shares that are even enough:
    the exponent is then 1, the natural mixture.
    """
    some = per_source.filter("tokens > 0")
    one = some.agg(
        F.array_sort(F.collect_list(F.struct("source", F.col("tokens").cast("double").alias("t")))).alias("ss"),
        F.sum("tokens").cast("double").alias("total"),
    ).withColumn("shares", F.transform("ss", lambda s: s["t"] / F.col("total")))
    shares = F.col("shares")
    if target_entropy is not None:
        goal = F.lit(float(target_entropy)) * F.ln(F.size("shares"))
        a = bisected(shares, entropy(shares) >= goal, lambda m: entropy(tempered(shares, m)) >= goal)
    else:
        limit = F.lit(float(max_repeats))
        ratio = F.array_max("shares") / F.array_min("shares") if cover else None
        if cover:
            # under the covering budget the rarest source is repeated (largest / smallest share)^(1 - a) times
            a = F.when(ratio <= limit, 0.0).otherwise(1 - F.ln(limit) / F.ln(ratio))
        else:
            total = F.lit(float(budget)) if budget else F.col("total")
            over = lambda m: F.array_max(F.zip_with(tempered(shares, m), shares, lambda w, p: w * total / (p * F.col("total")))) > limit
            a = bisected(shares, over(F.lit(1.0)), over)
    plan = one.withColumn("exponent", a).withColumn("weights", tempered(shares, F.col("exponent")))
    least = F.array_max(F.zip_with("weights", "shares", lambda w, p: p * F.col("total") / w))
    whole = least if cover else F.lit(float(budget)) if budget else F.col("total")
    # the cover budget is rounded up a hair, so that rounding never costs a document
    return plan.withColumn("budget", whole * (1 + 1e-9) if cover else whole).select(
        F.posexplode("ss").alias("i", "s"), "weights", "budget", "exponent"
    ).select(
        F.col("s.source").alias("source"), F.col("s.t").cast("long").alias("tokens"), F.get("weights", "i").alias("weight"),
        F.ceil(F.get("weights", "i") * F.col("budget")).alias("target_tokens"), "exponent",
    )


def mix(
    docs: DataFrame, seed: str = "mix", block_tokens: int = 1 << 16, max_blocks: int = 1 << 16, slots: int = 1 << 12, **how,
) -> DataFrame:
    """Copies of documents in training order: doc_id, source, n_tokens, epoch, slot, start_token, target_tokens.

    A copy is dealt out when the tokens before it in its source are under the source's target, so each source
    overshoots by less than a document. Every epoch permutes the source's blocks anew; slot is the copy's
    place on a common scale, so that any run of slots holds the sources at their weights. Documents without
    tokens come once each, at the start of epoch 0, whatever their source's target. Null sources count as the
    source NO_SOURCE.
    """
    every = stored(docs.select(
        "doc_id", F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), n_tokens().alias("n_tokens"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    ), "mix-rows")
    rows = every.filter("n_tokens > 0")
    per_source = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = stored(source_plan(per_source, **how).withColumn(
        "n_blocks", F.ceil(F.col("tokens") / F.greatest(F.lit(block_tokens), F.ceil(F.col("tokens") / max_blocks)))
    ).withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("target_tokens") / F.col("tokens"))).cast("int")), "mix-plan")
    known = plan.select("source", "tokens", "n_blocks", "epochs", "target_tokens")
    n_sources = known.count()
    near = F.broadcast(known) if n_sources <= BROADCAST_SOURCES else known
    unit = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = rows.join(near, "source").withColumn("block", F.floor(unit * F.col("n_blocks")))
    # a hot source is cut into bounded blocks: sums within blocks, then over the few blocks of a source
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(placed.withColumn("in_block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))), "mix-placed")
    blocks = placed.groupBy("source", "block", "epochs", "tokens").agg(F.sum("n_tokens").alias("bt")).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))
    ).withColumn("bh", F.md5(F.concat_ws("|", F.lit(seed), "source", "block", "epoch")))
    order = Window.partitionBy("source", "epoch").orderBy("bh", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "source", "block", "epoch",
        (F.coalesce(F.sum("bt").over(order), F.lit(0)) + F.col("epoch") * F.col("tokens")).alias("offset"),
    )
    dealt = placed.drop("epochs").join(blocks, ["source", "block"]).withColumn("start_token", F.col("offset") + F.col("in_block")).filter("start_token < target_tokens")
    slot = F.floor(F.col("start_token") / F.col("target_tokens") * F.lit(slots))
    columns = ["doc_id", "source", "n_tokens", "epoch", "slot", "start_token", "target_tokens"]
    target = F.coalesce("target_tokens", F.lit(0)).alias("target_tokens")
    empty = every.filter("n_tokens = 0").join(near.select("source", "target_tokens"), "source", "left").select(
        "doc_id", "source", "n_tokens", *[F.lit(0).alias(c) for c in ("epoch", "slot", "start_token")], target)
    return dealt.withColumn("slot", slot).select(*columns).unionByName(empty).select(
        "doc_id", "source", "n_tokens", *[F.col(c).cast("long").alias(c) for c in columns[3:]]
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), target_entropy=0.92)


OP6_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce(source, '<none>') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
per AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS t FROM rows_ GROUP BY source HAVING sum(n_tokens) > 0),
one AS (SELECT list(t ORDER BY source) AS ts, sum(t) AS total, 0.92 * ln(count(*)) AS goal FROM per),
sh AS (SELECT list_transform(ts, lambda t: t / total) AS ps, total, goal FROM one),
bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ps, total, goal FROM sh
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, ps, total, goal
  FROM (SELECT *, list_sum(list_transform(ws, lambda w: -w * ln(w))) >= goal AS up
        FROM (SELECT *, list_transform(rs, lambda r: r / list_sum(rs)) AS ws
              FROM (SELECT *, list_transform(ps, lambda p: pow(p, mid)) AS rs
                    FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE i < 50)))) ),
al AS (SELECT CASE WHEN list_sum(list_transform(ps, lambda p: -p * ln(p))) >= goal THEN 1.0 ELSE lo END AS a, ps, total FROM bis WHERE i = 50),
wt AS (SELECT per.source, CAST(per.t AS BIGINT) AS tokens,
              CAST(ceil(pow(per.t / total, a) / list_sum(list_transform(ps, lambda p: pow(p, a))) * total) AS BIGINT) AS target_tokens
       FROM per, al),
pl AS (SELECT *, CAST(ceil(tokens / greatest(65536, ceil(tokens / 65536))) AS BIGINT) AS n_blocks,
              greatest(1, CAST(ceil(target_tokens / tokens) AS BIGINT)) AS epochs FROM wt),
pd AS (SELECT r.*, tokens, target_tokens, epochs, CAST(floor(CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0 * n_blocks) AS BIGINT) AS block
       FROM rows_ r JOIN pl USING (source) WHERE n_tokens > 0),
ib AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY h, doc_id, n_tokens
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_block FROM pd),
bl AS (SELECT source, block, tokens, unnest(generate_series(0, epochs - 1)) AS epoch, bt
       FROM (SELECT source, block, tokens, epochs, sum(n_tokens) AS bt FROM pd GROUP BY ALL)),
bo AS (SELECT source, block, epoch, epoch * tokens + coalesce(sum(bt) OVER (PARTITION BY source, epoch
              ORDER BY md5('mix|' || source || '|' || block || '|' || epoch), block
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM bl),
dl AS (SELECT doc_id, source, n_tokens, epoch, o + in_block AS start_token, target_tokens
       FROM ib JOIN bo USING (source, block) WHERE o + in_block < target_tokens)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS BIGINT) AS epoch,
       CAST(floor(CAST(start_token AS DOUBLE) / target_tokens * 4096) AS BIGINT) AS slot,
       CAST(start_token AS BIGINT) AS start_token, target_tokens FROM dl
UNION ALL
SELECT doc_id, source, 0, 0, 0, 0, coalesce(target_tokens, 0) FROM rows_ LEFT JOIN wt USING (source) WHERE n_tokens = 0
"""
