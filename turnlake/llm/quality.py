"""Quality classifier: a factorisation machine over hashed words and structure statistics (operator 9).

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): pairwise interactions of rank
RANK in time linear in a document's features. Features are hashed words, shapes of words and binned statistics of
the text's structure and its recorded length; never labels, lang, source or doc_id. The machine is fitted on a
bounded sample of labelled rows, and all texts are scored in tasks, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from turnlake.llm.common import documents, unused, whole_text

WORD_BITS, BINS, RANK = 14, 12, 4
SHAPES = 1 << 10
THRESHOLD = 0.3
#: Labelled rows that the machine is fitted on at most: those with the least hash of doc_id.
MAX_LABELLED = 6000
STATS = ("length", "recorded", "words", "word_length", "upper", "digit", "mark", "line_length", "repeated_lines", "distinct", "end_marks", "shapes")
WIDTH = (1 << WORD_BITS) + SHAPES + BINS * len(STATS)
_SHAPE = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})
_RUN = re.compile(r"(.)\1+", re.S)


def _bin(value: float) -> int:
    """Bins of a share in [0, 1], finer near 0."""
    return min(BINS - 1, int(round((max(0.0, value) ** 0.5) * (BINS - 1))))


def features(text: str, recorded: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): L2-normalised word and shape counts, and one bin of each statistic."""
    words = text.split()
    counts = Counter(words)
    n, size = len(words), len(text)
    hashed: Counter = Counter()
    shapes: Counter = Counter()
    for w, c in counts.items():
        hashed[crc32(w.encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1)] += c
        # what stands around a word's letters: punctuation, case, digits
        shape = _RUN.sub(r"\1", w[:2].translate(_SHAPE) + w[-3:].translate(_SHAPE))
        shapes[crc32(shape.encode("utf-8", "replace")) % SHAPES] += c
    lines = text.split("\n")
    letters = digits = upper = 0
    for w, c in counts.items():
        # plain lower-case words need no count of their characters
        if w.isalpha():
            letters += c * len(w)
            upper += 0 if w.islower() else c * sum(map(str.isupper, w))
        else:
            letters += c * sum(map(str.isalpha, w))
            digits += c * sum(map(str.isdigit, w))
            upper += c * sum(map(str.isupper, w))
    filled = max(1, sum(c * len(w) for w, c in counts.items()))
    marks = filled - letters - digits
    log = lambda x: min(1.0, np.log1p(max(0.0, x)) / 14) ** 2
    stats = (
        log(size), log(size if recorded is None else recorded), log(n), min(1.0, filled / max(1, n) / 20), upper / filled, digits / filled, marks / filled,
        log(size / len(lines)), 1 - len(set(lines)) / len(lines), len(counts) / max(1, n), sum(c for w, c in counts.items() if w[-1] in ".!?") / max(1, n),
        len(shapes) / max(1, len(counts)),
    )
    base = (1 << WORD_BITS) + SHAPES
    index = [*hashed, *(s + (1 << WORD_BITS) for s in shapes), *(base + i * BINS + _bin(v) for i, v in enumerate(stats))]
    word_norm = sum(c * c for c in hashed.values()) ** 0.5 or 1.0
    shape_norm = sum(c * c for c in shapes.values()) ** 0.5 or 1.0
    value = [*(c / word_norm for c in hashed.values()), *(c / shape_norm for c in shapes.values()), *([0.5] * len(stats))]
    return np.array(index, np.int64), np.array(value, np.float64)


class Machine:
    """w0, w and V of a factorisation machine."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def scores(self, index: np.ndarray, value: np.ndarray, begin: np.ndarray) -> np.ndarray:
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, begin[:-1], axis=0)
        squares = np.add.reduceat(vx * vx, begin[:-1], axis=0)
        z = self.w0 + np.add.reduceat(self.w[index] * value, begin[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-5) -> Machine:
    """AdaGrad over mini-batches in a fixed order; classes weigh the same, so rare bad texts count."""
    rng = np.random.default_rng(7)
    w0, w, v = 0.0, np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, RANK))
    if not rows:
        return Machine(w0, w, v)
    y_all = np.array([r[2] for r in rows], float)
    share = min(max(y_all.mean(), 0.02), 0.98)
    weight = np.where(y_all == 1, 0.5 / share, 0.5 / (1 - share))
    g0, gw, gv = 1e-8, np.full(WIDTH, 1e-8), np.full((WIDTH, RANK), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            own = order[at : at + batch]
            index = np.concatenate([rows[i][0] for i in own])
            value = np.concatenate([rows[i][1] for i in own])
            sizes = [len(rows[i][0]) for i in own]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            err = (Machine(w0, w, v).scores(index, value, begin) - y_all[own]) * weight[own] / len(own)
            vx = v[index] * value[:, None]
            sums = np.repeat(np.add.reduceat(vx, begin[:-1], axis=0), sizes, axis=0)
            e = np.repeat(err, sizes)
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, e * value) + decay * w[used]
            each = (e * value)[:, None] * (sums - vx)
            dv = np.stack([np.bincount(back, each[:, f]) for f in range(RANK)], axis=1) + decay * v[used]
            d0 = err.sum()
            g0 += d0 * d0
            gw[used] += dw * dw
            gv[used] += dv * dv
            w0 -= rate * d0 / g0**0.5
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return Machine(w0, w, v)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            index, value = features(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array([index.astype(np.int32).tobytes()]), pa.array([value.astype(np.float32).tobytes()]), batch.column(2).slice(i, 1)],
                names=["index", "value", "quality"])


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of at most `limit` labelled rows that aren't held out; computed in tasks, a few MB in all."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    one = docs.select("doc_id", whole_text().alias("text"), F.col("n_chars").cast("double").alias("n")).join(F.broadcast(picked), "doc_id")
    rows = one.select("text", "n", F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h")).sortWithinPartitions("h").drop("h")
    got = rows.mapInArrow(_featured, "index binary, value binary, quality int").toArrow()
    found = [(i, v, int(q)) for i, v, q in zip(*(got.column(c).to_pylist() for c in ("index", "value", "quality")))]
    # the order of partitions must not matter
    found.sort(key=lambda r: (crc32(r[0]), crc32(r[1]), r[2]))
    return [(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), q) for i, v, q in found]


def score(docs: DataFrame, machine: Machine, columns: tuple[str, ...] = ("doc_id",), name: str = "_score") -> DataFrame:
    """`columns` and the score, as `name`, for every row of `docs` (text, n_chars; others ignored)."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*shared.value)
        for batch in batches:
            text, recorded = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            out = np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 64):
                got = [features(text[i].as_py(), recorded[i].as_py()) for i in range(at, min(at + 64, batch.num_rows))]
                begin = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])])
                out[at : at + 64] = own.scores(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), begin)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out)], names=[*columns, name])

    text, recorded = unused(docs, "_text", "_n")
    sent = docs.select(*columns, whole_text().alias(text), F.col("n_chars").cast("double").alias(recorded))
    return sent.mapInArrow(run, StructType([*sent.schema.fields[:-2], StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Null texts are empty and get the score of their statistics; a null doc_id is not held out; repeated rows
    score alike; without labels every score is near 0.5; no rows give no rows.
    """
    machine = fit(training_rows(docs, labels, limit))
    return score(docs, machine).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that are predicted to be good, each by its own text."""
    machine = fit(training_rows(docs, labels, limit))
    (name,) = unused(docs, "_score")
    return score(docs, machine, tuple(docs.columns), name).filter(F.col(name) >= threshold).drop(name)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
