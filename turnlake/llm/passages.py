"""Repeated passages by windows of words that documents share (operator 2).

Seeds are kept where a run of SEED words is the least of WINDOW consecutive runs by hash, which depends on the text
alone: any passage of LEAST words has such a place, the same in all its copies. Only around seeds that two documents
share are all windows of LEAST words hashed, and windows that two documents share make the spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import documents, lookup, stored, whole_text
from turnlake.llm.words import Words, chunks, long_array, mixed

LEAST, SEED = 50, 25
WINDOW = LEAST - SEED + 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs_of_words(words: Words, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hash of the words that begin at each word; 0 where the text ends before."""
    n = len(words.hash)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * _powers(_BASE, n), dtype=np.uint64)])
    back = _powers(_BACK, n)
    last = np.repeat(words.first[1:], np.diff(words.first))
    at, out = np.arange(n), []
    for k in sizes:
        fits = at + k <= last
        h = np.zeros(n, np.uint64)
        h[fits] = mixed((sums[at[fits] + k] - sums[at[fits]]) * back[fits]) | np.uint64(1)
        out.append(h)
    return out


def _sliding(v: np.ndarray, width: int, best) -> np.ndarray:
    """best over v[i:i + width], for every i that has so many."""
    have, m = 1, v
    while 2 * have <= width:
        m = best(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return best(m[: len(m) - rest], m[rest:]) if rest else m


def minimisers(words: Words, seeds: np.ndarray) -> np.ndarray:
    """Words at which some window of WINDOW seeds, all within one text, has its least value."""
    n = len(seeds)
    if n < LEAST:
        return np.zeros(0, np.int64)
    v = np.where(seeds == 0, np.uint64(2**64 - 1), seeds)
    least = _sliding(v, WINDOW, np.minimum)
    last = np.repeat(words.first[1:], np.diff(words.first))
    whole = np.arange(len(least)) + LEAST <= last[: len(least)]
    padded = np.zeros(n + WINDOW - 1, np.uint64)
    padded[WINDOW - 1 : WINDOW - 1 + len(least)] = np.where(whole, least, 0)
    return np.flatnonzero((_sliding(padded, WINDOW, np.maximum) == v) & (seeds != 0))


SEEDS = "seed bigint, doc_id bigint, pos int"


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for at, _, words in chunks(batch.column(1)):
            seeds, = runs_of_words(words, (SEED,))
            picked = minimisers(words, seeds)
            text = np.searchsorted(words.first, picked, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [long_array(seeds[picked]), pa.array(ids[at + text]), pa.array((picked - words.first[text]).astype(np.int32))],
                names=["seed", "doc_id", "pos"])


def shared(rows: DataFrame, key: str) -> DataFrame:
    """key, low, high, n: the keys that rows of two documents or more have, with their least and greatest doc_id."""
    groups = rows.groupBy(key).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    return stored(groups.filter("low <> high"), f"shared-{key}")


PLACES = "win bigint, doc_id bigint, pos int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of LEAST words that hold one of the given seeds."""
    for batch in batches:
        ids, wanted = batch.column(0).to_numpy(), batch.column(2)
        for at, to, words in chunks(batch.column(1)):
            windows, = runs_of_words(words, (LEAST,))
            lists = wanted.slice(at, to - at)
            seeds = np.repeat(words.first[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()
            near = np.zeros(len(windows) + 1, np.int64)
            # rows that repeat a doc_id can have different texts, and then places of the other one
            seeds = seeds[seeds < len(windows)]
            np.add.at(near, np.maximum(seeds - (WINDOW - 1), 0), 1)
            np.add.at(near, seeds + 1, -1)
            picked = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (windows != 0))
            text = np.searchsorted(words.first, picked, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [long_array(windows[picked]), pa.array(ids[at + text]), pa.array((picked - words.first[text]).astype(np.int32))],
                names=["win", "doc_id", "pos"])


def windows(docs: DataFrame) -> DataFrame:
    """win, doc_id, pos: the windows of LEAST words of which another document has the least seed too."""
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", whole_text().alias("text"))
    found = stored(texts.mapInArrow(_seeds, SEEDS), "seeds")
    lists = lookup(found, shared(found, "seed"), "seed", "n").groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("wanted"))
    return texts.join(lists, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_windows, PLACES)


def _merged(starts: np.ndarray) -> list[dict]:
    """Spans that the windows from `starts`, in order, cover; those that touch are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LEAST)
    return [{"start": int(s), "stop": int(t) + LEAST} for s, t in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)])]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        all_, later = ([_merged(np.unique(np.array(x, np.int64))) for x in batch.column(i).to_pylist()] for i in (1, 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_, kind), pa.array(later, kind), batch.column(3)],
                                         names=["doc_id", "spans", "later_spans", "partners"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, spans, later_spans, partners for every document that shares a passage of LEAST words or more with another.

    Spans count words from 0, the end excluded; later_spans have a copy in a document of smaller doc_id and can go. A word
    is in a span exactly when a window of LEAST words around it is in another document. Spans that touch are one.
    partners are, for each window, the first document that has it, or for the first one the last. Words are runs without
    ASCII white space, case kept. Null doc_ids and texts, and texts of fewer than LEAST words, have no spans; rows that
    repeat a doc_id are one document.
    """
    found = stored(windows(docs), "windows")
    met = lookup(found, shared(found, "win"), "win", "n")
    later = F.col("low") < F.col("doc_id")
    lists = met.groupBy("doc_id").agg(
        F.collect_list("pos").alias("spans"), F.collect_list(F.when(later, F.col("pos"))).alias("later_spans"),
        F.array_sort(F.collect_set(F.when(later, F.col("low")).otherwise(F.col("high")))).alias("partners"))
    kind = "array<struct<start:int,stop:int>>"
    return lists.mapInArrow(_spans, f"doc_id bigint, spans {kind}, later_spans {kind}, partners array<bigint>")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return repeated_passages(documents(spark, sf_dir)).select("*", words("spans").alias("repeated_words"), words("later_spans").alias("removable_words"))
