"""MinHash near-deduplication by a multi-index Hamming join (operator 10).

Signatures have SYMBOLS minima of 16 bits over five-word shingles. They are split into CHUNKS chunks of four
symbols. By the pigeonhole principle two signatures that differ in at most 2 * CHUNKS - 1 symbols have a chunk
with at most one error, so for each chunk its four ways to leave one symbol out are the keys: all pairs under
that distance share a key. A pair of similarity 0.75 fails in a chunk with probability 0.26, in all of them with 7e-9.

Equal shingle sets are one class. Classes that share a key are first linked to the key's smallest member, its hub
(linear in the group), and linked classes go with their least hub. Keys whose members are still of several components are
gathered into families by their hub, so that a member of many such keys is one row, with a bit for each key. Only pairs
of different components that share a key of the family are compared, in tasks that hold tiles of a family: their
signatures first, and then the whole sets of those members that have a pair within the distance. So no link between
components is lost, pairs are never rows, and rows grow with the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import documents, lookup, stored, whole_text
from turnlake.llm.components import components
from turnlake.llm.words import chunks, grams, list_array, long_array, mixed, weights

SHINGLE, NUMERATOR, DENOMINATOR = 5, 75, 100
CHUNKS = 14
SYMBOLS = 4 * CHUNKS
#: Differing symbols up to which a pair is looked at; pairs up to 2 * CHUNKS - 1 are sure to share a key, and a pair
#: of similarity 0.75 is beyond DISTANCE once in 10^10.
DISTANCE = 36
#: Members of a family, and shingles of theirs, that are compared in one group; larger families are dealt out as pairs of such tiles.
TILE, TILE_SHINGLES = 1 << 12, 1 << 20
#: Members that are confirmed against one copy of a hub's text.
PER_HUB = 500


def shingle_sets(words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    g, begin = grams(words, SHINGLE)
    return [np.unique(g[begin[i] : begin[i + 1]]) for i in range(len(begin) - 1)]


def signatures(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit minima for each run of shingle hashes flat[begin[i]:begin[i + 1]], none empty."""
    out = np.empty((len(begin) - 1, SYMBOLS), np.uint16)
    for s, a in enumerate(weights(2 * SYMBOLS)[SYMBOLS:]):
        low = np.minimum.reduceat(flat * a, begin[:-1])
        out[:, s] = (mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, to, words in chunks(batch.column(1), lower=True):
            sets = shingle_sets(words)
            sizes = np.array([len(s) for s in sets], np.int64)
            sums = np.array([s.sum() for s in sets] or [0], np.uint64)[: len(sets)]
            xors = np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else np.uint64(0) for s in sets] or [0], np.uint64)[: len(sets)]
            filled = np.flatnonzero(sizes)
            sigs: list = [None] * len(sets)
            if len(filled):
                begin = np.concatenate([[0], np.cumsum(sizes[filled])])
                for i, row in zip(filled, signatures(np.concatenate([sets[i] for i in filled]), begin)):
                    sigs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, to - at), pa.array(sizes), long_array(mixed(sums)), long_array(xors), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "h1", "h2", "sig"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the shingle set, and the signature (null without shingles)."""
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        _describe, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, CHUNKS, 4).astype(np.uint64)
        keys = np.empty((n, CHUNKS, 4), np.uint64)
        for drop in range(4):
            a, b, c = (sig[:, :, j] for j in range(4) if j != drop)
            keys[:, :, drop] = (a << np.uint64(32)) | (b << np.uint64(16)) | c
        keys |= (np.arange(CHUNKS * 4, dtype=np.uint64).reshape(1, CHUNKS, 4)) << np.uint64(48)
        for at in range(0, n, 2000):
            part = keys[at : at + 2000].reshape(-1)
            ids = np.repeat(batch.column(0).slice(at, 2000).to_numpy(), CHUNKS * 4)
            yield pa.RecordBatch.from_arrays([pa.array(ids), long_array(part)], names=["rep", "key"])


def bucket_keys(classes: DataFrame) -> DataFrame:
    """(rep, key): for each class all its chunk keys; the key's number is in the bits above 48."""
    return classes.select("rep", "sig").mapInArrow(_keys, "rep bigint, key bigint")


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Tables that never cut a run of equal values in `column`, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0
        if held and (held[-1].column(column)[held[-1].num_rows - 1].as_py() != values[0]):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _owned(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a (family, tile pair) that are of different components, near enough by size and signature, and
    whose first shared key is one of the family's."""
    own, rep, comp, size, mask = (table.column(i).to_numpy() for i in range(1, 6))
    sig = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint16).reshape(len(rep), CHUNKS, 4)
    family = table.column(0).to_numpy()
    order, ends = np.arange(len(rep)), np.flatnonzero(np.append(family[1:] != family[:-1], True)) + 1
    for x, end in enumerate(np.repeat(ends, np.diff(ends, prepend=0)).tolist()):
        # of a tile pair, only pairs across; of a tile with itself, all
        other = order[x + 1 : end]
        other = other[comp[other] != comp[x]]
        if own[x] >= 0:
            other = other[own[other] != own[x]]
        small, large = np.minimum(size[other], size[x]), np.maximum(size[other], size[x])
        other = other[DENOMINATOR * small >= NUMERATOR * large]
        if not len(other):
            continue
        wrong = (sig[other] != sig[x]).sum(axis=2, dtype=np.uint8)
        near = (wrong.sum(axis=1) <= DISTANCE) & (wrong.min(axis=1) <= 1)
        other, wrong = other[near], wrong[near]
        if not len(other):
            continue
        first = np.argmax(wrong <= 1, axis=1)
        unlike = sig[other, first] != sig[x, first]
        number = first * 4 + np.argmax(unlike, axis=1)
        mine = (mask[x] >> number) & 1 == 1
        if mine.any():
            yield x, other[mine]


MEMBER = "grp bigint, own int, rep bigint, comp bigint, n_shingles bigint, mask bigint, sig binary"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a family that have a pair to confirm there; the pairs themselves are never rows."""
    for table in _runs(batches, 0):
        met = np.zeros(table.num_rows, bool)
        for x, others in _owned(table):
            met[x] = True
            met[others] = True
        if met.any():
            yield from table.filter(pa.array(met)).combine_chunks().to_batches()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a family's members by their whole sets: of the pairs that are already joined here, none is repeated."""
    for table in _runs(batches, 0):
        sets: list[np.ndarray] = []
        for _, _, words in chunks(table.column(7), lower=True):
            sets += shingle_sets(words)
        sizes = np.array([len(s) for s in sets])
        begin = np.cumsum(sizes) - sizes
        # shingles are numbered, so that one member's are marked and those of many others counted at once
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
        marked = np.zeros(len(numbers), bool)
        rep, group = table.column(2).to_numpy(), table.column(3).to_numpy().copy()
        a, b = [], []
        for x, others in _owned(table):
            others = others[group[others] != group[x]]
            if not len(others):
                continue
            own = numbers[begin[x] : begin[x] + sizes[x]]
            marked[own] = True
            ends = np.cumsum(sizes[others])
            places = np.arange(ends[-1]) + np.repeat(begin[others] - ends + sizes[others], sizes[others])
            both = np.add.reduceat(marked[numbers[places]], ends - sizes[others], dtype=np.int64)
            marked[own] = False
            for y in others[DENOMINATOR * both >= NUMERATOR * (sizes[x] + sizes[others] - both)].tolist():
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    a.append(rep[x])
                    b.append(rep[y])
        if a:
            a, b = np.array(a), np.array(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, part, role): the hub's text comes first, then its members'."""
    hub, hub_set = None, None
    for batch in batches:
        roles, hubs, parts, nodes = (batch.column(i).to_numpy() for i in (2, 0, 1, 3))
        a, b = [], []
        for at, to, words in chunks(batch.column(4), lower=True):
            for i, s in zip(range(at, to), shingle_sets(words)):
                if roles[i] == 0:
                    hub, hub_set = (hubs[i], parts[i]), s
                elif hub == (hubs[i], parts[i]):
                    both = len(np.intersect1d(hub_set, s, assume_unique=True))
                    if both and DENOMINATOR * both >= NUMERATOR * (len(s) + len(hub_set) - both):
                        a.append(hubs[i])
                        b.append(nodes[i])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives whose whole shingle sets are similar enough.

    Each member's text goes to its hub, once for each pair; a hub's text goes to every PER_HUB of its members.
    """
    pairs = stored(pairs.select("a", "b").distinct(), "candidates")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_HUB).alias("parts"))
    spread = pairs.join(parts, "a").select(
        F.col("b").alias("node"), F.struct(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(1).alias("role")).alias("t"))
    own = parts.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(
        "node", F.struct(F.col("node").alias("hub"), "part", F.lit(0).alias("role")).alias("t"))
    sent = spread.unionByName(own)
    # the same plan at every size: both sides are shuffled
    rows = texts.join(sent.hint("merge"), "node").select("t.hub", "t.part", "t.role", "node", "text")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role", "node").mapInArrow(_confirm, "a bigint, b bigint")


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """described (doc_id, n_shingles, h1, h2, rep) and confirmed links (a, b) between representatives."""
    described = stored(describe(docs.filter("doc_id IS NOT NULL")), "described")
    sets = described.filter("n_shingles > 0").groupBy("n_shingles", "h1", "h2")
    classes = stored(sets.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keys = bucket_keys(classes)
    shared = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = stored(shared, "shared-keys")
    members = stored(lookup(keys, shared, "key", "members"), "members")
    texts = docs.select(F.col("doc_id").alias("node"), whole_text().alias("text")).filter("node IS NOT NULL")
    ready = classes.select("rep", "n_shingles", "sig")
    size_of = ready.select(F.col("rep").alias("hub"), F.col("n_shingles").alias("hub_shingles"))
    stars = members.filter("rep <> hub").select(F.col("hub"), "rep").distinct().join(ready.select("rep", "n_shingles"), "rep").join(size_of, "hub").filter(
        f"{DENOMINATOR} * least(n_shingles, hub_shingles) >= {NUMERATOR} * greatest(n_shingles, hub_shingles)")
    first = stored(confirm(stars.select(F.col("hub").alias("a"), F.col("rep").alias("b")), texts), "links")
    # one step, to the least hub that a class is linked to, spares most comparisons; all links make the components in the end
    joined = first.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    located = members.select("key", "hub", "rep").join(
        joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    located = stored(located.select("key", "hub", "rep", "comp"), "located")
    mixed_keys = located.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("key", "n")
    open_ = lookup(located, stored(mixed_keys, "open-keys"), "key", "n")
    # keys of one hub mostly have the same members: they are one family, in which a member is one row
    families = stored(open_.groupBy("hub", "rep").agg(
        F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(key, 48) AS int)))").alias("mask"), F.first("comp").alias("comp")
    ).join(ready, "rep"), "families")
    sizes = families.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).filter("n > 1")
    tiled = lookup(families, stored(sizes.withColumn("tiles", F.ceil(F.greatest(F.col("n") / TILE, F.col("weight") / TILE_SHINGLES)).cast("int")), "family-sizes"), "hub", "n")
    own = F.pmod(F.xxhash64("rep"), "tiles").cast("int")
    dealt = tiled.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
        # within one tile every pair counts
        F.when(F.col("own") == F.col("other"), -1 - F.col("own")).otherwise(F.col("own")).alias("own"), "rep", "comp", "n_shingles", "mask", "sig")
    waiting = stored(dealt.repartition("grp").sortWithinPartitions("grp", "rep").mapInArrow(_open, MEMBER), "waiting")
    texted = waiting.hint("merge").join(texts.withColumnRenamed("node", "rep"), "rep").select(*waiting.columns, "text")
    second = stored(texted.repartition("grp").sortWithinPartitions("grp", "rep").mapInArrow(_verify, "a bigint, b bigint"), "links")
    links = first.unionByName(second)
    reps = classes.select("n_shingles", "h1", "h2", "rep")
    return described.select("doc_id", "n_shingles", "h1", "h2").join(reps, ["n_shingles", "h1", "h2"], "left"), links


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text; others ignored).

    Null and blank texts have no shingles and are linked with nothing; rows with a null doc_id are their own,
    with a null component, and stay; repeated rows of one doc_id have the same result, once for each row.
    """
    described, links = near_classes(docs)
    groups = components(links).withColumnRenamed("node", "rep")
    out = described.join(groups, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nulls = describe(docs.filter("doc_id IS NULL")).select(
        "doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nulls)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
