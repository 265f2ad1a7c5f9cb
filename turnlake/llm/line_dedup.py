"""Line deduplication by an exact set-similarity join (operator 5).

A line's tokens are its distinct words. Lines with equal token sets are one class; classes are joined: tokens are
ordered by rarity, and similar lines share a token of their prefixes. Prefix tokens are dealt out by hash in packed
columns; where they meet, set sizes, the token's positions and 128-bit parity sketches bound the overlap. Each class
keeps its few likeliest earlier partners of a token; whole sets are compared with the likeliest first, then with the
others, and a class that had more partners than it kept and is still undecided meets all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import documents, stored, unused, whole_text
from turnlake.llm.words import Words, byte_chunks, chunks, mixed

NUMERATOR, DENOMINATOR = 75, 100
#: Hashes are counted in so many buckets, 4 bytes each, whatever the corpus; they are added up in ranges.
BUCKETS, RANGE = 1 << 21, 1 << 15
#: Partners of a token that a class keeps at first.
KEPT = 4
#: A token that about so many classes have or more is dealt out as pairs of tiles of them.
HOT = 20_000
#: Packed tokens, or hashes to be counted, that a task holds before it deals them out.
HELD = 1 << 20
#: Bytes of text that are cut into words at once here: their arrays stay in the processor's cache.
CHUNK = 1 << 16
#: Classes in a packed row, and those that a task unpacks at once.
BLOCK = 1 << 14
#: Bits of a filter of lines, and of one part of it.
FLAGS, FLAG_RANGE = 1 << 26, 1 << 18
#: Sets that are compared with one copy of an earlier one.
PER_HUB = 500


def _lines(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, first word) for all lines of a chunk that have words; words of a line are consecutive."""
    line = np.searchsorted(words.breaks, words.start)
    text = np.searchsorted(words.first, np.arange(len(words.start)), "right") - 1
    # a line break belongs to its text; lines of different texts differ even without one
    new = np.ones(len(words.start), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    before = np.searchsorted(words.breaks, words.bounds[:-1])
    return text[first], line[first] - before[text[first]], first


def counted(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How many of the hashes that `hashes` finds in batches of `rows` fall into each of BUCKETS buckets, up to 2^31 - 1."""
    most = 2**31 - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for h in hashes(batch):
                held.append(bucket_of(h))
                size += len(h)
                if size >= HELD:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        parts = [k for k in range(BUCKETS // RANGE) if total[k * RANGE : (k + 1) * RANGE].any()]
        for k in parts:
            yield packed(k, total[k * RANGE : (k + 1) * RANGE])

    def packed(part: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.minimum(counts, most).astype(np.int32).tobytes()], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = np.frombuffer(raw, np.int32) + sums.get(part, np.int64(0))
        for part, counts in sums.items():
            yield packed(part, counts)

    kind = "part int, counts binary"
    got = rows.mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).toArrow()
    out = np.zeros(BUCKETS, np.int32)
    for part, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[part * RANGE : (part + 1) * RANGE] = np.frombuffer(raw, np.int32)
    return out


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def _word_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, _, words in chunks(batch.column(0), size=CHUNK):
        yield words.hash


def rarity(docs: DataFrame) -> np.ndarray:
    """Words in each bucket of hashes, over all texts."""
    return counted(docs.select(whole_text().alias("text")), _word_hashes)


def sketches(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parities for each run of token hashes: two sets differ in at least as many tokens as their parities differ."""
    bit = mixed(h) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    return tuple(np.bitwise_xor.reduceat(np.where((bit < 64) == low, one, np.uint64(0)), begin) for low in (True, False))


def by_rarity(h: np.ndarray, rare: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Places in the order of (line, rarity on a log scale, hash), by one key of 64 bits where that tells tokens apart."""
    level = (32 * np.log2(1.0 + rare)).astype(np.uint64)
    key = (owner.astype(np.uint64) << np.uint64(44)) | (level << np.uint64(34)) | (h >> np.uint64(30))
    order = np.argsort(key)
    k, own = key[order], h[order]
    if owner[-1] >= 1 << 20 or ((k[1:] == k[:-1]) & (own[1:] != own[:-1])).any():
        return np.lexsort((h, level, owner))
    return order


#: What is packed of a class: the place of its first line, set size, parity sketch, how many tokens of its prefix occur
#: once in the corpus, and 32 bits of each of the others, which a similar line must share one of (`n` of them).
CLASS = (("doc", np.int64), ("line", np.int32), ("size", np.int32), ("s1", np.uint64), ("s2", np.uint64), ("skipped", np.int32), ("n", np.int32), ("prefix", np.uint32))
#: Two hashes of a token set, and the places of later lines with a set that an earlier one has.
SET = (("h1", np.uint64), ("h2", np.uint64))
COPIES = (("copy_doc", np.int64), ("copy_line", np.int32))


def _schema(*fields: tuple[tuple[str, type], ...]) -> str:
    return ", ".join(f"{c} binary" for columns in fields for c, _ in columns)


def _ends(column: pa.Array) -> np.ndarray:
    """Where the cells of a packed column begin, and where the last one ends."""
    _, offsets, _ = column.buffers()
    return np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all cells of a packed column, one cell's behind the other's."""
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, kind)
    ends = _ends(column)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)


def _packed(rows: dict[str, np.ndarray], *fields: tuple[tuple[str, type], ...]) -> dict[str, pa.Array]:
    return {c: pa.array([np.ascontiguousarray(rows[c], kind).tobytes()], pa.binary()) for columns in fields for c, kind in columns}


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places begin..begin + length of each run, one run behind the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _taken(rows: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    """The classes at the places `at`."""
    own = _runs((np.cumsum(rows["n"]) - rows["n"])[at], rows["n"][at])
    return {c: v[own if c == "prefix" else at] for c, v in rows.items()}


def _first_lines(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Of rows of equal token sets the one of the least place, in the order of the sets; document and line of the others."""
    order = np.lexsort((rows["line"], rows["doc"], rows["size"], rows["h2"], rows["h1"]))
    new = np.ones(len(order), bool)
    for k, c in enumerate(("h1", "h2", "size")):
        own = rows[c][order]
        new[1:] = (own[1:] != own[:-1]) | (new[1:] if k else False)
    rest = order[~new]
    return _taken(rows, order[new]), rows["doc"][rest], rows["line"][rest]


def _joined(parts: list[dict[str, np.ndarray]], *fields: tuple[tuple[str, type], ...]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.asarray(p[c]).astype(kind, copy=False) for p in parts]) if parts else np.zeros(0, kind) for columns in fields for c, kind in columns}


def line_classes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """The columns of CLASS and COPIES, packed: all lines with words, as classes of equal token sets and their later lines.

    Lines are dealt by their sets; a task sends one of a set and only the places of the others, so a frequent line is no hot key.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(counts)

    def deal(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, doc, line = _first_lines(_joined(held, CLASS, SET))
        bucket, other = (mixed(rows["h1"]) % np.uint64(n)).astype(np.int64), (_place_hash(doc, line) % np.uint64(n)).astype(np.int64)
        order, others = np.argsort(bucket, kind="stable"), np.argsort(other, kind="stable")
        cuts, ends = np.searchsorted(bucket[order], np.arange(n + 1)), np.searchsorted(other[others], np.arange(n + 1))
        for k in np.flatnonzero(np.diff(cuts) + np.diff(ends)):
            own, later = _taken(rows, order[cuts[k] : cuts[k + 1]]), others[ends[k] : ends[k + 1]]
            cells = _packed(own | {"copy_doc": doc[later], "copy_line": line[later]}, CLASS, SET, COPIES)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *cells.values()], names=["bucket", *cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, tokens = shared.value, [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, words in chunks(batch.column(1), lines=True, size=CHUNK):
                text, line, first = _lines(words)
                if not len(first):
                    continue
                owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words.hash))))
                rare = counts[bucket_of(words.hash)]
                order = by_rarity(words.hash, rare, owner)
                h, o, r = words.hash[order], owner[order], rare[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
                h, o, r = h[keep], o[keep], r[keep]
                begin = np.searchsorted(o, np.arange(len(first) + 1))
                size = np.diff(begin)
                place = np.arange(len(h)) - begin[o]
                # sets of one or two tokens are similar to equal ones only
                in_prefix = (place < size[o] - -(-NUMERATOR * size[o] // DENOMINATOR) + 1) & (size[o] > 2)
                alone = in_prefix & (r <= 1)
                used = in_prefix & ~alone
                of = lambda marked: np.add.reduceat(marked, begin[:-1], dtype=np.int64)
                s1, s2 = sketches(h, begin[:-1])
                # a set's hashes are sums and parities of its tokens'
                held.append({"doc": ids[at + text], "line": line, "size": size, "s1": s1, "s2": s2, "skipped": of(alone), "n": of(used), "prefix": h[used].astype(np.uint32),
                             "h1": mixed(np.add.reduceat(h, begin[:-1])), "h2": np.bitwise_xor.reduceat(mixed(h), begin[:-1])})
                tokens += len(h)
                if tokens >= HELD:
                    yield from deal(held)
                    held, tokens = [], 0
        if held:
            yield from deal(held)

    def told(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, doc, line = _first_lines(_joined(parts, CLASS, SET))
        doc, line = (np.concatenate([*(p[c] for p in parts), own]) for c, own in (("copy_doc", doc), ("copy_line", line)))
        for at in range(0, max(len(rows["doc"]), len(doc)), BLOCK):
            own = _taken(rows, np.arange(at, max(at, min(at + BLOCK, len(rows["doc"])))))
            cells = _packed(own | {"copy_doc": doc[at : at + BLOCK], "copy_line": line[at : at + BLOCK]}, CLASS, COPIES)
            yield pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if parts and bucket != now:
                    yield from told(parts)
                    parts = []
                now = bucket
                parts.append({c: _flat(batch.column(1 + j).slice(i, 1), kind) for j, (c, kind) in enumerate((*CLASS, *SET, *COPIES))})
        if parts:
            yield from told(parts)

    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", whole_text().alias("text"))
    packed = texts.mapInArrow(run, "bucket int, " + _schema(CLASS, SET, COPIES))
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, _schema(CLASS, COPIES))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Classes of a batch that begins with the columns of CLASS, about BLOCK at once, and which row each is from."""
    sizes = np.diff(_ends(batch.column(0))) // 8 if len(batch) else np.zeros(0, np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] - sizes[at] + BLOCK, "right")))
        yield {c: _flat(batch.column(j).slice(at, to - at), kind) for j, (c, kind) in enumerate(CLASS)}, np.repeat(np.arange(at, to), sizes[at:to])
        at = to


def _prefix_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for i in range(len(batch)):
        yield _flat(batch.column(0).slice(i, 1), np.uint32).astype(np.uint64)


def places(classes: DataFrame) -> DataFrame:
    """doc_id, line, first: all lines of packed classes, and whether it is the first of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                for j, first in ((0, True), (2, False)):
                    doc, line = _flat(batch.column(j).slice(i, 1), np.int64), _flat(batch.column(j + 1).slice(i, 1), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line), pa.array(np.full(len(doc), first))], names=["doc_id", "line", "first"])

    return classes.select("doc", "line", "copy_doc", "copy_line").mapInArrow(run, "doc_id bigint, line int, first boolean")


def classes_at(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The packed columns of CLASS, a class a row, of the classes at `wanted` (distinct doc_id, line)."""
    shared = classes.sparkSession.sparkContext.broadcast(flagged(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _ in _unpacked(batch):
                at = np.flatnonzero(is_flagged(shared.value, rows["doc"], rows["line"]))
                own, ends = _taken(rows, at), np.concatenate([[0], np.cumsum(rows["n"][at])])
                cut = lambda c, i: own[c][ends[i] : ends[i + 1]] if c == "prefix" else own[c][i : i + 1]
                yield pa.RecordBatch.from_arrays([pa.array(own["doc"]), pa.array(own["line"]), *(pa.array([cut(c, i).tobytes() for i in range(len(at))], pa.binary()) for c, _ in CLASS)],
                                                 names=["at_doc", "at_line", *(c for c, _ in CLASS)])

    some = classes.select(*(c for c, _ in CLASS)).mapInArrow(run, "at_doc bigint, at_line int, " + _schema(CLASS))
    asked = wanted.select(F.col("doc_id").alias("at_doc"), F.col("line").alias("at_line"))
    return some.join(asked, ["at_doc", "at_line"], "left_semi").drop("at_doc", "at_line")


#: What of a class goes with each of its tokens, packed by columns: token, class, set size, the token's place in the
#: order, tile (-1 where all pairs of a group count), whether the class looks for partners, and its sketch.
PACKED = (("key", np.uint32), ("doc", np.int64), ("line", np.int32), ("size", np.int32), ("pos", np.int32), ("tile", np.int16), ("open", np.uint8), ("s1", np.uint64), ("s2", np.uint64))


def _tiled(rows: dict[str, np.ndarray], counts: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of hot tokens once for each pair of tiles that theirs is in."""
    tiles = -(-counts.astype(np.int64) // HOT)
    if not (tiles > 1).any():
        return rows
    at = np.repeat(np.arange(len(tiles)), tiles)
    other = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    out = {k: v[at] for k, v in rows.items()}
    many = tiles[at] > 1
    own = (mixed(out["doc"].view(np.uint64) * np.uint64(31) + out["line"].astype(np.uint64)) % tiles[at].astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(own, other).astype(np.uint64) << np.uint64(20)) | np.maximum(own, other).astype(np.uint64)
    out["key"] = np.where(many, mixed((out["key"].astype(np.uint64) << np.uint64(32)) ^ (pair + np.uint64(1))).astype(np.uint32), out["key"])
    out["tile"] = np.where(many & (own != other), own, -1).astype(np.int16)
    return out


def prefix_counts(classes: DataFrame) -> np.ndarray:
    """Classes in each bucket of prefix tokens."""
    return counted(classes.select("prefix"), _prefix_hashes)


def token_hits(classes: DataFrame, counts: np.ndarray, kept: int | None = KEPT, wanted: np.ndarray | None = None) -> DataFrame:
    """doc_id, line, other_doc, other_line, apart, more: earlier partners, by the filters, of packed classes with `open` (0, 1).

    counts: prefix_counts of the classes. For each token a class keeps its `kept` partners of the least distance between sketches (None: all) and has `more`
    set where there were others. wanted: tokens by bucket that take part.
    """
    spark = classes.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((counts, None if wanted is None else wanted > 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = shared.value
        held: list[dict[str, np.ndarray]] = []

        def deal() -> Iterator[pa.RecordBatch]:
            rows = {k: np.concatenate([h[k] for h in held]) for k, _ in PACKED}
            bucket = (mixed(rows["key"].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[k] : cuts[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), *(pa.array([rows[c][own].tobytes()], pa.binary()) for c, _ in PACKED)], names=["bucket", *(c for c, _ in PACKED)])

        for batch in batches:
            opened = batch.column(len(CLASS)).to_numpy(zero_copy_only=False)
            for own, row in _unpacked(batch):
                token, sizes = own["prefix"], own["n"].astype(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                pos = own["skipped"][owner] + np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                bucket = bucket_of(token.astype(np.uint64))
                keep = counts[bucket] > 1
                if some is not None:
                    keep &= some[bucket]
                o = owner[keep]
                rows = _tiled({"key": token[keep], "pos": pos[keep], "tile": np.full(len(o), -1), "open": opened[row][o]} | {c: own[c][o] for c in ("doc", "line", "size", "s1", "s2")}, counts[bucket[keep]])
                held.append({k: rows[k].astype(kind) for k, kind in PACKED})
                if sum(len(h["key"]) for h in held) >= HELD:
                    yield from deal()
                    held = []
        if held:
            yield from deal()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if parts and bucket != now:
                    yield from _partners(parts, kept)
                    parts = []
                now = bucket
                parts.append([np.frombuffer(batch.column(1 + j)[i].as_buffer(), kind) for j, (_, kind) in enumerate(PACKED)])
        if parts:
            yield from _partners(parts, kept)

    packed = classes.select(*(c for c, _ in CLASS), "open").mapInArrow(pack, "bucket int, " + _schema(PACKED))
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        meet, "doc_id bigint, line int, other_doc bigint, other_line int, apart int, more boolean")


def _partners(parts: list[list[np.ndarray]], kept: int | None) -> Iterator[pa.RecordBatch]:
    """Partners within one bucket of tokens: places k apart in the order of (token, set size) are compared at once, up
    to sizes that are too large."""
    rows = {c: np.concatenate([p[j] for p in parts]) for j, (c, _) in enumerate(PACKED)}
    order = np.lexsort((rows["size"], rows["key"]))
    key, doc, line, size, pos, tile, open_, s1, s2 = (rows[c][order] for c, _ in PACKED)
    n = len(key)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((line, doc))] = np.arange(n)
    wide = kept or 1
    best, apart, met = np.zeros((n, wide), np.int64), np.full((n, wide), 1 << 30, np.int32), np.zeros(n, np.int64)

    def given(y: np.ndarray, x: np.ndarray, d: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc[y]), pa.array(line[y]), pa.array(doc[x]), pa.array(line[x]), pa.array(d.astype(np.int32)), pa.array(more)],
                                          names=["doc_id", "line", "other_doc", "other_line", "apart", "more"])

    step, left = 1, np.arange(n)
    while True:
        left = left[: np.searchsorted(left, n - step)]
        right = left + step
        going = (key[left] == key[right]) & (DENOMINATOR * size[left] >= NUMERATOR * size[right])
        left, right = left[going], right[going]
        if not len(left):
            break
        both = size[left] + size[right]
        ok = np.minimum(size[left] - pos[left], size[right] - pos[right]) * (DENOMINATOR + NUMERATOR) >= NUMERATOR * both
        x, y, both = left[ok], right[ok], both[ok]
        d = np.bitwise_count(s1[x] ^ s1[y]).astype(np.int32) + np.bitwise_count(s2[x] ^ s2[y])
        ok = (d * (DENOMINATOR + NUMERATOR) <= (DENOMINATOR - NUMERATOR) * both) & ((tile[x] < 0) | (tile[x] != tile[y]))
        ok &= (doc[x] != doc[y]) | (line[x] != line[y])
        x, y, d = x[ok], y[ok], d[ok]
        swapped = rank[x] > rank[y]
        # the later class of a pair looks for the earlier one; none is later in two pairs of one half
        for later, earlier, own in ((y[~swapped], x[~swapped], d[~swapped]), (x[swapped], y[swapped], d[swapped])):
            looks = open_[later] > 0
            later, earlier, own = later[looks], earlier[looks], own[looks]
            if not len(later):
                continue
            if kept is None:
                yield given(later, earlier, own, np.zeros(len(later), bool))
                continue
            met[later] += 1
            slot = np.where(met[later] <= kept, np.minimum(met[later], kept) - 1, apart[later].argmax(axis=1))
            nearer = own < apart[later, slot]
            best[later[nearer], slot[nearer]], apart[later[nearer], slot[nearer]] = earlier[nearer], own[nearer]
        step += 1
    if kept is not None:
        y, slot = np.nonzero(apart < 1 << 30)
        for at in range(0, len(y), 50_000):
            own, place = y[at : at + 50_000], slot[at : at + 50_000]
            yield given(own, best[own, place], apart[own, place], met[own] > kept)


def _place_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mixed(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def flagged(lines: DataFrame) -> np.ndarray:
    """A filter of `lines` (doc_id, line): FLAGS bits, eight a byte, with that of each line's hash set."""

    def parts(found: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.searchsorted(found, np.arange(0, FLAGS + 1, FLAG_RANGE))
        for k in np.flatnonzero(np.diff(cuts)):
            bits = np.zeros(FLAG_RANGE, bool)
            bits[found[cuts[k] : cuts[k + 1]] - k * FLAG_RANGE] = True
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(_place_hash(b.column(0).to_numpy(), b.column(1).to_numpy()) % np.uint64(FLAGS)).astype(np.int64) for b in batches]
        if found:
            yield from parts(np.unique(np.concatenate(found)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = np.frombuffer(raw, np.uint8) | sums.get(part, np.uint8(0))
        for part, bits in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

    kind = "part int, bits binary"
    got = lines.select("doc_id", "line").mapInArrow(mark, kind).repartition("part").mapInArrow(add, kind).toArrow()
    out, size = np.zeros(FLAGS // 8, np.uint8), FLAG_RANGE // 8
    for part, raw in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[part * size : (part + 1) * size] = np.frombuffer(raw, np.uint8)
    return out


def is_flagged(flags: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    at = (_place_hash(doc, line) % np.uint64(FLAGS)).astype(np.int64)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, line, tokens (binary): sorted token hashes of the lines in `wanted` (doc_id, line), and of some others.

    Wanted lines are told by bits of a hash, so that no text is shuffled, and only they are cut into words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(flagged(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, bounds in byte_chunks(batch.column(1), CHUNK):
                breaks = np.flatnonzero(data == 10)
                # lines begin with texts and behind their breaks; a text without bytes has none
                begin = np.union1d(bounds[:-1], breaks + 1)
                begin = begin[begin < len(data)]
                text = np.searchsorted(bounds, begin, "right") - 1
                line = np.searchsorted(breaks, begin) - np.searchsorted(breaks, bounds)[text]
                end = np.append(begin[1:], len(data))
                doc = ids[at + text]
                own = np.flatnonzero(is_flagged(flags, doc, line))
                if not len(own):
                    continue
                size = end[own] - begin[own]
                words = Words(data[_runs(begin[own], size)], np.concatenate([[0], np.cumsum(size)]))
                some = np.flatnonzero(np.diff(words.first))
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc[own[some]]), pa.array(line[own[some]].astype(np.int32)),
                    pa.array([np.unique(words.hash[words.first[i] : words.first[i + 1]]).tobytes() for i in some], pa.binary())], names=["doc_id", "line", "tokens"])

    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, line int, tokens binary").groupBy("doc_id", "line").agg(F.min("tokens").alias("tokens"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, part, role): the earlier line's tokens come first, then those of its partners."""
    hub, hub_set = None, None
    for batch in batches:
        hubs, roles, tokens = list(zip(*(batch.column(i).to_pylist() for i in range(3)))), batch.column(3).to_pylist(), batch.column(6)
        found = []
        for i, own in enumerate(hubs):
            own_set = np.frombuffer(tokens[i].as_buffer(), np.uint64)
            if roles[i] == 0:
                hub, hub_set = own, own_set
            elif hub == own:
                both = len(np.intersect1d(hub_set, own_set, assume_unique=True))
                if DENOMINATOR * both >= NUMERATOR * (len(own_set) + len(hub_set) - both):
                    found.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(found, pa.int64())), batch.column(5).take(pa.array(found, pa.int64()))], names=["doc_id", "line"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, line of the pairs (doc_id, line, other_doc, other_line) whose whole token sets are similar enough.

    A set goes once to each partner; an earlier line's set goes to every PER_HUB of its partners.
    """
    parts = pairs.groupBy("other_doc", "other_line").agg(F.ceil(F.count(F.lit(1)) / PER_HUB).alias("parts"))
    hub = ["other_doc", "other_line"]
    spread = pairs.join(parts, hub).select(*hub, F.pmod(F.xxhash64("doc_id", "line"), "parts").alias("part"), F.lit(1).alias("role"), "doc_id", "line")
    own = parts.select(*hub, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role")).select(
        *hub, "part", "role", F.col("other_doc").alias("doc_id"), F.col("other_line").alias("line"))
    rows = sets.join(spread.unionByName(own).hint("merge"), ["doc_id", "line"]).select(*hub, "part", "role", "doc_id", "line", "tokens")
    key = [*hub, "part"]
    return rows.repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(_compare, "doc_id bigint, line int").distinct()


def later_copies(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, line of the packed `classes` whose token sets are similar to that of an earlier one."""
    counts = prefix_counts(classes)
    at, other = ["doc_id", "line"], ["other_doc", "other_line"]
    both = lambda pairs: pairs.select(*at).unionByName(pairs.select(F.col("other_doc").alias("doc_id"), F.col("other_line").alias("line"))).distinct()
    hits = token_hits(classes.withColumn("open", F.lit(1)), counts)
    pairs = stored(hits.groupBy(*at, *other).agg(F.min("apart").alias("apart"), F.max("more").alias("more")), "line-pairs")
    sets = stored(line_sets(docs, both(pairs)), "line-sets")
    likeliest = pairs.groupBy(*at).agg(F.min_by(F.struct(*other), F.struct("apart", *other)).alias("o")).select(*at, "o.*")
    gone = stored(similar(likeliest, sets), "lines-gone")
    rest = pairs.join(gone, at, "left_anti").join(likeliest, [*at, *other], "left_anti")
    gone = stored(gone.unionByName(similar(rest.select(*at, *other), sets)), "lines-gone")
    undecided = stored(pairs.filter("more").select(*at).distinct().join(gone, at, "left_anti"), "lines-undecided")
    if undecided.isEmpty():
        return gone
    # all classes may be partners; the undecided ones come once more, as those that look for them
    looking = stored(classes_at(classes, undecided), "lines-undecided")
    meeting = classes.withColumn("open", F.lit(0)).select(*looking.columns, "open").unionByName(looking.withColumn("open", F.lit(1)))
    all_pairs = stored(token_hits(meeting, counts, None, prefix_counts(looking)).select(*at, *other).distinct(), "line-pairs")
    return gone.unionByName(similar(all_pairs, stored(line_sets(docs, both(all_pairs)), "line-sets")))


def line_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, line, removed once for each line with words of `docs`; the order is that of (doc_id, line).

    A line is removed when an earlier line has a token set of Jaccard similarity 0.75 or more, removed or not.
    """
    classes = stored(line_classes(docs, rarity(docs)), "line-classes")
    gone = later_copies(docs, classes).select("doc_id", "line", F.lit(False).alias("first"), F.lit(True).alias("similar"))
    # a line stays where a class begins that nothing earlier is similar to
    each = places(classes).withColumn("similar", F.lit(False)).unionByName(gone).repartition("doc_id").groupBy("doc_id", "line").agg(F.max("first").alias("first"), F.max("similar").alias("similar"))
    return each.select("doc_id", "line", (F.col("similar") | ~F.col("first")).alias("removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (line numbers from 0, sorted) for every row of `docs`.

    Lines are cut at \n; those without words are never removed and don't count; null and empty texts have none.
    Rows with a null doc_id have no place in the order and keep their lines. Rows that repeat a doc_id are copies of
    one document: their lines count once.
    """
    per = line_decisions(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"),
        F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line")))).alias("removed_lines"))
    zero = F.lit(0).cast("long")
    return docs.select("doc_id").join(per, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))


def remove_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """`docs`, all columns, without the lines that `decisions` (line_dedup) removes from them."""
    of, lines = unused(docs, "_of", "_gone")
    gone = decisions.filter("n_removed > 0").groupBy("doc_id").agg(F.first("removed_lines").alias(lines)).withColumnRenamed("doc_id", of)
    out = docs.join(gone, docs["doc_id"] == gone[of], "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(lines, i)), "\n")
    return out.withColumn("text", F.when(F.col(of).isNull(), F.col("text")).otherwise(rest)).drop(lines, of)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))
