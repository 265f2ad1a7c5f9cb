"""Byte-level BPE encoding and decoding with a lexicon transducer (operator 1).

Frequent words of the corpus are counted in Spark, encoded once and compiled into a minimal acyclic transducer
whose outputs are token ids. Tasks memory-map it; words that it lacks are merged exactly, lowest rank first.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import documents, whole_text
from turnlake.llm.lexicon import Lexicon, compile_lexicon

#: Pre-tokens of the byte-level vocabularies (fixed by their published pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Space-separated pieces are counted in so many groups by hash; each gives its most frequent ones to the lexicon,
#: from a sketch that tracks so many.
GROUPS, FREQUENT, TRACKED = 32, 1000, 2048
#: Encoded pieces that a worker remembers, and as many older ones: some 20 MB each.
REMEMBERED = 100_000
#: Behind every rank of a merge, and the key of a place where none begins. In a table of pairs, a slot without one.
NO_MERGE = (1 << 31) - 1
NO_PLACE, FREE = NO_MERGE << 8, -2
#: Longer words are merged with a heap; of the others so many at once, those of like lengths together.
LONG, TOGETHER = 64, 1 << 13
#: Text that is encoded at once, and decoded text that is given back at once.
TOGETHER_BYTES, OUT_BYTES = 1 << 20, 1 << 23


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + i)
    return table


def load_vocabulary(path: str) -> dict:
    """What tasks need of a tokenizer file: token bytes by id, merges by pair of ids, special strings."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model = spec["model"]
    back = {c: b for b, c in byte_alphabet().items()}
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for s, i in vocab.items():
        tokens[i] = bytes(back[c] for c in s)
    for s, i in special.items():
        tokens[i] = s.encode()
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[(vocab[a], vocab[b])] = (rank, vocab[a + b])
    first = [vocab[byte_alphabet()[b]] for b in range(256)]
    return {
        "tokens": tokens, "bytes": first, "merges": merges, "special": special, "byte_ids": np.array(first, np.int32),
        # the same merges for look-ups of many pairs at once: a table of pairs and their ranks, and what each rank gives
        "table": pair_table(np.array([(a << 32) | b for a, b in merges], np.int64), np.array([rank for rank, _ in merges.values()], np.int32)),
        "merged": np.array([i for _, i in sorted(merges.values())], np.int32),
    }


def merge_all(words: list[bytes], vocabulary: dict) -> list[bytes]:
    """Id bytes of pre-tokens: in each always the pair of the lowest rank, the leftmost first; all words at once."""
    found: list = [b""] * len(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for i in np.flatnonzero(sizes > LONG).tolist():
        found[i] = id_bytes(_merge_long([vocabulary["bytes"][b] for b in words[i]], vocabulary["merges"]))
    order = np.argsort(sizes, kind="stable")
    order = order[np.searchsorted(sizes[order], 1) : np.searchsorted(sizes[order], LONG, "right")].tolist()
    for at in range(0, len(order), TOGETHER):
        own = order[at : at + TOGETHER]
        ids = _merge_rows(byte_matrix([words[i] for i in own]), vocabulary)
        held = ids >= 0
        ends, raw = (4 * held.sum(axis=1).cumsum()).tolist(), ids[held].astype("<i4").tobytes()
        for i, start, end in zip(own, [0, *ends], ends):
            found[i] = raw[start:end]
    return found


def byte_matrix(words: list[bytes]) -> np.ndarray:
    """A row of bytes for each word, -1 behind its end."""
    sizes = np.array([len(w) for w in words])
    out = np.full((len(words), int(sizes.max(initial=1))), -1, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out


def _slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Where look-ups of packed pairs begin in a table of 2^bits slots."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def pair_table(pairs: np.ndarray, ranks: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, pairs, ranks) by slot: a pair lies in its first slot or one of those behind it, none of them free."""
    bits = max(4, (4 * len(pairs)).bit_length())
    # taken slots may run beyond the last
    keys, values = np.full((1 << bits) + len(pairs) + 1, FREE, np.int64), np.full((1 << bits) + len(pairs) + 1, NO_MERGE, np.int32)
    at = _slots(pairs, bits)
    while len(pairs):
        free = keys[at] == FREE
        keys[at[free]], values[at[free]] = pairs[free], ranks[free]
        # of several pairs that took one slot, the last has it
        left = keys[at] != pairs
        values[at[~left]] = ranks[~left]
        at, pairs, ranks = at[left] + 1, pairs[left], ranks[left]
    return bits, keys, values


def _ranks(left: np.ndarray, right: np.ndarray, vocabulary: dict) -> np.ndarray:
    """Ranks of pairs of ids, NO_MERGE for those that don't merge or have a -1."""
    bits, keys, values = vocabulary["table"]
    wanted = (left.astype(np.int64) << 32) | right
    at = _slots(wanted, bits)
    held = keys[at]
    out = np.where(held == wanted, values[at], NO_MERGE)
    going = np.flatnonzero((held != wanted) & (held != FREE))
    while len(going):
        at[going] += 1
        held = keys[at[going]]
        same = held == wanted[going]
        out[going[same]] = values[at[going[same]]]
        going = going[~same & (held != FREE)]
    return out


def _merge_rows(raw: np.ndarray, vocabulary: dict) -> np.ndarray:
    """Ids of rows of at most LONG bytes, with -1 between and behind them.

    A column holds a word between two places that hold none; places are linked with those before and behind. The key of
    a place is the rank of the pair that begins there, then the place, so the least key of a column is the next merge.
    """
    n, width = raw.shape
    ids = np.full((width + 2, n), -1, np.int32)
    ids[1:-1] = np.where(raw < 0, -1, vocabulary["byte_ids"][raw]).T
    key = np.full(ids.shape, NO_PLACE, np.int64)
    places = np.arange(width + 2, dtype=np.int64)[:, None]
    key[1:-1] = (_ranks(ids[1:-1].ravel(), ids[2:].ravel(), vocabulary).reshape(width, n).astype(np.int64) << 8) | places[1:-1]
    before, after = (np.repeat(places + d, n, axis=1).ravel() for d in (-1, 1))
    merged, flat_ids, flat_key = vocabulary["merged"], ids.ravel(), key.ravel()
    while True:
        least = key.min(axis=0)
        column = np.flatnonzero(least < NO_MERGE << 8)
        if not len(column):
            return ids[1:-1].T
        least = least[column]
        place = least & 255
        at = place * n + column
        gone = after[at] * n + column
        behind, ahead = after[gone], before[at]
        flat_ids[at], flat_ids[gone], flat_key[gone] = merged[least >> 8], -1, NO_PLACE
        after[at], before[behind * n + column] = behind, place
        own = flat_ids[at]
        flat_key[at] = (_ranks(own, flat_ids[behind * n + column], vocabulary).astype(np.int64) << 8) | place
        at = ahead * n + column
        flat_key[at] = (_ranks(flat_ids[at], own, vocabulary).astype(np.int64) << 8) | ahead


def _merge_long(ids: list[int], merges: dict) -> list[int]:
    """The same with a heap of pairs and linked neighbours: n log n for words of any length."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i] = merges[(a, b)][1]
        gone[j] = 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if m := merges.get((ids[i], ids[after[j]])):
                heapq.heappush(heap, (m[0], i, ids[i], ids[after[j]]))
        if (h := before[i]) >= 0 and (m := merges.get((ids[h], ids[i]))):
            heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
    return [x for i, x in enumerate(ids) if not gone[i]]


def id_bytes(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class Encoder:
    """Pieces to id bytes. A piece is a word of letters, with a space before it or none, up to white space or a common
    mark, or else white space followed by the rest up to the next white space: pre-tokens cross neither border and
    don't depend on what is before them, so pieces are encoded on their own.

    New pieces of many texts are encoded together: their pre-tokens walk the lexicon, and those that it lacks are
    merged. Pieces that were not met since REMEMBERED others came are forgotten.
    """

    piece = re.compile(r""" ?[^\W\d_]++(?=[ \n,.;:!?"'()-]|\Z)|[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+""")
    word = regex.compile(PATTERN)

    def __init__(self, vocabulary: dict, block: bytes):
        self.vocabulary, self.lexicon = vocabulary, Lexicon(block)
        special = sorted(vocabulary["special"], key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.fixed = {s: i.to_bytes(4, "little") for s, i in vocabulary["special"].items()}
        self.known, self.older = dict(self.fixed), {}

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; special strings in it are pieces of their own."""
        if self.special is None or not self.special.search(text):
            return self.piece.findall(text)
        return [p for part in self.special.split(text) if part for p in ([part] if part in self.fixed else self.piece.findall(part))]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Id bytes of all `pieces`, and of others."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = dict(self.fixed), self.known
        known, older = self.known, self.older
        new = []
        for p in pieces.difference(known):
            ids = older.get(p)
            if ids is None:
                new.append(p)
            else:
                known[p] = ids
        if new:
            # letters alone, behind a space or not, are one pre-token
            plain, parts = [], []
            for p in new:
                if (p[1:] if p[0] == " " else p).isalpha():
                    plain.append(p)
                else:
                    parts.append((p, self.word.findall(p)))
            words = list({*plain, *(w for _, ws in parts for w in ws if w not in known)})
            raw = [w.encode("utf-8", "replace") for w in words]
            held = self.lexicon.get_all(raw)
            unseen = [i for i, ids in enumerate(held) if ids is None]
            for i, ids in zip(unseen, merge_all([raw[i] for i in unseen], self.vocabulary)):
                held[i] = ids
            known.update(zip(words, held))
            for p, ws in parts:
                known[p] = b"".join([known[w] for w in ws])
        return known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Id bytes of whole texts."""
        cut = [self.cut(t) for t in texts]
        known = self.learn(set().union(*cut))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; they are cut and their pieces told apart in Arrow, each different one is met once."""
        column = pa.array(texts, pa.string())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32, len(texts) + 1)
        if not ends[-1]:
            return [0] * len(texts)
        begins = piece_starts(np.frombuffer(data, np.uint8, ends[-1]))
        begins[ends] = True
        bounds = np.flatnonzero(begins).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), data).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.learn(set(pieces))
        sizes = np.fromiter(map(len, map(known.__getitem__, pieces)), np.int64, len(pieces))
        sums = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])])[np.searchsorted(bounds, ends)]
        out = (np.diff(sums) // 4).tolist()
        for special in self.fixed:
            for i in np.flatnonzero(pc.match_substring(column, special).to_numpy(zero_copy_only=False)).tolist():
                out[i] = len(self.encode(texts[i])) // 4
        return out


def _kinds() -> np.ndarray:
    """Of each byte: white space, mark, digit, letter, part of a longer character, or none of these."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = MARK
    kinds[[*range(9, 14), 32]] = WHITE
    for kind, first, last in ((DIGIT, "0", "9"), (LETTER, "A", "Z"), (LETTER, "a", "z")):
        kinds[ord(first) : ord(last) + 1] = kind
    kinds[128:] = LONGER
    return kinds


WHITE, MARK, DIGIT, LETTER, LONGER = 1, 2, 3, 4, 5
_KINDS = _kinds()


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Whether a piece may begin at each byte of UTF-8 and at the end: at white space behind what is none, and at a mark
    behind a letter. No pre-token crosses these borders or depends on what is on their other side.
    """
    out = np.zeros(len(data) + 1, bool)
    kinds = _KINDS[data]
    before, own = kinds[:-1], kinds[1:]
    white = own == WHITE
    out[1:-1] = (white & (before >= MARK)) | ((own == MARK) & (before == LETTER))
    # longer white space is U+0085, U+00A0, or begins with E1, E2 or E3; nothing that begins so counts as visible
    at = np.flatnonzero(white & (before == LONGER)) + 1
    second, third = data[at - 2], data[np.maximum(at - 3, 0)]
    out[at] = (second >= 0xC3) | ((second < 0xC0) & ((third < 0xE1) | (third > 0xE3)))
    return out


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of `most` characters in sum or little more; a longer row is alone."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


_encoders: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """One encoder in each worker process for a broadcast (vocabulary, block)."""
    key = getattr(shared, "_jid", None) or id(shared)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*shared.value)
    return _encoders[key]


def frequent_words(docs: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """Pre-tokens of the most frequent space-separated pieces, counted over all texts in mergeable sketches, one a group."""
    pieces = docs.select(F.explode(F.split(whole_text(), " ")).alias("piece")).filter("length(piece) BETWEEN 1 AND 40")
    grouped = pieces.groupBy(F.pmod(F.xxhash64("piece"), F.lit(GROUPS)).alias("g")).agg(F.expr(f"approx_top_k(piece, {frequent}, {tracked})").alias("top"))
    word = regex.compile(PATTERN)
    return sorted({w for row in grouped.select("top.item").collect() for piece in row["item"] for w in word.findall(" " + piece)})


def build(docs: DataFrame, path: str, frequent: int = FREQUENT) -> tuple[dict, bytes]:
    """(vocabulary, lexicon block) for a corpus: at most GROUPS * `frequent` pieces reach the driver."""
    vocabulary = load_vocabulary(path)
    words = [w.encode("utf-8", "replace") for w in frequent_words(docs, frequent)]
    ids = [tuple(memoryview(x).cast("I")) for x in merge_all(words, vocabulary)]
    return vocabulary, compile_lexicon(dict(zip(words, ids)))


ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
Batches = Iterator[pa.RecordBatch]


def _encoding(shared) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        encoder = worker_encoder(shared)
        for batch in batches:
            for at, to in groups(pc.binary_length(batch.column(1)).to_pylist(), TOGETHER_BYTES):
                out = encoder.encode_all(batch.column(1).slice(at, to - at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])

    return run


def _decoding(shared) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        tokens = shared.value[0]["tokens"]
        for batch in batches:
            ids, at, out, held = batch.column(2), 0, [], 0
            for i in range(batch.num_rows):
                raw = memoryview(ids[i].as_buffer()).cast("I") if len(ids[i].as_buffer()) else ()
                out.append(b"".join([tokens[t] for t in raw]).decode("utf-8", "replace"))
                held += len(out[-1])
                if held > OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(out)) for c in batch.columns), pa.array(out, pa.string())],
                                                     names=["doc_id", "n_tokens", "ids", "decoded"])
                    at, out, held = i + 1, [], 0

    return run


def encode(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit) for each row; `shared` broadcasts what build() gives.

    A null text is empty and has no tokens; nothing is truncated or padded; repeated rows are encoded alike.
    """
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(_encoding(shared), ENCODED)


def decode(encoded: DataFrame, shared) -> DataFrame:
    """The rows of `encoded` (doc_id, n_tokens, ids) with their text as `decoded`; bad UTF-8 becomes U+FFFD."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decoding(shared), ENCODED + ", decoded string")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded for all of `docs` with a lexicon of its own frequent words."""
    shared = docs.sparkSession.sparkContext.broadcast(build(docs, path or tokenizer_path()))
    first, second = _encoding(shared), _decoding(shared)
    # one worker does both
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(lambda batches: second(first(batches)), ENCODED + ", decoded string")


def digested(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode_decode(docs, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(documents(spark, sf_dir))
