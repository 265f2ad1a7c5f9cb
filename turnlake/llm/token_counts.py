"""Token counts that follow edits (operator 3).

A document's pre-tokens are grouped into leaves at places where a white-space character follows another character:
no pre-token crosses them and nothing before depends on what comes after, so leaves are encoded on their own. Over
the leaves lies a segment tree of code point and token sums, stored whole as one row a document. An edit descends to
the leaves that it touches, and takes in a neighbour only where the characters at a border no longer make a cut;
these leaves alone are encoded again, and the sums above them are updated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.bpe import Encoder, build, groups, tokenizer_path, worker_encoder
from turnlake.llm.common import documents, stored, whole_text

#: Code points that a new leaf holds at least, if the text has places to cut, and those up to which it grows.
LEAF, SPLIT = 128, 512
#: Text whose leaves are counted at once.
TOGETHER_BYTES = 1 << 22
_CUT = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")


def cut(text: str) -> list[str]:
    """Leaves of at least LEAF code points, but for the last; a text without white space is one leaf."""
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + LEAF)
        to = m.start() if m else len(text)
        out.append(text[at:to])
        at = to
    return out


def is_cut(text: str, at: int) -> bool:
    return at <= 0 or at >= len(text) or _CUT.match(text, at) is not None


class Tree:
    """Segment tree over leaves: sums of chars and tokens in heap order, leaf i at position size + i."""

    __slots__ = ("chars", "size", "tokens")

    def __init__(self, chars: list[int], tokens: list[int]):
        """From the stored sums of all nodes; none make the tree of one empty leaf."""
        self.chars, self.tokens = chars or [0, 0], tokens or [0, 0]
        self.size = len(self.chars) // 2

    @classmethod
    def over(cls, chars: list[int], tokens: list[int]) -> Tree:
        """From leaves."""
        tree = cls([], [])
        tree.fill(chars, tokens)
        return tree

    def fill(self, chars: list[int], tokens: list[int]) -> None:
        self.size = size = 1 << max(0, (len(chars) - 1).bit_length())
        rest = [0] * (size - len(chars))
        for name, leaves in (("chars", chars), ("tokens", tokens)):
            levels = [[*leaves, *rest]]
            while len(levels[-1]) > 1:
                last = levels[-1]
                levels.append([last[i] + last[i + 1] for i in range(0, len(last), 2)])
            setattr(self, name, [0, *(x for level in reversed(levels) for x in level)])

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its first code point) for a place in the text; the last filled leaf for places beyond."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if offset >= start + self.chars[i] and self.chars[i + 1] > 0:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = self.size + leaf
        more_chars, more_tokens = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += more_chars
            self.tokens[i] += more_tokens
            i //= 2


def edit_leaves(text: str, tree: Tree, edit: dict) -> tuple[str, list[tuple[int, str]], int]:
    """The text after replacing code points [start, stop) by `by`, the (leaf, text) pairs to encode, and their code points.

    Sums of code points are updated here, those of tokens wait for the encoded leaves.
    """
    start = min(max(0, edit["start"]), len(text))
    stop = min(max(start, edit["stop"]), len(text))
    new = text[:start] + edit["by"] + text[stop:]
    more = len(new) - len(text)
    low, begin = tree.find(start)
    high, at = tree.find(stop)
    chars, size = tree.chars, tree.size
    end = at + chars[size + high] + more
    # a border is looked at in the new text: empty leaves beside it are passed over
    while low > 0 and (end == begin or not is_cut(new, begin)):
        low -= 1
        begin -= chars[size + low]
    while high + 1 < size and (end == begin or not is_cut(new, end)):
        high += 1
        end += chars[size + high]
    region = new[begin:end]
    pieces = [region] if len(region) <= SPLIT else cut(region)
    room = high - low + 1
    if len(pieces) > room:
        # leaves are dealt out anew once one of them has grown to several
        leaves = slice(size, 2 * size)
        own, counts = tree.chars[leaves], tree.tokens[leaves]
        tree.fill([*own[:low], *map(len, pieces), *own[high + 1 :]], [*counts[:low], *([0] * len(pieces)), *counts[high + 1 :]])
        room = len(pieces)
    for k in range(room):
        tree.put(low + k, len(pieces[k]) if k < len(pieces) else 0, 0)
    return new, [(low + k, p) for k, p in enumerate(pieces) if p], len(region)


def edit_all(texts: list[str], trees: list[Tree], edits: list[list[dict]], encoder: Encoder) -> tuple[list[str], list[int]]:
    """The texts after their edits, and the code points that were encoded for each; the trees follow.

    The first edits of all documents are made, and their leaves encoded together, then the second ones, and so on.
    """
    texts, encoded = list(texts), [0] * len(texts)
    for turn in range(max(map(len, edits), default=0)):
        waiting: list[tuple[Tree, int]] = []
        leaves: list[str] = []
        for i, own in enumerate(edits):
            if turn < len(own):
                texts[i], pieces, n = edit_leaves(texts[i], trees[i], own[turn])
                encoded[i] += n
                waiting += [(trees[i], leaf) for leaf, _ in pieces]
                leaves += [p for _, p in pieces]
        for (tree, leaf), n, p in zip(waiting, encoder.count_all(leaves), leaves):
            tree.put(leaf, len(p), n)
    return texts, encoded


def lists(column: pa.ListArray) -> list[list[int]]:
    """Lists of numbers, with none for a null one; far cheaper than a scalar for each number."""
    flat = column.flatten().to_numpy().tolist()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
    return [flat[start:end] for start, end in zip([0, *ends], ends)]


TREE = "doc_id bigint, text string, node_chars array<int>, node_tokens array<int>"
_SUMS = pa.list_(pa.int32())


def build_trees(docs: DataFrame, shared) -> DataFrame:
    """doc_id, text, node_chars, node_tokens (sums in heap order): one row for each of `docs`; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for at, to in groups(pc.binary_length(batch.column(1)).to_pylist(), TOGETHER_BYTES):
                own = batch.slice(at, to - at)
                pieces = [cut(t) for t in own.column(1).to_pylist()]
                counts = encoder.count_all([p for ps in pieces for p in ps])
                trees, k = [], 0
                for ps in pieces:
                    trees.append(Tree.over([len(p) for p in ps], counts[k : k + len(ps)]))
                    k += len(ps)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array([t.chars for t in trees], _SUMS), pa.array([t.tokens for t in trees], _SUMS)],
                    names=["doc_id", "text", "node_chars", "node_tokens"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, TREE)


def apply_edits(trees: DataFrame, edits: DataFrame, shared) -> DataFrame:
    """The trees after their edits (doc_id, seq, start, stop, by), with n_edits and reencoded_chars.

    Edits of a document apply in order of seq, each to the text that the ones before left, so they meet in one row;
    places beyond the end count as the end; a null `by` is empty; edits of unknown documents do nothing.
    """
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "seq", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.coalesce("by", F.lit("")).alias("by")))).alias("edits"))
    return edit_listed(trees.join(listed, "doc_id", "left"), shared)


def edit_listed(rows: DataFrame, shared) -> DataFrame:
    """The same for trees that carry their sorted edits in a column `edits`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for at, to in groups(pc.binary_length(batch.column(1)).to_pylist(), TOGETHER_BYTES):
                own = batch.slice(at, to - at)
                edits = own.column(4).to_pylist()
                trees = [Tree(c, t) for c, t in zip(lists(own.column(2)), lists(own.column(3)))]
                before = [t.tokens[1] for t in trees]
                texts, encoded = edit_all(own.column(1).to_pylist(), trees, [e or [] for e in edits], encoder)
                yield pa.RecordBatch.from_arrays([
                    own.column(0), pa.array(texts, pa.string()), pa.array([t.chars for t in trees], _SUMS), pa.array([t.tokens for t in trees], _SUMS),
                    *(pa.array(x, pa.int64()) for x in (before, [t.tokens[1] for t in trees], [len(e or []) for e in edits], encoded))],
                    names=["doc_id", "text", "node_chars", "node_tokens", "tokens_before", "tokens_after", "n_edits", "reencoded_chars"])

    return rows.select("doc_id", "text", "node_chars", "node_tokens", "edits").mapInArrow(
        run, TREE + ", tokens_before bigint, tokens_after bigint, n_edits bigint, reencoded_chars bigint")


def sample_edits(text: Column) -> Column:
    """Three edits that a text itself gives: a cut near its middle, a copy of its start near its end, and a new first word."""
    n = F.char_length(text).cast("long")
    edit = lambda s, a, b, by: F.struct(F.lit(s).cast("long").alias("seq"), a.cast("long").alias("start"), b.cast("long").alias("stop"), by.alias("by"))
    return F.array(
        edit(1, F.floor(n / 2), F.floor(n / 2) + 17, F.lit("")),
        edit(2, F.floor(n * 9 / 10), F.floor(n * 9 / 10), F.substring(text, 1, 23)),
        edit(3, F.lit(0), F.lit(0), F.lit("Now ")),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shared = spark.sparkContext.broadcast(build(docs, tokenizer_path()))
    # the stored trees are the state that edits meet
    trees = stored(build_trees(docs, shared), "trees").withColumn("edits", sample_edits(F.col("text")))
    leaves = F.filter(F.slice("node_chars", F.size("node_chars") / 2 + 1, F.size("node_chars") / 2), lambda n: n > 0)
    return edit_listed(trees, shared).select(
        "doc_id", "tokens_before", "tokens_after", "n_edits", "reencoded_chars", F.size(leaves).cast("long").alias("n_leaves"),
        F.sha2("text", 256).alias("edited_sha256"))
