"""Fill-in-middle transformation over piece tables (operator 13).

A document is a list of descriptors over two immutable buffers, its text and the sentinels. Cutting splits descriptors,
an arrangement permutes them, the inverse permutation restores the text, and hashes read the descriptors one by one;
text is copied only once, when an output is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.bpe import Batches, groups
from turnlake.llm.common import documents, whole_text
from turnlake.llm.words import _WHITE

#: Marks of prefix, suffix and middle, all of one length.
SENTINELS = (b"<P>", b"<S>", b"<M>")
SEED, RATE, SPM_RATE = "42", 50, 80
#: Slots of a table that was cut: prefix, middle, suffix, and their marks <P>, <S>, <M>; each form is an order of them.
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)
ORDERS = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}
#: Bytes of text whose outputs are held at once; a longer text is handled alone.
TOGETHER_BYTES = 8 << 20


class PieceTable:
    """Descriptors (buffer, start, end) over immutable buffers, in bytes."""

    def __init__(self, buffers: tuple[memoryview, ...], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: memoryview) -> PieceTable:
        return cls((text, memoryview(b"".join(SENTINELS))), [(0, 0, len(text))])

    def cut(self, places: list[int]) -> PieceTable:
        """Splits at ascending offsets; every place gives one more descriptor, of length 0 where two places meet."""
        out, at, rest = [], 0, list(places)
        for buffer, start, end in self.pieces:
            while rest and rest[0] - at <= end - start:
                here = start + rest.pop(0) - at
                out.append((buffer, start, here))
                at, start = at + here - start, here
            out.append((buffer, start, end))
            at += end - start
        return PieceTable(self.buffers, out)

    def marked(self) -> PieceTable:
        """With a descriptor of each sentinel behind the others."""
        size = len(SENTINELS[0])
        return PieceTable(self.buffers, self.pieces + [(1, size * i, size * (i + 1)) for i in range(3)])

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def restored(self, order: tuple[int, ...]) -> PieceTable:
        """Undoes arranged(order)."""
        back = [order.index(i) for i in range(len(order))]
        return self.arranged(tuple(back))

    def parts(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield self.buffers[buffer][start:end]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.parts():
            h.update(part)
        return h.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.parts())


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which units end: white space before a word belongs to it, white space at the end is one more."""
    if not len(raw):
        return np.zeros(0, np.int64)
    white = _WHITE[raw]
    return np.append(np.flatnonzero(~white[:-1] & white[1:]) + 1, len(raw))


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits from the seed and the id; no id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def _arranging(seed: str, rate: int, spm_rate: int):
    kind = pa.list_(pa.struct([("buffer", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def one(doc_id, text: pa.Buffer | None):
        raw = np.frombuffer(text, np.uint8) if text is not None and text.size else np.zeros(0, np.uint8)
        table = PieceTable.of(memoryview(raw))
        ends, whole = unit_ends(raw), raw.tobytes()
        h1, h2, h3, h4 = draws(doc_id, seed)
        n = len(ends)
        if not n or h3 % 100 >= rate or any(s in whole for s in SENTINELS):
            return n, "plain", None, None, table
        places = [int(ends[u - 1]) if u else 0 for u in sorted((h1 % (n + 1), h2 % (n + 1)))]
        form = "spm" if h4 % 100 < spm_rate else "psm"
        return n, form, code_points(raw[: places[0]]), code_points(raw[places[0] : places[1]]), table.cut(places).marked().arranged(ORDERS[form])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, to in groups(pc.binary_length(texts).to_pylist(), TOGETHER_BYTES):
                rows = [one(ids[i].as_py(), texts[i].as_buffer()) for i in range(at, to)]
                pieces = [[{"buffer": ("text", "marks")[b], "start": s, "length": e - s} for b, s, e in r[4].pieces] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array(pieces, kind),
                     pa.array([r[4].bytes() for r in rows], pa.binary()).view(pa.string()), pa.array([r[4].sha256() for r in rows], pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"])

    return run


def rebuilt(form: str, output: memoryview) -> PieceTable:
    """The text of an output: its marks are found, the output is cut there and the arrangement is undone."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    raw, places, at = bytes(output), [], 0
    for slot in ORDERS[form][0::2]:
        mark = SENTINELS[slot - P]
        at = raw.index(mark, at)
        places += [at, at + len(mark)]
        at += len(mark)
    # the first place is 0, so the descriptor before it is empty
    slots = PieceTable(table.buffers, table.cut(places).pieces[1:]).restored(ORDERS[form])
    return PieceTable(slots.buffers, slots.pieces[: SUFFIX + 1])


def _restoring(batches: Batches) -> Batches:
    for batch in batches:
        forms, outputs = batch.column("form"), batch.column("output")
        for at, to in groups(pc.binary_length(outputs).to_pylist(), TOGETHER_BYTES):
            tables = [rebuilt(forms[i].as_py(), memoryview(outputs[i].as_buffer())) for i in range(at, to)]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(at, to - at) for c in batch.columns), pa.array([t.bytes() for t in tables], pa.binary()).view(pa.string()),
                 pa.array([t.sha256() for t in tables], pa.string())],
                names=[*batch.schema.names, "restored", "restored_sha256"])


ARRANGED = ("doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
            "pieces array<struct<buffer: string, start: bigint, length: bigint>>, output string, output_sha256 string")
RESTORED = ARRANGED + ", restored string, restored_sha256 string"


def fill_middle(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256 for each row of `docs` (doc_id, text).

    `pieces` are the descriptors, in bytes, of the output over the text and the marks `<P><S><M>`. A null text is
    empty; empty texts and texts that hold a mark stay as they are (plain, one descriptor). A null doc_id draws as an
    empty one; repeated rows give equal rows; other columns are ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(_arranging(seed, rate, spm_rate), ARRANGED)


def restore(arranged: DataFrame) -> DataFrame:
    """The rows of fill_middle() with the text read back from form and output alone: restored, restored_sha256."""
    return arranged.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256").mapInArrow(_restoring, RESTORED)


def transform_and_restore(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """restore(fill_middle(docs)); one worker does both."""
    first = _arranging(seed, rate, spm_rate)
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(lambda batches: _restoring(first(batches)), RESTORED)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_and_restore(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (
  SELECT *, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p,
         coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
