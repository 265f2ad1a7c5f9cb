"""Minimal acyclic transducer from byte strings to sequences of token ids, as one memory-mappable block.

Words are added in byte order. States whose right language and outputs are the same are one state, so suffixes
are shared; outputs are moved as near to the start as the words that share a path allow.
"""

from __future__ import annotations

import mmap
import tempfile
from array import array
from itertools import pairwise

import numpy as np


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # byte: [state or number of a frozen one, output]
        self.final, self.tail = False, ()

    def key(self):
        return (self.final, self.tail, tuple((b, t, o) for b, (t, o) in self.arcs.items()))


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The transducer's block; words may be empty. Layout: five counts, then arrays of 32-bit numbers, then labels."""
    frozen: dict = {}
    states: list[_State] = []

    def freeze(s: _State) -> int:
        n = frozen.setdefault(s.key(), len(states))
        if n == len(states):
            states.append(s)
        return n

    path, before = [_State()], b""

    def close(depth: int) -> None:
        for i in range(len(before), depth, -1):
            path[i - 1].arcs[before[i - 1]][0] = freeze(path[i])
            path.pop()

    for word in sorted(words):
        out = tuple(words[word])
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        close(same)
        for i in range(same):
            arc = path[i].arcs[word[i]]
            keep = _shared(arc[1], out)
            moved = arc[1][keep:]
            if moved:
                arc[1] = arc[1][:keep]
                below = path[i + 1]
                for other in below.arcs.values():
                    other[1] = moved + other[1]
                if below.final:
                    below.tail = moved + below.tail
            out = out[keep:]
        for i in range(same, len(word)):
            path.append(_State())
            path[i].arcs[word[i]] = [None, out]
            out = ()
        path[-1].final = True
        if len(word) == same:
            path[-1].tail = out
        before = word
    close(0)
    root = freeze(path[0])

    pool: dict[tuple, int] = {(): 0}
    def pooled(o: tuple) -> int:
        return pool.setdefault(o, len(pool))

    first, tails, targets, outs, labels = array("I"), array("I"), array("I"), array("I"), bytearray()
    for s in states:
        first.append(len(labels))
        tails.append(pooled(s.tail) + 1 if s.final else 0)
        for b, (t, o) in s.arcs.items():
            labels.append(b)
            targets.append(t)
            outs.append(pooled(o))
    first.append(len(labels))
    starts, flat = array("I"), array("I")
    for o in pool:
        starts.append(len(flat))
        flat.extend(o)
    starts.append(len(flat))
    head = array("I", [root, len(states), len(labels), len(pool), len(flat)])
    return b"".join(x.tobytes() for x in (head, first, tails, targets, outs, starts, flat)) + bytes(labels)


class Lexicon:
    """Look-ups in a block, through a memory map of an unnamed file."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(block)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        head = memoryview(self.map)[:20].cast("I")
        self.root, states, arcs, pool, flat = head
        at, parts = 20, []
        for n in (states + 1, states, arcs, arcs, pool + 1, flat):
            parts.append(np.frombuffer(self.map, np.uint32, n, at))
            at += 4 * n
        first, self.tails, self.targets, self.outs, starts, ids = parts
        # arcs lie in the order of (state, label)
        self.arcs = (np.repeat(np.arange(states, dtype=np.int64), np.diff(first.astype(np.int64))) << 8) | np.frombuffer(self.map, np.uint8, arcs, at)
        raw = ids.tobytes()
        self.pool = [raw[4 * a : 4 * b] for a, b in pairwise(starts.tolist())]

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers; None when the word isn't held."""
        return self.get_all([word])[0]

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """The same for many words, which walk the automaton together, a byte a step."""
        sizes = np.array([len(w) for w in words], np.int64)
        text, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        state, left = np.full(len(words), self.root, np.int64), np.arange(len(words))
        given: list[tuple[np.ndarray, np.ndarray]] = []
        ended: list[np.ndarray] = []
        step = 0
        while len(left):
            over = sizes[left] == step
            ended.append(left[over])
            left = left[~over]
            wanted = (state[left] << 8) | text[begin[left] + step]
            arc = np.searchsorted(self.arcs, wanted)
            held = arc < len(self.arcs)
            held[held] = self.arcs[arc[held]] == wanted[held]
            left, arc = left[held], arc[held]
            state[left] = self.targets[arc]
            some = self.outs[arc] > 0
            given.append((left[some], self.outs[arc][some]))
            step += 1
        found: list[bytes | None] = [None] * len(words)
        whole = np.concatenate([*ended, np.zeros(0, np.int64)])
        tails = self.tails[state[whole]]
        for i in whole[tails > 0].tolist():
            found[i] = b""
        for at, outs in [*given, (whole[tails > 0], tails[tails > 0] - 1)]:
            for i, o in zip(at.tolist(), outs.tolist()):
                if o and found[i] is not None:
                    found[i] += self.pool[o]
        return found
