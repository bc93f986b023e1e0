"""A minimal acyclic transducer from words to numbers, in flat arrays that can be mapped into memory."""

from __future__ import annotations

import mmap
import struct
from array import array
from collections.abc import Iterable


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The automaton of the words with their ids, as one block of bytes.

    Words are added in sorted order; a state whose words are complete is replaced by an equal
    one that exists, so suffixes are shared. An edge's output is the number of words that sort
    before those behind it at its state, so the outputs along a word sum to its rank, which
    leads to its ids. Takes time and memory in proportion to the words, which are bounded.
    """
    table = sorted(dict(entries).items())
    states: list[tuple[bool, list[tuple[int, int]]]] = []
    known: dict[tuple, int] = {}

    def freeze(node: list) -> int:
        final, edges = node
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(states)
            states.append((final, list(edges)))
        return known[key]

    path: list[list] = [[False, []]]  # nodes along the last word, root first
    last = b""
    for word, _ in table:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
    root = freeze(path[0])

    behind = [0] * len(states)  # words from a state on; targets come before their sources
    first, finals, labels, targets, outputs = array("I", [0]), bytearray(), bytearray(), array("I"), array("I")
    for i, (final, edges) in enumerate(states):
        n = int(final)
        for label, to in edges:
            labels.append(label)
            targets.append(to)
            outputs.append(n)
            n += behind[to]
        behind[i] = n
        finals.append(final)
        first.append(len(labels))
    ids, starts = array("I"), array("I", [0])
    for _, out in table:
        ids.extend(out)
        starts.append(len(ids))
    parts = [first.tobytes(), targets.tobytes(), outputs.tobytes(), starts.tobytes(), ids.tobytes(), bytes(finals), bytes(labels)]
    return struct.pack("<8Q", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """Look-up in a compiled lexicon that is mapped from a file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self._root, *sizes = struct.unpack_from("<8Q", self._map)
        view, at, parts = memoryview(self._map), 64, []
        for n in sizes:
            parts.append(view[at : at + n])
            at += n
        self._first, self._targets, self._outputs, self._starts, self._ids = (p.cast("I") for p in parts[:5])
        self._finals = parts[5]
        self._labels = at - sizes[6]

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian 32-bit integers; None if the lexicon hasn't the word."""
        state, rank, first, find, base = self._root, 0, self._first, self._map.find, self._labels
        for i in range(len(word)):
            edge = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if edge < 0:
                return None
            rank += self._outputs[edge - base]
            state = self._targets[edge - base]
        if not self._finals[state]:
            return None
        return self._ids[self._starts[rank] : self._starts[rank + 1]].tobytes()
