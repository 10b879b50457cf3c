"""A minimal acyclic transducer from sorted byte strings to their lexicographic ordinals.

Built one term after the other: what two neighbours share stays open, all behind it is closed and
replaced by an equal state that exists already. An edge puts out how many terms leave its state before
it, so the outputs along a term's path add up to its ordinal. Texts stream through it in numpy: all
words of a buffer take their next byte at the same time, and a word that has no edge drops out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Spreads edge keys over the hash table (2^64 divided by the golden ratio).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Builder:
    """Takes terms in strictly rising order."""

    def __init__(self):
        self.states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        self.known: dict[tuple, int] = {}
        # The open path: for each state whether a term ends there, and its closed edges.
        self.final, self.edges, self.last = [False], [[]], b""

    def add(self, term: bytes) -> None:
        if self.size and term <= self.last:
            raise ValueError(f"terms must rise: {term!r} after {self.last!r}")
        shared = 0
        for x, y in zip(term, self.last, strict=False):
            if x != y:
                break
            shared += 1
        self._close(shared)
        for _ in term[shared:]:
            self.final.append(False)
            self.edges.append([])
        self.final[-1] = True
        self.last = term

    @property
    def size(self) -> int:
        """Open or closed states besides the root: 0 before the first term that isn't empty."""
        return len(self.states) + len(self.final) - 1 + self.final[0]

    def _state(self) -> int:
        key = (self.final.pop(), tuple(self.edges.pop()))
        found = self.known.setdefault(key, len(self.states))
        if found == len(self.states):
            self.states.append(key)
        return found

    def _close(self, depth: int) -> None:
        while len(self.final) > depth + 1:
            byte = self.last[len(self.final) - 2]
            self.edges[-2].append((byte, self._state()))

    def done(self) -> Transducer:
        self._close(0)
        root = self._state()
        words: list[int] = []
        edges = []
        for state, (final, out) in enumerate(self.states):
            n = int(final)
            for byte, target in out:
                edges.append((state, byte, target, n))
                n += words[target]
            words.append(n)
        table = np.array(edges, np.int64).reshape(-1, 4)
        return Transducer(root, words[root], np.array([f for f, _ in self.states], np.bool_), table)


def build(terms: Iterable[bytes]) -> Transducer:
    builder = Builder()
    for t in terms:
        builder.add(t)
    return builder.done()


class Transducer:
    """``edges``: (state, byte, target, output) by state and byte."""

    def __init__(self, root: int, size: int, final: np.ndarray, edges: np.ndarray):
        self.root, self.size, self.final, self.edges = root, size, final, edges
        bits = max(int(2 * len(edges) - 1).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _NONE)
        self.target, self.out = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        keys = edges[:, 0].astype(np.uint64) << np.uint64(8) | edges[:, 1].astype(np.uint64)
        left, slot = np.arange(len(edges)), (keys * _SPREAD) >> self.shift
        while len(left):
            # Of the edges that want one free slot, one gets it; the others go on to the next slot.
            free = self.keys[slot[left]] == _NONE
            self.keys[slot[left[free]]] = keys[left[free]]
            placed = self.keys[slot[left]] == keys[left]
            at = slot[left[placed]]
            self.target[at], self.out[at] = edges[left[placed], 2], edges[left[placed], 3]
            left = left[~placed]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def dump(self) -> bytes:
        head = np.array([self.root, self.size, len(self.final), len(self.edges)], "<i8")
        return head.tobytes() + np.packbits(self.final).tobytes() + self.edges.astype("<i4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        root, size, states, edges = np.frombuffer(data, "<i8", 4).tolist()
        ends = 32 + (states + 7) // 8
        final = np.unpackbits(np.frombuffer(data, np.uint8, ends - 32, 32), count=states).astype(np.bool_)
        return cls(root, size, final, np.frombuffer(data, "<i4", 4 * edges, ends).reshape(-1, 4).astype(np.int64))

    def ordinals(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The ordinal of each word ``data[start : start + length]``, -1 for one that is no term."""
        found, out = np.full(len(start), -1, np.int64), np.zeros(len(start), np.int64)
        state, alive, depth = np.full(len(start), self.root, np.uint64), np.arange(len(start)), 0
        while len(alive):
            ends = length[alive] == depth
            if ends.any():
                whole = alive[ends]
                whole = whole[self.final[state[whole].astype(np.int64)]]
                found[whole] = out[whole]
                alive = alive[~ends]
            key = state[alive] << np.uint64(8) | data[start[alive] + depth].astype(np.uint64)
            slot = (key * _SPREAD) >> self.shift
            seen = self.keys[slot]
            left = np.flatnonzero((seen != key) & (seen != _NONE))
            while len(left):
                slot[left] = (slot[left] + np.uint64(1)) & self.mask
                seen[left] = self.keys[slot[left]]
                left = left[(seen[left] != key[left]) & (seen[left] != _NONE)]
            hit = seen == key
            alive, slot = alive[hit], slot[hit]
            state[alive] = self.target[slot].astype(np.uint64)
            out[alive] += self.out[slot]
            depth += 1
        return found

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal: at each state the last edge whose output it reaches."""
        if not 0 <= ordinal < self.size:
            raise IndexError(ordinal)
        state, out = self.root, bytearray()
        while ordinal or not self.final[state]:
            a, b = np.searchsorted(self.edges[:, 0], [state, state + 1])
            k = a + int(np.searchsorted(self.edges[a:b, 3], ordinal, "right")) - 1
            ordinal -= int(self.edges[k, 3])
            out.append(int(self.edges[k, 1]))
            state = int(self.edges[k, 2])
        return bytes(out)

    def __iter__(self) -> Iterator[bytes]:
        return map(self.term, range(self.size))
