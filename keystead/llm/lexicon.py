"""A minimal acyclic transducer from words to token ids, read from a memory map.

Words go in sorted order, so equal suffixes are shared as they are completed.  Each
arc carries the number of words that precede its own; their sum along a word is the
word's place, and the places lead to the stored ids.  Lookups walk all asked words
together, one byte a step.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

HEAD = struct.Struct("<QQQQ")


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of words and their ids as one block of bytes."""
    words = sorted(w for w in entries if w)
    arcs: list[dict[int, int]] = [{}]  # by open state of the current word
    final = [False]
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}

    def close(depth: int, word: bytes) -> None:
        """Fix the states of the last word below depth; equal ones are one state."""
        while len(arcs) - 1 > depth:
            state = (final.pop(), tuple(sorted(arcs.pop().items())))
            if state not in known:
                known[state] = len(states)
                states.append(state)
            arcs[-1][word[len(arcs) - 1]] = known[state]

    last = b""
    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same, last)
        for _ in word[same:]:
            arcs.append({})
            final.append(False)
        final[-1] = True
        last = word
    close(0, last)
    root = len(states)
    states.append((final[0], tuple(sorted(arcs[0].items()))))

    sizes = np.zeros(len(states), dtype=np.int64)  # words that a state accepts
    keys, targets, skips = [], [], []
    for number, (ends, out) in enumerate(states):  # targets come before their sources
        total = int(ends)
        for label, target in out:
            keys.append(number << 8 | label)
            targets.append(target)
            skips.append(total)
            total += int(sizes[target])
        sizes[number] = total
    offsets = np.cumsum([0] + [len(entries[w]) for w in words])
    ids = [i for w in words for i in entries[w]]
    return b"".join((
        HEAD.pack(len(keys), len(states), len(words), root),
        np.array(keys, "<i8").tobytes(), np.array(targets, "<i4").tobytes(), np.array(skips, "<i4").tobytes(),
        np.array(offsets, "<i4").tobytes(), np.array(ids, "<i4").tobytes(), np.array([s[0] for s in states], np.uint8).tobytes(),
    ))


class Lexicon:
    """A compiled transducer, mapped from a file without a name: it goes when the process ends."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        n_arcs, n_states, n_words, self.root = HEAD.unpack_from(self.map)
        at = HEAD.size
        parts = []
        for kind, n in (("<i8", n_arcs), ("<i4", n_arcs), ("<i4", n_arcs), ("<i4", n_words + 1)):
            parts.append(np.frombuffer(self.map, kind, n, at))
            at += parts[-1].nbytes
        self.keys, self.targets, self.skips, self.offsets = parts
        self.ids = np.frombuffer(self.map, "<i4", int(self.offsets[-1]) if n_words else 0, at)
        self.final = np.frombuffer(self.map, np.uint8, n_states, at + self.ids.nbytes).astype(bool)
        self.longest = 64  # no word beyond this length is compiled, see bpe

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, or -1."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        place, state = np.zeros(n, dtype=np.int64), np.full(n, self.root, dtype=np.int64)
        alive = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        state[lengths == 0] = -1
        state[lengths > self.longest] = -1
        if len(self.keys) == 0:
            return np.full(n, -1)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        step = 0
        while len(alive):
            key = state[alive] << 8 | flat[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            state[alive[~ok]] = -1
            alive, arc = alive[ok], arc[ok]
            place[alive] += self.skips[arc]
            state[alive] = self.targets[arc]
            step += 1
            alive = alive[lengths[alive] > step]
        found = (state >= 0) & self.final[np.maximum(state, 0)]
        return np.where(found, place, -1)

    def ids_at(self, place: int) -> np.ndarray:
        return self.ids[self.offsets[place] : self.offsets[place + 1]]
