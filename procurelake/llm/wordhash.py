"""Words of many texts at once, and rolling hashes over them, in numpy.

A word is a maximal run of bytes other than the six ASCII spaces, as ``[^\\x20\\x09-\\x0D]+`` has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Spaces by byte.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Multipliers of the two polynomials over a word's bytes, and of the one over words; each is 5 modulo 8.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
STEP = np.uint64(0xA0761D6478BD642D)
#: Longer words are hashed one at a time.
LONG = 64

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1, at least, of ``base`` and of its inverse modulo 2^64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        if n > 1 << 22:  # what a single very long text needs isn't kept
            return tuple(out)
        held = _powers[base] = tuple(out)
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a column of texts: ``starts`` and ``ends`` in ``data``, ``row`` of each, ``first`` word of each row.

    Null texts have no words.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.data, self.offsets, self.rows = whole[offsets[0] : offsets[-1]], offsets - offsets[0], len(texts)
        n = len(self.data)
        inside = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
        self.inside = inside
        self.starts = np.flatnonzero(inside & (before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        out = (self.ends - self.starts).astype(np.uint64)
        for base in BASES:
            up, down = _power(base, len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
            out = mix(out + (sums[self.ends] - sums[self.starts]) * down[self.starts])
        for i in np.flatnonzero(self.ends - self.starts > LONG):  # powers of one base say little about very long words
            import xxhash

            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return out

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The words that ``keep`` marks, each with one space after it, and where each word begins (and the end)."""
        length = self.ends - self.starts
        flags = np.zeros(len(self.data) + 1, np.int64)
        flags[self.starts] = 1
        word = np.cumsum(flags[:-1])[self.inside] - 1
        taken = self.data[self.inside]
        if keep is not None:
            chosen = keep[word]
            taken, word, length = taken[chosen], (np.cumsum(keep) - 1)[word[chosen]], length[keep]
        begins = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(begins[-1], 32, np.uint8)
        out[np.arange(len(taken)) + word] = taken
        return out, begins


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """64 bits of each ``width`` consecutive words, whatever rows they are of."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * STEP + hashes[i : i + n]
    return mix(out)
