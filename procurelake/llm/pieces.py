"""Ids of pre-tokens, looked up for a whole block at once.

A pre-token of up to ``KEY_BYTES`` bytes is its own key, as 64-bit words and a length, so a match is exact.  Keys, places
and ids lie in flat arrays with an open-addressing index, which numpy probes for all pre-tokens of a block together; only
those that are missing are worked out one by one.  Longer pre-tokens are worked out each time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

IDS = np.dtype("<u4")
#: Entries that are kept (about 55 MB with their ids), and the longest pre-token among them in bytes.
CACHE_PIECES, KEY_BYTES = 1 << 20, 24
#: Odd 64-bit factors; their values are free.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: The low bytes of a word that 0 to 8 bytes fill.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class PieceTable:
    """A bounded cache of ids by pre-token; ``ids_of`` works out those of a missing one."""

    def __init__(self, ids_of: Callable[[bytes], list[int]], most: int | None = None):
        self.ids_of, self.most = ids_of, most or CACHE_PIECES
        self.bits = max(4, (2 * self.most - 1).bit_length())
        self._clear(1 << 12)

    def _clear(self, room: int) -> None:
        room = min(room, self.most)
        self.n = self.used = 0
        self.keys = np.zeros((3, room), np.uint64)
        self.lengths, self.counts, self.met = np.zeros(room, np.uint8), np.zeros(room, np.uint8), np.zeros(room, bool)
        self.firsts = np.zeros(room, np.int32)
        self.flat = np.zeros(4 * room, IDS)
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def _home(self, keys: list[np.ndarray] | np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h = lengths.astype(np.uint64) * FACTORS[3]
        for k, factor in zip(keys, FACTORS, strict=False):
            h += k * factor
        h ^= h >> np.uint64(31)
        h *= FACTORS[1]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(lengths), -1, np.int32)
        todo, slot, last = np.arange(len(lengths)), self._home(keys, lengths), len(self.slots) - 1
        while len(todo):
            entry = self.slots[slot]
            there = entry >= 0
            same = there & (self.lengths[entry] == lengths[todo])
            for mine, theirs in zip(self.keys, keys, strict=True):
                same &= mine[entry] == theirs[todo]
            out[todo[same]] = entry[same]
            on = there & ~same
            todo, slot = todo[on], slot[on] + 1 & last
        return out

    def _index(self, entries: np.ndarray) -> None:
        """Give entries with different keys their slots."""
        slot, last = self._home(self.keys[:, entries], self.lengths[entries]), len(self.slots) - 1
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]  # of two for one slot the last stays
            lost = self.slots[slot] != entries
            entries, slot = entries[lost], slot[lost] + 1 & last

    def _grow(self, entries: int, ids: int) -> None:
        """Make room for entries and ids in the arrays."""
        if entries > len(self.lengths):
            more = min(max(entries, 2 * len(self.lengths)), self.most) - len(self.lengths)
            self.keys = np.pad(self.keys, ((0, 0), (0, more)))
            self.lengths, self.counts, self.met, self.firsts = (np.pad(x, (0, more)) for x in (self.lengths, self.counts, self.met, self.firsts))
        if ids > len(self.flat):
            self.flat = np.pad(self.flat, (0, max(ids, 2 * len(self.flat)) - len(self.flat)))

    def _forget(self) -> None:
        """Keep of the entries only those that were met again, half of the room at most, the oldest first."""
        kept = np.flatnonzero(self.met[: self.n])[: self.most // 2]
        keys, lengths, counts, ids = self.keys[:, kept], self.lengths[kept], self.counts[kept], self._gather(self.firsts[kept], self.counts[kept])
        self._clear(len(self.lengths))
        self._grow(len(kept), len(ids))
        self.n, self.used = len(kept), len(ids)
        self.keys[:, : self.n], self.lengths[: self.n], self.counts[: self.n], self.flat[: self.used] = keys, lengths, counts, ids
        self.firsts[: self.n] = np.cumsum(counts, dtype=np.int64) - counts
        self._index(np.arange(self.n, dtype=np.int32))

    def _gather(self, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of entries, one after the other."""
        counts = counts.astype(np.int64)
        ends = np.cumsum(counts)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - counts), counts)]

    def encode(self, raw: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens of ``raw`` between ``cuts`` (first, ..., end), and how many each has."""
        if self.n > self.most * 3 // 4:
            self._forget()
        starts, lengths = cuts[:-1], np.diff(cuts)
        words = np.ndarray(len(raw) + 17, "<u8", raw + bytes(24), strides=(1,))
        short = lengths <= KEY_BYTES
        keys = [words[np.minimum(starts + k, len(raw))] & MASKS[np.clip(lengths - k, 0, 8)] for k in (0, 8, 16)]
        found = self._find(keys, np.where(short, lengths, 255).astype(np.uint8))
        self.met[found[found >= 0]] = True
        firsts, counts = self.firsts[found].astype(np.int64), self.counts[found].astype(np.int64)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return self._gather(firsts, counts), counts
        number: dict[bytes, int] = {}
        kind = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts[missing].tolist(), cuts[missing + 1].tolist(), strict=True)])
        new = [self.ids_of(piece) for piece in number]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        place = missing[np.unique(kind, return_index=True)[1]]  # of each different one
        stays = short[place]
        stays &= np.cumsum(stays) <= self.most - self.n
        order = np.argsort(~stays, kind="stable")  # those that stay come first; the others' ids are overwritten by the next
        kept = order[: int(stays.sum())]
        many = np.fromiter((i for k in order.tolist() for i in new[k]), IDS)
        self._grow(self.n + len(kept), self.used + len(many))
        self.flat[self.used : self.used + len(many)] = many
        at = np.zeros(len(new), np.int64)
        at[order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        firsts[missing], counts[missing] = at[kind], sizes[kind]
        entries = np.arange(self.n, self.n + len(kept), dtype=np.int32)
        for mine, theirs in zip(self.keys, keys, strict=True):
            mine[entries] = theirs[place[kept]]
        self.lengths[entries], self.counts[entries], self.firsts[entries], self.met[entries] = lengths[place[kept]], sizes[kept], at[kept], False
        self._index(entries)
        self.n, self.used = self.n + len(kept), self.used + int(sizes[kept].sum())
        return self._gather(firsts, counts), counts
