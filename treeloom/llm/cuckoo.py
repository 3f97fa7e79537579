"""A cuckoo filter over 128-bit keys, filled in bulk with numpy.

Each key has a 16-bit fingerprint and two buckets of four slots; either bucket
follows from the other and the fingerprint, so entries can be moved and
deleted. A key that was inserted is always found; one that wasn't is found with
a chance of about 8 / 65536. Each key must be inserted once, and only what was
inserted may be deleted.
"""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
#: Share of slots that may be filled before a larger table is needed.
LOAD = 0.85


class Full(Exception):
    """The table has no room for the keys; a larger one must be built."""


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """16-byte keys as two unsigned numbers each."""
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class CuckooFilter:
    def __init__(self, capacity: int, table: np.ndarray | None = None) -> None:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / LOAD / SLOTS))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @property
    def capacity(self) -> int:
        return int(self.table.size * LOAD)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _place(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = halves(keys)
        prints = (high & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (low & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        prints, first, second = self._place(keys)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, keys: list[bytes]) -> None:
        """Adds the keys; raises :class:`Full`, and then the filter must be rebuilt."""
        if not keys:
            return
        if len(self) + len(keys) > self.capacity:
            raise Full
        prints, first, second = self._place(keys)
        left = self._fill(np.arange(len(keys)), first, prints)
        left = self._fill(left, second, prints)
        rng = np.random.default_rng(len(keys))
        for i in left:
            self._push(int(prints[i]), int(first[i]), rng)

    def _fill(self, items: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Puts items into free slots of their buckets; returns those left over."""
        order = items[np.argsort(bucket[items], kind="stable")]
        at = bucket[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        nth = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
        free = np.argsort(self.table[at] != 0, axis=1, kind="stable")  # free slots first
        room = (self.table[at] == 0).sum(1)
        fits = nth < room
        self.table[at[fits], free[fits, nth[fits]]] = prints[order[fits]]
        return order[~fits]

    def _push(self, print_: int, bucket: int, rng: np.random.Generator) -> None:
        for _ in range(500):
            row = self.table[bucket]
            empty = np.flatnonzero(row == 0)
            if len(empty):
                row[empty[0]] = print_
                return
            slot = int(rng.integers(SLOTS))
            print_, row[slot] = int(row[slot]), print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], np.uint16))[0])
        raise Full

    def delete(self, keys: list[bytes]) -> None:
        if not keys:
            return
        prints, first, second = self._place(keys)
        for p, a, b in zip(prints, first, second, strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == p)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
            else:
                raise KeyError("a key that wasn't inserted can't be deleted")

    def to_bytes(self) -> bytes:
        return struct.pack("<q", len(self.table)) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        (buckets,) = struct.unpack_from("<q", data)
        return cls(0, np.frombuffer(data, np.uint16, offset=8).reshape(buckets, SLOTS).copy())
