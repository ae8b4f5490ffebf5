"""A chain of cuckoo filters: membership with deletions, in two bytes a slot."""

from __future__ import annotations

import struct

SLOTS = 4
KICKS = 200


class CuckooFilter:
    """Holds 16-bit fingerprints of byte keys. A full table gets a fresh one behind it, so inserting never fails.

    A key that was inserted is always found; one that was not is found by chance about once in 8,000 times.
    """

    def __init__(self, buckets: int = 1024, tables: list[list[int]] | None = None):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.tables = tables or [[0] * (self.buckets * SLOTS)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:8], "little")
        mark = (h >> 48) or 1
        a = h & (self.buckets - 1)
        return mark, a, a ^ self._turn(mark)

    def _turn(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def add(self, key: bytes) -> None:
        mark, a, b = self._places(key)
        for n, t in enumerate(self.tables):
            for at in (a, b):
                for k in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not t[k]:
                        t[k] = mark
                        return
            if n == len(self.tables) - 1 and (mark := self._kick(t, mark, a)):
                a = self._last  # the mark that found no place goes to the next table
                b = a ^ self._turn(mark)
            elif n == len(self.tables) - 1:
                return
        self.tables.append([0] * (self.buckets * SLOTS))
        self.tables[-1][a * SLOTS] = mark

    def _kick(self, t: list[int], mark: int, at: int) -> int:
        """Moves marks to their other places; 0 when all have one, or the mark left over, whose place is then in _last."""
        for n in range(KICKS):
            k = at * SLOTS + (n + mark) % SLOTS
            t[k], mark = mark, t[k]
            at ^= self._turn(mark)
            for j in range(at * SLOTS, at * SLOTS + SLOTS):
                if not t[j]:
                    t[j] = mark
                    return 0
        self._last = at
        return mark

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return any(mark in t[a * SLOTS : a * SLOTS + SLOTS] or mark in t[b * SLOTS : b * SLOTS + SLOTS] for t in self.tables)

    def remove(self, key: bytes) -> bool:
        """Takes out one mark of a key; only keys that were inserted may be removed."""
        mark, a, b = self._places(key)
        for t in reversed(self.tables):
            for at in (a, b):
                for k in range(at * SLOTS, at * SLOTS + SLOTS):
                    if t[k] == mark:
                        t[k] = 0
                        return True
        return False

    def dump(self) -> bytes:
        n = self.buckets * SLOTS
        return struct.pack("<II", self.buckets, len(self.tables)) + b"".join(struct.pack(f"<{n}H", *t) for t in self.tables)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        buckets, many = struct.unpack_from("<II", data)
        n = buckets * SLOTS
        return cls(buckets, [list(struct.unpack_from(f"<{n}H", data, 8 + 2 * n * i)) for i in range(many)])
