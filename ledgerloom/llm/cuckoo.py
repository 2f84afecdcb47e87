"""A cuckoo filter over keys of two 64-bit halves: insertion, deletion, and tests of many keys at once."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 200
MIX = 0x9E3779B1


def prints(high: np.ndarray) -> np.ndarray:
    """Fingerprints of 16 bits, never zero, which marks a free slot."""
    return (high.view(np.uint64) % np.uint64(65535)).astype(np.int64) + 1


class CuckooFilter:
    """Each key's fingerprint is in one of two buckets, which follow from each other and the fingerprint.

    A key that finds no place after many moves is kept in ``stash``, so nothing is ever lost.
    """

    def __init__(self, buckets: int, slots: bytes = b"", stash: bytes = b""):
        self.buckets = buckets
        self.slots = np.frombuffer(slots, np.uint16).reshape(buckets, SLOTS).copy() if slots else np.zeros((buckets, SLOTS), np.uint16)
        self.stash = list(map(tuple, np.frombuffer(stash, np.int64).reshape(-1, 2).tolist()))  # (fingerprint, first bucket)

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> CuckooFilter:
        """A filter with the keys, and room for as many again."""
        own = cls(1 << max(4, (2 * len(high) // SLOTS).bit_length()))
        own.insert(high, low)
        return own

    def packed(self) -> tuple[int, bytes, bytes]:
        return self.buckets, self.slots.tobytes(), np.array(self.stash, np.int64).tobytes()

    def _other(self, bucket, mark):
        return bucket ^ (mark * MIX & (self.buckets - 1))

    def _places(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return prints(high), low & (self.buckets - 1)

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        """Each key must not be in the filter yet."""
        for mark, bucket in zip(*(a.tolist() for a in self._places(high, low)), strict=True):
            if not self._put(mark, bucket) and not self._put(mark, self._other(bucket, mark)):
                self._move(mark, bucket)

    def _put(self, mark: int, bucket: int) -> bool:
        row = self.slots[bucket]
        for s in range(SLOTS):
            if not row[s]:
                row[s] = mark
                return True
        return False

    def _move(self, mark: int, bucket: int) -> None:
        for step in range(KICKS):
            s = step % SLOTS
            out = int(self.slots[bucket, s])
            self.slots[bucket, s] = mark
            mark, bucket = out, self._other(bucket, out)
            if self._put(mark, bucket):
                return
        self.stash.append((mark, bucket))

    def remove(self, high: np.ndarray, low: np.ndarray) -> None:
        """Each key must be in the filter: only then is the fingerprint that goes its own or an equal one."""
        for mark, bucket in zip(*(a.tolist() for a in self._places(high, low)), strict=True):
            for b in (bucket, self._other(bucket, mark)):
                at = np.flatnonzero(self.slots[b] == mark)
                if len(at):
                    self.slots[b, at[0]] = 0
                    break
            else:
                self.stash.remove(next(x for x in self.stash if x[0] == mark and x[1] in (bucket, self._other(bucket, mark))))

    def holds(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether each key may be in the filter; true for all that are."""
        mark, bucket = self._places(high, low)
        found = (self.slots[bucket] == mark[:, None]).any(1) | (self.slots[self._other(bucket, mark)] == mark[:, None]).any(1)
        for m, b in self.stash:
            found |= (mark == m) & ((bucket == b) | (bucket == self._other(b, m)))
        return found
