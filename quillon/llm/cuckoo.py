"""A cuckoo filter over 64-bit hashes with bulk insertion, lookup and deletion in numpy."""

from __future__ import annotations

import numpy as np

from quillon.llm.bytetext import U, mix

SLOTS = 4


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return ((mix(h) >> U(48)) | U(1)).astype(np.uint16)


def _other(bucket: np.ndarray, fp: np.ndarray, mask: int) -> np.ndarray:
    return bucket ^ (mix(fp.astype(U)) & U(mask)).astype(np.int64)


class Cuckoo:
    """Each item is one 16-bit fingerprint in one of two buckets of four; equal items may be held several times."""

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def sized(items: int, load: float = 0.6) -> Cuckoo:
        return Cuckoo(1 << max(4, int(np.ceil(np.log2(max(1, items) / load / SLOTS)))))

    @staticmethod
    def from_bytes(blob: bytes) -> Cuckoo:
        out = Cuckoo(1)
        out.table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp, mask = _fingerprint(h), len(self.table) - 1
        first = (h & U(mask)).astype(np.int64)
        return fp, first, _other(first, fp, mask)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(h)
        return (self.table[a] == fp[:, None]).any(axis=1) | (self.table[b] == fp[:, None]).any(axis=1)

    def _fill(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Puts what fits in the buckets; true where it did."""
        order = np.argsort(bucket, kind="stable")
        b, f = bucket[order], fp[order]
        new = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
        free = self.table[b] == 0
        at = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
        fits = at.any(axis=1)
        self.table[b[fits], at[fits].argmax(axis=1)] = f[fits]
        done = np.zeros(len(b), bool)
        done[order] = fits
        return done

    def insert(self, h: np.ndarray, kicks: int = 500) -> bool:
        """False if it is too full; the filter must then be rebuilt larger."""
        fp, a, b = self._places(h)
        left = np.flatnonzero(~self._fill(a, fp))
        left = left[~self._fill(b[left], fp[left])]
        mask = len(self.table) - 1
        for i in left:
            f, at, turn = fp[i], int(b[i]), int(i)
            for _ in range(kicks):
                turn = (turn * 1103515245 + 12345) & 0x7FFFFFFF
                slot = (turn >> 16) % SLOTS
                f, self.table[at, slot] = self.table[at, slot], f
                at = int(_other(np.array([at]), np.array([f], np.uint16), mask)[0])
                empty = np.flatnonzero(self.table[at] == 0)
                if len(empty):
                    self.table[at, empty[0]] = f
                    break
            else:
                return False
        return True

    def delete(self, h: np.ndarray) -> None:
        """Removes one copy of each item; only for items that were inserted."""
        fp, a, b = self._places(h)
        for f, x, y in zip(fp, a, b):
            for at in (x, y):
                slot = np.flatnonzero(self.table[at] == f)
                if len(slot):
                    self.table[at, slot[0]] = 0
                    break
