"""A Bloom filter for set membership outside of joins; Spark plans its own for joins."""

from __future__ import annotations

import math

#: The FNV-1a parameters, and what sets the second hash apart.
OFFSET, PRIME, SALT = 14695981039346656037, 1099511628211, "9e3779b9"


def _fnv(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


class Bloom:
    """Sized for n items at false-positive rate p: no false negatives, at least 64 bits, 1 to 30 hashes."""

    def __init__(self, n: int, p: float):
        self.bits, self.hashes = self.sizes(n, p)
        self.array, self.count = bytearray(self.bits // 8), 0

    @staticmethod
    def sizes(n: int, p: float) -> tuple[int, int]:
        """Bits and hashes for n items at rate p."""
        if n <= 0 or not 0 < p < 1:
            raise ValueError("a filter needs n > 0 and 0 < p < 1")
        bits = -(-max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2)) // 64) * 64
        return bits, min(30, max(1, round(bits / n * math.log(2))))

    def _places(self, item: str):
        data = item.encode()
        a, b = _fnv(data), _fnv(bytes.fromhex(SALT) + data) or 1
        return ((a + i * b) % 2**64 % self.bits for i in range(self.hashes))

    def add(self, item: str) -> None:
        for k in self._places(item):
            self.array[k >> 3] |= 1 << (k & 7)
        self.count += 1

    def __contains__(self, item: str) -> bool:
        return all(self.array[k >> 3] >> (k & 7) & 1 for k in self._places(item))

    def __len__(self) -> int:
        return self.count

    @property
    def memory_bytes(self) -> int:
        return len(self.array)
