"""Numbers from hashes of keys, for kernels that need chance in order: the same wherever and whenever they run."""

from __future__ import annotations

import hashlib

import numpy as np


def seeded(*key: object) -> np.random.Generator:
    """NumPy's generator for what takes many draws at once, seeded by the hash of a key."""
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(":".join(map(str, key)).encode(), digest_size=16).digest(), "little"))


def drawn(key: str, n: int, block: int = 0) -> np.ndarray:
    """n draws of the stream of a key as Draws gives them, from a block of eight on."""
    head = key.encode()
    raw = b"".join([hashlib.blake2b(head + k.to_bytes(8, "little")).digest() for k in range(block, block + (n + 7) // 8)])
    return (np.frombuffer(raw, dtype="<u8")[:n] >> np.uint64(11)) / (1 << 53)


class Draws:
    """A stream of draws that its key determines."""

    def __init__(self, *key: object):
        self.key, self.n, self.held = ":".join(map(str, key)).encode(), 0, b""

    def uniform(self) -> float:
        if len(self.held) < 8:
            self.held = hashlib.blake2b(self.key + self.n.to_bytes(8, "little")).digest()
            self.n += 1
        out, self.held = int.from_bytes(self.held[:8], "little"), self.held[8:]
        return (out >> 11) / (1 << 53)

    def below(self, n: int) -> int:
        return min(n - 1, int(self.uniform() * n))

    def pick(self, weights: list[float]) -> int:
        x, last = self.uniform() * sum(weights), 0
        for i, w in enumerate(weights):
            if w > 0:
                last = i
                if x < w:
                    return i
                x -= w
        return last

    def shuffled(self, items: list) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out
