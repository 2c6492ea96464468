"""MD5 of many short keys at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Keys of one block, and how many are worked on at a time.
BLOCK, PART = 55, 8192
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _some(keys: np.ndarray) -> np.ndarray:
    text = np.zeros((len(keys), 64), dtype=np.uint8)
    text[:, : keys.itemsize] = keys.view(np.uint8).reshape(len(keys), keys.itemsize)
    size = np.char.str_len(keys)
    text[np.arange(len(keys)), size] = 0x80
    text.view("<u8")[:, 7] = size * 8
    m = np.ascontiguousarray(text.view("<u4").T)
    a, b, c, d = (np.full(len(keys), x, dtype=np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + m[g] + np.uint32(_K[i])
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURN[i])) | (f >> np.uint32(32 - _TURN[i])))
    words = np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)], axis=1)
    return np.ascontiguousarray(words).view(">u8").astype(np.uint64)


def digests(keys: np.ndarray) -> np.ndarray:
    """Both halves of each key's MD5 as whole numbers, which sort as the digest's hex digits do. keys: an array of bytes."""
    if not len(keys):
        return np.zeros((0, 2), dtype=np.uint64)
    if keys.itemsize > BLOCK:
        return np.frombuffer(b"".join(hashlib.md5(k).digest() for k in keys.tolist()), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return np.concatenate([_some(keys[i : i + PART]) for i in range(0, len(keys), PART)])


def numbered(keys: np.ndarray, at: int, digit: int) -> np.ndarray:
    """keys with another digit at a place."""
    out = keys.copy()
    out.view(np.uint8).reshape(len(keys), -1)[:, at] = ord(str(digit))
    return out


def by_digest(keys: np.ndarray, scope: np.ndarray) -> np.ndarray:
    """Places of rows in the order of their keys' MD5s inside scopes, which are whole numbers. One number a row is sorted, unless two of them agree."""
    hashed = digests(keys)
    bits = int(scope.max(initial=0)).bit_length() + 1
    one = (scope.astype(np.uint64) << np.uint64(64 - bits)) | (hashed[:, 0] >> np.uint64(bits))
    order = np.argsort(one)
    ranked = one[order]
    return np.lexsort((hashed[:, 1], hashed[:, 0], scope)) if (ranked[1:] == ranked[:-1]).any() else order
