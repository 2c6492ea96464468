"""Words of Arrow string columns as 64-bit codes, made with whole-array NumPy operations.

A word's code is a polynomial hash of its bytes, which follows from two prefix sums; no Python string is made.
Text is worked through in windows of about a megabyte which end between words, so memory stays bounded for texts
of any length. Codes of equal words are equal; those of different words differ but for hash collisions (2**-64).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_WINDOW = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_code = np.arange(256)
#: Word bytes of [^\x20\x09-\x0D]+
NOT_SPACE = ~((_code == 0x20) | ((_code >= 0x09) & (_code <= 0x0D)))
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in text with A-Z lower-cased
LETTERS_DIGITS = ((_code >= 0x30) & (_code <= 0x39)) | ((_code >= 0x61) & (_code <= 0x7A)) | ((_code >= 0x41) & (_code <= 0x5A)) | (_code >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _WINDOW + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def release() -> None:
    """Give memory that a worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _cut(data: np.ndarray, off: np.ndarray, word: np.ndarray, pos: int) -> int:
    """End of the window that begins at pos: a text's end, else between two words."""
    end = pos + _WINDOW
    if end >= len(data):
        return len(data)
    k = np.searchsorted(off, end, "right") - 1
    if off[k] > pos:
        return int(off[k])
    gaps = np.flatnonzero(~word[data[pos:end]])
    if len(gaps):
        return pos + int(gaps[-1]) + 1
    stop = int(off[k + 1])  # one word of more than a window
    while end < stop:
        gaps = np.flatnonzero(~word[data[end : min(end + _WINDOW, stop)]])
        if len(gaps):
            return end + int(gaps[0]) + 1
        end += _WINDOW
    return stop


def word_codes(texts: pa.Array, word: np.ndarray, places: bool = False):
    """Codes of all words and, for each text, where its codes begin; with places also the byte range of every word."""
    data, off = text_bytes(texts)
    codes, starts, ends = [], [], []
    pos = 0
    while pos < len(data):
        end = _cut(data, off, word, pos)
        x = data[pos:end]
        inside = word[x]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = off[np.searchsorted(off, pos, "right") : np.searchsorted(off, end, "left")] - pos
        first[edges] |= inside[edges]
        last[edges - 1] |= inside[edges - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _Powers.upto(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * up[: len(x)], out=sums[1:])
        codes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_BASE)))
        starts.append(s + pos)
        if places:
            ends.append(e + pos)
        pos = end
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(start, off, "left").astype(np.int64)
    if places:
        return code, bounds, start, (np.concatenate(ends) if ends else np.zeros(0, np.int64))
    return code, bounds


_EXACT = np.random.Generator(np.random.PCG64(977)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of ascending byte ranges that don't overlap, case kept."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _WINDOW, "right")))
        base = starts[i]
        x = data[base : ends[j - 1]]
        up, down = _Powers.upto(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_EXACT[x] * up[: len(x)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_BASE))
        i = j
    return out


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Code of the n words from each position on; the last n-1 positions have none."""
    m = max(0, len(codes) - n + 1)
    acc = np.full(m, (n * _BASE) % (1 << 64), np.uint64)
    for j in range(n):
        acc += codes[j : j + m] * _GRAM[j % len(_GRAM)] if j < len(_GRAM) else mix(codes[j : j + m] + np.uint64(j))
    return mix(acc)


def gram_ends(bounds: np.ndarray) -> np.ndarray:
    """For every word the end of its text."""
    return np.repeat(bounds[1:], np.diff(bounds))


def shingle_sets(codes: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of n words of each text in ascending order; of 1 to n-1 words the whole sequence is the one shingle."""
    g = grams(codes, n)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.arange(len(g)) + n <= gram_ends(bounds)[: len(g)]
    d, g = doc[: len(g)][whole], g[whole]
    lengths = np.diff(bounds)
    extra_d, extra_g = [], []
    for m in range(1, n):
        at = np.flatnonzero(lengths == m)
        if len(at):
            gm = np.full(len(at), (m * _BASE) % (1 << 64), np.uint64)
            for j in range(m):
                gm += codes[bounds[at] + j] * _GRAM[j]
            extra_d.append(at)
            extra_g.append(mix(gm))
    if extra_d:
        d, g = np.concatenate([d, *extra_d]), np.concatenate([g, *extra_g])
        order = np.argsort(d, kind="stable")  # two sorted runs
        d, g = d[order], g[order]
    edge = np.searchsorted(d, np.arange(len(bounds)))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > 1:
            g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    d, g = d[new], g[new]
    return g, np.searchsorted(d, np.arange(len(bounds))).astype(np.int64)
