"""Edit distances of many pairs of words at once."""

from __future__ import annotations

import numpy as np

#: Widths of tables of letters; longer words are compared one by one. Pairs that are worked on at a time.
WIDTHS, PART = (8, 16, 64), 32768


def _long(a: np.ndarray, b: np.ndarray) -> int:
    """Of two words as numbers; rows are worked out whole."""
    steps = np.arange(len(b) + 1)
    row = steps
    for i, c in enumerate(a.tolist(), 1):
        step = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != c))])
        row = np.minimum.accumulate(step - steps) + steps
    return int(row[-1])


class Edits:
    """Distances in letters between words that are given by their places in a list."""

    def __init__(self, words: list[str]):
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        met = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
        met[flat] = True
        number = np.cumsum(met) - 1
        self.codes = number.astype(np.uint8 if number[-1] < 256 else np.uint32)[flat]
        self.size = np.array([len(w) for w in words] or [0], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.capped = np.minimum(self.size, WIDTHS[-1] + 1).astype(np.uint8)
        self.tables: dict[int, np.ndarray] = {}

    def _table(self, width: int) -> np.ndarray:
        if width not in self.tables:
            table = np.zeros((len(self.size), width), dtype=self.codes.dtype)
            fits = np.flatnonzero(self.size <= width)
            row = np.repeat(fits, self.size[fits])
            at = np.arange(len(row)) - np.repeat(np.cumsum(self.size[fits]) - self.size[fits], self.size[fits])
            table[row, at] = self.codes[self.first[row] + at]
            self.tables[width] = table
        return self.tables[width]

    def _letters(self, x: np.ndarray, width: int, n: int) -> np.ndarray:
        """The first n letters of words, a row for each place."""
        table = self._table(width)
        if table.dtype == np.uint8 and width <= 16:  # a word's row is copied as one number
            return np.ascontiguousarray(table.view(np.uint64 if width == 8 else np.complex128)[:, 0][x].view(np.uint8).reshape(len(x), width).T[:n])
        return np.ascontiguousarray(table[x].T[:n])

    def _short(self, x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, room: int) -> np.ndarray:
        """Of words of m letters, room at most, from words of n, which ascend: pairs drop out of the front as they end."""
        most = int(n[-1])
        width = next(w for w in WIDTHS if w >= max(room, most))
        a, b = self._letters(x, width, room), self._letters(y, width, most)
        row = np.repeat(np.arange(room + 1, dtype=np.uint8)[:, None], len(x), axis=1)
        corner, old, step = (np.empty(len(x), dtype=np.uint8) for _ in range(3))
        out = np.zeros(len(x), dtype=np.int64)
        ends = np.searchsorted(n, np.arange(most + 1), "right").tolist()
        for j in range(most):
            on = slice(ends[j], None)
            c, o, t, letter = corner[on], old[on], step[on], b[j][on]
            c[:] = row[0][on]
            row[0] = j + 1
            left = row[0][on]
            for i in range(room):
                cell = row[i + 1][on]
                o[:] = cell
                np.add(c, a[i][on] != letter, out=c)
                np.minimum(o, left, out=t)
                np.add(t, 1, out=t)
                np.minimum(t, c, out=cell)
                c, o, left = o, c, cell
            done = np.arange(ends[j], ends[j + 1])
            out[done] = row[m[done], done]
        return out

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        differ = np.flatnonzero(x != y)
        x, y = x[differ], y[differ]
        m, n = self.capped[x], self.capped[y]
        turned = m > n
        x, y, m, n = np.where(turned, y, x), np.where(turned, x, y), np.minimum(m, n), np.maximum(m, n)
        room = np.where(n > WIDTHS[-1], 255, np.maximum((m + 3) // 4 * 4, 4)).astype(np.uint8)
        order = np.argsort((room.astype(np.uint16) << np.uint16(8)) | n, kind="stable")
        x, y, m, n, room = x[order], y[order], m[order], n[order], room[order]
        found = np.empty(len(x), dtype=np.int64)
        ends = [*np.flatnonzero(np.diff(room)) + 1, len(x)]
        for low, high in zip([0, *ends[:-1]], ends, strict=True):
            for i in range(low, high, PART):
                one = slice(i, min(high, i + PART))
                if room[i] <= WIDTHS[-1]:
                    found[one] = self._short(x[one], y[one], m[one], n[one], int(room[i]))
                else:
                    found[one] = [_long(*(self.codes[self.first[z] : self.first[z] + self.size[z]] for z in pair)) for pair in zip(x[one], y[one], strict=True)]
        out[differ[order]] = found
        return out
