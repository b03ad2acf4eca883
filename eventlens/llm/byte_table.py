"""Numbers for short byte strings, looked up by numpy for a whole batch at once."""

from __future__ import annotations

import numpy as np

LANES = 3
LONGEST = 8 * LANES
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lanes_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """A row per string: its first bytes, eight in a number (zero behind its end), and its length."""
    data = np.concatenate([data, np.zeros(8 * lanes, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = np.zeros((lanes + 1, len(size)), np.uint64)
    for k in range(lanes):
        if k:
            some = np.flatnonzero(size > 8 * k)
            out[k, some] = eight[start[some] + 8 * k] & _KEEP[np.minimum(size[some] - 8 * k, 8)]
        else:
            out[0] = eight[start] & _KEEP[np.minimum(size, 8)]
    out[lanes] = size
    return out.T


def hash_lanes(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class ByteTable:
    """Strings numbered from 0 on first use. Those of up to ``LONGEST`` bytes
    are in an open-addressing table of numpy arrays, compared whole; longer
    ones in a dictionary."""

    def __init__(self, bits: int = 16):
        self.long: dict[bytes, int] = {}
        self.n = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.shift, self.rows = np.uint64(64 - bits), np.zeros((1 << bits, LANES + 1), np.uint64)
        self.number = np.full(1 << bits, -1, np.int64)

    def _slots(self, rows: np.ndarray) -> np.ndarray:
        return ((hash_lanes(rows) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def _find(self, rows: np.ndarray) -> np.ndarray:
        """Number of each row, -1 if it has none."""
        out = np.full(len(rows), -1, np.int64)
        at, todo = self._slots(rows), np.arange(len(rows))
        while len(todo):
            found = self.number[at]
            same = (self.rows[at] == rows[todo]).all(axis=1) & (found >= 0)
            out[todo[same]] = found[same]
            go_on = ~same & (found >= 0)
            todo, at = todo[go_on], (at[go_on] + 1) % len(self.number)
        return out

    def _place(self, rows: np.ndarray, number: np.ndarray) -> None:
        """Enters distinct rows that are not there yet."""
        at, todo = self._slots(rows), np.arange(len(rows))
        while len(todo):
            free = np.flatnonzero(self.number[at] < 0)
            slot, first = np.unique(at[free], return_index=True)  # one of those that want a slot
            won = free[first]
            self.rows[slot], self.number[slot] = rows[todo[won]], number[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) % len(self.number)

    def _enter(self, rows: np.ndarray, number: np.ndarray) -> None:
        used = int((self.number >= 0).sum()) + len(rows)
        if 2 * used > len(self.number):
            old, kept = self.rows[self.number >= 0], self.number[self.number >= 0]
            self._empty(int(2 * used).bit_length() + 1)
            self._place(old, kept)
        self._place(rows, number)

    def find(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Number of each string ``data[start:stop]``, -1 for one that has none."""
        size = stop - start
        out = np.full(len(size), -1, np.int64)
        short = np.flatnonzero(size <= LONGEST)
        out[short] = self._find(lanes_of(data, start[short], size[short]))
        if self.long:
            for k in np.flatnonzero(size > LONGEST).tolist():
                out[k] = self.long.get(data[start[k]:stop[k]].tobytes(), -1)
        return out

    def numbers(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each string ``data[start:stop]``, and the places of one of
        each new one, in the order of their numbers."""
        size = stop - start
        out = np.full(len(size), -1, np.int64)
        fresh = []
        short = np.flatnonzero(size <= LONGEST)
        rows = lanes_of(data, start[short], size[short])
        out[short] = self._find(rows)
        new = np.flatnonzero(out[short] < 0)
        if len(new):
            own = rows[new]
            _, first, which = np.unique(hash_lanes(own), return_index=True, return_inverse=True)
            if (own[first][which] != own).any():  # two strings of one hash
                _, first, which = np.unique(own, axis=0, return_index=True, return_inverse=True)
                which = which.ravel()
            number = self.n + np.arange(len(first))
            self._enter(own[first], number)
            out[short[new]] = number[which]
            fresh.append(short[new[first]])
            self.n += len(first)
        for k in np.flatnonzero(size > LONGEST).tolist():
            word = data[start[k]:stop[k]].tobytes()
            if word not in self.long:
                self.long[word] = self.n
                self.n += 1
                fresh.append(np.array([k]))
            out[k] = self.long[word]
        return out, np.concatenate(fresh) if fresh else np.zeros(0, np.int64)
