"""Runs of numbers of different lengths, one after another in one array."""

from __future__ import annotations

import numpy as np


def take_runs(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs ``flat[first:first + count]`` one after another."""
    at = np.repeat(first - np.cumsum(count) + count, count)
    return flat[at + np.arange(len(at))]


class Runs:
    """A run of numbers for each word, in one array."""

    def __init__(self, kind: type):
        self.flat, self.first, self.count = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype, copy=False)])


class Numbers(dict):
    """Words numbered on first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n
