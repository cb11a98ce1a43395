"""Words of many texts at once, as numpy arrays: where they stand, and hashes of them and of runs of them.

A word is a run of the characters that \\w has; its letters are lower-cased one by one. Texts are joined by line ends and
read by chunks of about CHARS characters, so the arrays stay small unless a single text is long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHARS = 1_000_000
_odd = np.random.default_rng(20240502).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is of a word, and a random number for its lower-case letter."""
    letters = [chr(c) for c in range(0x110000)]
    word = np.fromiter((x.isalnum() or x == "_" for x in letters), bool, len(letters))
    lower = np.fromiter((ord(y) if len(y := x.lower()) == 1 else ord(x) for x in letters), np.int64, len(letters))
    return word, np.random.default_rng(20240503).integers(0, 2**64, size=len(letters), dtype=np.uint64)[lower]


def join(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    h = (a * _odd[seed]) ^ (b * _odd[seed + 1])
    h ^= h >> np.uint64(32)
    h *= _odd[seed + 2]
    return h ^ (h >> np.uint64(29))


def rolled(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of each `width` numbers in a row, from those of half the width."""
    if width == 1:
        return h
    low = 1 << (width.bit_length() - 1)
    if low == width:
        half = rolled(h, width // 2, seed)
        return join(half[: len(half) - width // 2], half[width // 2 :], seed)
    a, b = rolled(h, low, seed), rolled(h, width - low, seed)
    n = max(len(h) - width + 1, 0)
    return join(a[:n], b[low : low + n], seed)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


class Words:
    """start, end: code points in the joined texts; text, line: numbers over all texts; hash: of the lower-cased word."""

    def __init__(self, texts: list[str]):
        word, mix = _tables()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = word[codes]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        size = self.end - self.start
        #: Where each text starts, and where each line starts; a last one past the end.
        self.offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.lines = np.concatenate(([0], np.flatnonzero(codes == 10) + 1, [len(codes) + 1]))
        self.text = np.searchsorted(self.offsets, self.start, "right") - 1
        self.line = np.searchsorted(self.lines, self.start, "right") - 1
        self.hash = np.empty(0, np.uint64)
        if len(size):
            first = np.cumsum(size) - size
            powers = np.multiply.accumulate(np.full(int(size.max()), _odd[60]))
            spread = np.add.reduceat(mix[codes[inside]] * powers[np.arange(int(size.sum())) - np.repeat(first, size)], first)
            self.hash = join(spread, size.astype(np.uint64), 57)

    def first_line(self, text: np.ndarray) -> np.ndarray:
        """The number of the first line of each text."""
        return np.searchsorted(self.lines, self.offsets[text])

    def sums(self, first: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
        """A hash of each run of `size` words from `first` on; the runs may overlap."""
        powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(self.hash), _odd[seed]))))
        back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(self.hash), np.uint64(pow(int(_odd[seed]), -1, 1 << 64))))))
        total = np.concatenate(([np.uint64(0)], np.cumsum(join(self.hash, self.hash, seed + 1) * powers[:-1], dtype=np.uint64)))
        return join((total[first + size] - total[first]) * back[first], size.astype(np.uint64), seed + 4)


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of about CHARS characters each."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > CHARS:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, texts[first:]
