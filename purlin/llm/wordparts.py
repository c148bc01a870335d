"""Hashed parts of words for many words at once, and a bounded table of words for scoring in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(31).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_WHOLE, _PREFIX = np.uint64(0xA24BAED4963EE407), 0x9FB21C651E98DF25
SLICE = 1 << 20  # code points hashed at a time
BLOCK = 1 << 20  # characters of text scored at a time


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Spelled:
    """The code points of a list of words, one after another."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), self.size)

    def grams(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, hash) of every run of ``n`` code points within a word, in slices: memory is bounded, no run is lost."""
        for low in range(0, max(0, len(self.flat) - n + 1), SLICE):
            part, word = self.flat[low : low + SLICE + n - 1].astype(np.uint64), self.word[low : low + SLICE + n - 1]
            m = len(part) - n + 1
            total = np.zeros(m, np.uint64)
            coded = mixed(part + np.uint64(1))
            for k in range(n):
                total += coded[k : k + m] * _STEPS[k]
            inside = word[:m] == word[n - 1 :]
            yield word[:m][inside], mixed(total + np.uint64(n))[inside]

    def wholes(self) -> np.ndarray:
        """A hash of each word."""
        out = np.zeros(len(self.size), np.uint64)
        for low in range(0, len(self.flat), SLICE):
            part, word = self.flat[low : low + SLICE].astype(np.uint64), self.word[low : low + SLICE]
            place = (np.arange(low, low + len(part)) - self.begin[word]).astype(np.uint64)
            np.add.at(out, word, mixed(part * _WHOLE + mixed(place + np.uint64(1))))
        return mixed(out + self.size.astype(np.uint64))

    def prefix(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the first ``k`` code points of each longer word."""
        word = np.flatnonzero(self.size > k)
        total = np.zeros(len(word), np.uint64)
        for j in range(k):
            total += mixed(self.flat[self.begin[word] + j].astype(np.uint64) + np.uint64(1)) * _STEPS[j]
        return word, mixed(total + np.uint64(_PREFIX * k % (1 << 64)))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], ..., begin[0] + size[0] - 1, begin[1], ..."""
    total = int(size.sum())
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)


def blocks(texts: list[str], block: int = BLOCK) -> Iterator[list[str]]:
    """The texts in runs of about ``block`` characters; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > block:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class WordTable:
    """Numbers for words as they stand in texts; ``learn`` sees each new word once and keeps what it likes by number.

    Emptied between blocks at ``limit`` words or ``chars`` characters, for bounded memory: results don't depend on it.
    """

    def __init__(self, learn: Callable[[list[str], int], None], limit: int = 500_000, chars: int = 10_000_000):
        self.learn, self.limit, self.chars = learn, limit, chars
        self.index: dict[str, int] = {}
        self.held = 0

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word, its text, words of each text) of a block of texts."""
        if len(self.index) > self.limit or self.held > self.chars:
            self.index.clear()
            self.held = 0
        words = [t.split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        new = list(set().union(*words).difference(self.index))
        if new:
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new))))
            self.held += sum(map(len, new))
            self.learn(new, first)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        return at, np.repeat(np.arange(len(texts)), counts), counts


class Grown:
    """An array that is written further and further; from the start again where ``first`` is 0."""

    def __init__(self, kind: type):
        self.data = np.zeros(1 << 16, kind)

    def put(self, first: int, values: np.ndarray) -> None:
        while first + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[first : first + len(values)] = values
