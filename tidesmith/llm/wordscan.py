"""Words, lines and shingles of whole record batches as numpy arrays.

Words are runs of bytes other than space and \\t to \\r; every array refers to
one flat buffer that holds the texts of a batch one after another.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from .common import offsets

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.cumprod(np.full(1 << 12, 0xD1342543DE82EF95, np.uint64))]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.full(n + n // 2, 0xD1342543DE82EF95, np.uint64))
    return _POWERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Scan:
    """The texts of one batch. `lower`: hash words with A-Z lower-cased."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        at, data = offsets(texts)
        self.n, self.data = len(at) - 1, data[at[0] : at[-1]]
        self.off, self.lower = at - at[0], lower
        self.space = SPACE[self.data]

    def _runs(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes without `gap`; a text's ends bound them too."""
        full = self.off[:-1] < self.off[1:]
        before, after = np.empty(len(gap), bool), np.empty(len(gap), bool)
        if len(gap):
            before[0], before[1:] = True, gap[:-1]
            after[-1], after[:-1] = True, gap[1:]
            before[self.off[:-1][full]] = True
            after[self.off[1:][full] - 1] = True
        return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1

    def _text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, "right") - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the disjoint runs [start, end)."""
        if not len(starts):
            return np.empty(0, np.uint64)
        size = ends - starts
        which = np.repeat(np.arange(len(starts)), size)
        first = np.cumsum(size) - size
        place = np.arange(len(which)) - first[which]
        values = _VALUES[data[starts[which] + place]] * powers(int(size.max()))[place]
        return mix(np.add.reduceat(values, first) ^ size.astype(np.uint64))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self._runs(self.space)

    @cached_property
    def word_text(self) -> np.ndarray:
        return self._text_of(self.words[0])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.word_text, minlength=self.n)

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self._hashes(LOWER[self.data] if self.lower else self.data, *self.words)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, hash and length of the lines that hold a word."""
        starts, ends = self._runs(self.data == 10)
        solid = np.concatenate(([0], np.cumsum(~self.space, dtype=np.int64)))
        held = solid[ends] > solid[starts]
        starts, ends = starts[held], ends[held]
        return self._text_of(starts), self._hashes(self.data, starts, ends), ends - starts

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of `width` words within a text."""
        h, of = self.word_hash, self.word_text
        if len(h) < width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(of[: len(h) - width + 1] == of[width - 1 :])
        out = np.full(len(at), width, np.uint64)
        for i in range(width):
            out = mix(out ^ h[at + i])
        return at, out

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """For each text, its sorted distinct window hashes; a text of fewer words is one shingle, one without words none."""
        at, h = self.windows(width)
        of = self.word_text[at] if len(at) else at
        cut = np.searchsorted(of, np.arange(self.n + 1))
        first = np.searchsorted(self.word_text, np.arange(self.n + 1))
        sets = []
        for i in range(self.n):
            k = first[i + 1] - first[i]
            if k >= width:
                sets.append(np.unique(h[cut[i] : cut[i + 1]]))
            elif k:
                one = np.full(1, k, np.uint64)
                for w in range(first[i], first[i + 1]):
                    one = mix(one ^ self.word_hash[w : w + 1])
                sets.append(one)
            else:
                sets.append(np.empty(0, np.uint64))
        return sets
