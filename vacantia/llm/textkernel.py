"""Words, lines and hashes of many texts at once, in numpy over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. UTF-8 never
uses those bytes inside a longer character, so bytes can stand for characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
DIGIT = np.zeros(256, bool)
DIGIT[list(b"0123456789")] = True
UPPER = np.zeros(256, bool)
UPPER[list(range(65, 91))] = True
PUNCT = np.zeros(256, bool)
PUNCT[list(b".,;:!?'\"()-")] = True
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 21)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
            _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inv)]), dtype=np.uint64)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of h over the whole word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of texts of about `most` bytes; one
    longer text is a run of its own. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, end - at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


class Words:
    """The words of a run of texts: where each starts and ends, and whose it is."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data, self.off, self.n = data, off, len(off) - 1
        solid = ~SPACE[data]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = solid[:-1]
        inner = off[(off > 0) & (off < len(data))]
        before[inner] = False
        self.solid = solid
        self.start = np.flatnonzero(solid & ~before)
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        after[inner - 1] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, off)  # the number of the first word of each text, and at last of all
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in mask."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]

    def _prefix(self) -> np.ndarray:
        if not hasattr(self, "_sum"):
            powers, _ = _power_tables(len(self.data) + 1)
            self._sum = np.zeros(len(self.data) + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)], out=self._sum[1:])
        return self._sum

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of bytes, the same wherever it stands."""
        total = self._prefix()
        _, inverse = _power_tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            h = (total[end] - total[start]) * inverse[start]
            return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every line, split at \\n alone."""
        cut = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.off[:-1], cut + 1]), kind="stable")
        per = self.sums(self.data == 10) + 1
        doc = np.repeat(np.arange(self.n), per)
        end = np.empty(len(start), np.int64)
        end[:-1] = start[1:]
        end[-1:] = len(self.data)
        last = np.cumsum(per) - 1
        inner = np.ones(len(start), bool)
        inner[last] = False
        end[inner] -= 1  # without its \n
        end[last] = self.off[1:]
        return start, end, doc


def runs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, how many items of its text have its hash, and whether it is counted first."""
    with np.errstate(over="ignore"):
        key = h ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    count = np.empty(len(s), np.int64)
    count[order] = np.bincount(group)[group] if len(s) else 0
    first = np.zeros(len(s), bool)
    first[order[new]] = True
    return count, first
