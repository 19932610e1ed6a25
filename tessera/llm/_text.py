"""Words and hashes of whole texts, straight from Arrow buffers with numpy.

A batch of texts is one byte buffer with offsets. Words are maximal runs of bytes outside
``\\x20\\x09-\\x0D``. Hashes are 64-bit polynomials over randomised symbols, taken as differences of
prefix sums, so a hash of any span costs O(1); they are finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_STEP = U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BASE2 = 0xA0761D6478BD642F

#: Bytes of text that one vectorised pass handles; a longer single text makes a longer pass.
SLICE = 1 << 19


def mix(z: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    z = z + _STEP
    z = (z ^ (z >> U(30))) * _M1
    z = (z ^ (z >> U(27))) * _M2
    return z ^ (z >> U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS, _CHECK_POWERS = _Powers(_BASE), _Powers(_BASE2), _Powers(0x8EBC6AF09C88C6E3)

_SYMBOL = mix(np.arange(256, dtype=U) + U(977))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_SYMBOL_LOWER = _SYMBOL[_FOLD]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Texts:
    """Consecutive texts of a batch: rows ``lo`` to ``hi`` of it, their bytes and offsets from 0."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, most: int = SLICE) -> Iterator[Texts]:
    """The texts of a column in runs of about ``most`` bytes; no text is cut."""
    if not len(column):
        return
    data, offsets = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def spans(texts: Texts, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (one more at the end)."""
    data, offsets = texts.data, texts.offsets
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    before[heads] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[heads[heads > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, check: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z first, ``check`` takes another base for a second, independent hash."""
    n = len(data)
    up, down = (_CHECK_POWERS if check else _BYTE_POWERS)(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum((_SYMBOL_LOWER if lower else _SYMBOL)[data] * up[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * _STEP)


class Sequences:
    """Hashes of spans of a word-hash sequence, each in O(1)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, self.down = _WORD_POWERS(n + 1)
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(words * up[:n], out=self.prefix[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of words ``lo`` to ``hi`` (exclusive) of each pair; equal words give equal hashes wherever they stand."""
        return mix((self.prefix[hi] - self.prefix[lo]) * self.down[lo] + (hi - lo).astype(U) * _STEP)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
