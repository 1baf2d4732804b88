"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A slice of texts is one byte buffer. Words are found with a table of word bytes, which is
exact for UTF-8 because every class used here is closed over non-ASCII bytes. A word's
64-bit hash comes from prefix sums of per-byte random values times powers of an odd
number, so no word becomes a Python object. Two different keys meet with a chance of
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

_WHITE = np.ones(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Bytes that end a piece of running text.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PHRASE = ~ENDS
_PHRASE[[0x20, 0x09]] = False
#: Word bytes: all but white space; digits, a-z and everything outside ASCII; or all but blanks and ends of pieces.
CLASSES = {"white": _WHITE, "alnum": _ALNUM, "phrase": _PHRASE}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R, _S = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SLICE = 1 << 20
#: Bytes or words that are hashed at a time: tables of powers have this length, however long a text is.
_STEP = 1 << 18
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    x = np.full(_STEP, base & _MASK, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse, made when first used."""

    def __init__(self, base: int):
        self.base = base

    @cached_property
    def up(self) -> np.ndarray:
        return _powers(self.base)

    @cached_property
    def down(self) -> np.ndarray:
        return _powers(pow(self.base, -1, 1 << 64))


_BYTE_POWERS, _WORD_POWERS = _Powers(_R), _Powers(_S)


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each segment; segments follow each other without overlap."""
    out = np.zeros(len(starts), np.uint64)
    up, down = _BYTE_POWERS.up, _BYTE_POWERS.down
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + _STEP - 1, "right"))
        if j > i:
            part = data[lo : int(ends[j - 1])]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
            a = starts[i:j] - lo
            out[i:j] = (total[ends[i:j] - lo] - total[a]) * down[a]
        else:  # one segment longer than a step
            j, value = i + 1, 0
            for at in range(lo, int(ends[i]), _STEP):
                part = data[at : min(at + _STEP, int(ends[i]))]
                value += int(np.sum(_BYTE[part] * up[: len(part)], dtype=np.uint64)) * pow(_R, at - lo, 1 << 64)
            out[i] = value & _MASK
        i = j
    return out


def mix(z: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@dataclass
class Slice:
    """Some rows lo..hi of a batch: bytes, and each row's byte offsets in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = _SLICE) -> Iterator[Slice]:
    """Runs of rows of about limit bytes together; a longer text is a run of its own. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()).fill_null("")
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield Slice(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


@dataclass
class Words:
    """starts, ends: bytes of each word; first[i]:first[i + 1] are row i's words; code: hash of each word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    code: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether those lie in one row. Both have max(0, words - k + 1) entries. Another salt, another hash."""
        n = len(self.code)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        up, down = _WORD_POWERS.up, _WORD_POWERS.down
        got = np.zeros(n - k + 1, np.uint64)
        for at in range(0, n - k + 1, _STEP - k):
            code = self.code[at : at + _STEP - 1]
            code = mix(code ^ np.uint64(salt)) if salt else code
            total = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(code * up[: len(code)], out=total[1:])
            m = min(len(code) - k + 1, _STEP - k)
            got[at : at + m] = mix((total[k : k + m] - total[:m]) * down[:m] + np.uint64(k))
        return got, self.last()[: n - k + 1] >= np.arange(k, n + 1, dtype=np.int32)

    def last(self) -> np.ndarray:
        """Of each word, the end of its row."""
        return np.repeat(self.first[1:].astype(np.int32), self.counts)

    def place(self) -> np.ndarray:
        """Of each word, its number in its row."""
        return np.arange(len(self.code), dtype=np.int32) - np.repeat(self.first[:-1].astype(np.int32), self.counts)

    def sequence(self, salt: int = 0) -> np.ndarray:
        """Hash of each row's whole word sequence."""
        place, code = self.place(), self.code
        code = (mix(code ^ np.uint64(salt)) if salt else code) * _WORD_POWERS.up[place & (_STEP - 1)]
        if len(place) and int(place.max()) >= _STEP:
            code *= np.array([pow(_S, _STEP * i, 1 << 64) for i in range(int(place.max() // _STEP) + 1)], np.uint64)[place // _STEP]
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code, out=total[1:])
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.counts.astype(np.uint64))


def words(s: Slice, kind: str = "white", lower: bool = False) -> Words:
    data = _LOWER[s.data] if lower else s.data
    n, table = len(data), CLASSES[kind]
    starts, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for lo in range(0, n, 4 * _STEP):
        hi = min(lo + 4 * _STEP, n)
        inside = table[data[max(lo - 1, 0) : hi + 1]]
        here = inside[1 if lo else 0 :][: hi - lo]
        before, after = np.zeros(hi - lo, bool), np.zeros(hi - lo, bool)
        before[0 if lo else 1 :] = inside[: hi - lo if lo else hi - lo - 1]
        nxt = inside[(1 if lo else 0) + 1 :]
        after[: len(nxt)] = nxt
        edge = s.offsets[(s.offsets > 0) & (s.offsets < n)]
        before[edge[(edge >= lo) & (edge < hi)] - lo] = False
        after[edge[(edge > lo) & (edge <= hi)] - 1 - lo] = False
        starts.append((np.flatnonzero(here & ~before) + lo).astype(np.int32))
        ends.append((np.flatnonzero(here & ~after) + lo + 1).astype(np.int32))
    first, to = np.concatenate(starts), np.concatenate(ends)
    return Words(data, first, to, np.searchsorted(first, s.offsets), mix(segments(data, first, to)))


def code_of(word: str) -> int:
    """The hash that words() gives this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    w = words(Slice(0, 1, raw, np.array([0, len(raw)])))
    return int(w.code[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_words(s: Slice, kind: str = "white") -> np.ndarray:
    """Words of each row, without their hashes."""
    n, table, total = len(s.data), CLASSES[kind], np.zeros(len(s.offsets) - 1, np.int64)
    for lo in range(0, n, 4 * _STEP):
        hi = min(lo + 4 * _STEP, n)
        inside = table[s.data[lo:hi]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        if lo and table[s.data[lo - 1]]:
            first[0] = False
        edge = s.offsets[(s.offsets >= lo) & (s.offsets < hi)] - lo
        first[edge] = inside[edge]
        upto = np.concatenate(([0], np.cumsum(first)))
        total += np.diff(upto[np.clip(s.offsets - lo, 0, hi - lo)])
    return total


def parts(s: Slice, kind: str, lower: bool = False, limit: int = _SLICE, context: int = 0) -> Iterator[tuple[Slice, int]]:
    """A slice as it is, or one long text in parts of about limit bytes, cut where no word is; and how many of a part's first bytes only repeat the context words before it."""
    n, table = len(s.data), CLASSES[kind]
    if n <= limit or len(s.offsets) != 2:
        yield s, 0
        return
    word = lambda lo, hi: table[_LOWER[s.data[lo:hi]] if lower else s.data[lo:hi]]
    lo = before = 0
    while lo < n:
        hi = min(lo + limit, n)
        while hi < n:
            out = np.flatnonzero(~word(lo, hi))
            if len(out):
                hi = lo + int(out[-1]) + 1
                break
            hi = min(hi + limit, n)  # a word longer than the limit
        yield Slice(s.lo, s.hi, s.data[before:hi], np.array([0, hi - before])), lo - before
        if context:
            inside = word(before, hi)
            first = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
            before = before + int(first[-context]) if len(first) >= context else before
        else:
            before = hi
        lo = hi
