"""Vectorised text kernels shared by the operators: Arrow text as bytes, word hashes, integer maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one numpy pass; bounds the working memory whatever the batch holds.
PASS_BYTES = 1 << 18

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_MASK64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others spread over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = _powers(1 << 16, _BASE)
    down = _powers(1 << 16, pow(_BASE, -1, 1 << 64))

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
        return cls.up, cls.down


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups_of(offsets: np.ndarray, size: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Splits rows of UTF-8 into words: maximal runs of bytes that are no separators.

    ``table`` maps each byte to itself, to its lower-case form, or to 0x20 for a separator.
    """

    def __init__(self, separators: bytes):
        table = bytearray(range(256))
        for c in separators:
            table[c] = 32
        for c in range(ord("A"), ord("Z") + 1):  # folding comes first: a capital is what its small letter is
            table[c] = table[c + 32]
        self.table = np.frombuffer(bytes(table), np.uint8)

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Folded bytes, word starts, word ends, and for each row the number of its first word."""
        folded = self.table[data]
        inside = folded != 32
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        at = offsets[:-1]
        at = at[at < len(data)]
        begin[at] |= inside[at]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        last = offsets[1:] - 1
        last = last[last >= 0]
        end[last] |= inside[last]
        starts = np.flatnonzero(begin)
        return folded, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of every word, and for each row the number of its first word (n + 1 values)."""
        hashed, firsts = [], []
        seen = 0
        for a, b in groups_of(offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            out, count = [], np.zeros(len(at), np.int64)
            for lo, hi in self._cuts(part):
                folded, s, e, _ = self.edges(part[lo:hi], np.clip(at, lo, hi) - lo)
                up, down = _Powers.upto(hi - lo + 1)
                total = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum(_BYTE_CODE[folded] * up[: hi - lo], out=total[1:])
                out.append(mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _GOLD))
                count += np.searchsorted(s + lo, at)
            hashed += out
            firsts.append(seen + count[:-1])
            seen += sum(map(len, out))
        if not hashed:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return np.concatenate(hashed), np.concatenate([*firsts, [seen]])

    def _cuts(self, part: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of a long run of bytes, cut only at separators."""
        lo, n = 0, len(part)
        while n - lo > 2 * PASS_BYTES:
            hi, step = lo + PASS_BYTES, 4096
            while hi < n:
                gap = np.flatnonzero(self.table[part[hi : hi + step]] == 32)
                if len(gap):
                    hi += int(gap[0])
                    break
                hi += step
            hi = min(hi, n)
            yield lo, hi
            lo = hi
        if n > lo:
            yield lo, n


class IntMap:
    """An immutable map from 64-bit keys to row numbers, probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        waiting, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(waiting):
            free = self.slot[at] < 0
            _, first = np.unique(at[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self.slot[at[winners]] = waiting[winners]
            left = np.ones(len(waiting), bool)
            left[winners] = False
            waiting, at = waiting[left], (at[left] + 1) & self.last

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        row = self.slot[at]
        wrong = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            got = self.slot[at[wrong]]
            row[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[got] != keys[wrong])]
        return row
