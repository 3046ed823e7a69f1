"""Elias-Fano coded monotone sequences in flat files that workers map into memory.

A sequence of n non-decreasing numbers below u keeps floor(log2(u/n)) low bits
of each number packed in a row, and the high parts in unary, about two bits a
number.  Counts of ones and zeros before each 64-bit word make ``access`` and
``rank`` (successor search) a binary search plus work inside one word.  All
operations take and return numpy arrays.
"""

from __future__ import annotations

import json

import numpy as np

from tunesift.llm.common import ship

ship(__name__)

_U = np.uint64


def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the (r+1)-th set bit of each word."""
    x, r = x.copy(), r.astype(np.int64)
    at = np.zeros(len(x), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(x & _U((1 << width) - 1)).astype(np.int64)
        up = r >= ones
        r -= np.where(up, ones, 0)
        x >>= np.where(up, width, 0).astype(np.uint64)
        at += np.where(up, width, 0)
    return at


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * _U(bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero(shift + _U(bits) > 64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return out


class EliasFano:
    """A coded sequence; its arrays may be memory-mapped."""

    def __init__(self, n: int, bits: int, low, high, ones, zeros):
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values).astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        at = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((n + (top >> bits)) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, at >> 6, _U(1) << (at & 63).astype(np.uint64))
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        return cls(n, bits, _pack(values & _U((1 << bits) - 1), bits), high, before, np.arange(len(high)) * 64 - before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        # a shift by 64 is avoided by shifting twice
        both = self.low[word] >> shift | self.low[word + 1] << _U(1) << (_U(63) - shift)
        return both & _U((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, np.uint64)
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return (at - i).astype(np.uint64) << _U(self.bits) | self._low(i)

    def _after_zeros(self, k: np.ndarray) -> np.ndarray:
        """How many numbers come before the k-th zero (k from 1; none for k = 0) of the high parts."""
        word = np.searchsorted(self.zeros, np.maximum(k - 1, 0), "right") - 1
        at = word * 64 + _select_in_word(~self.high[word], np.maximum(k - 1, 0) - self.zeros[word])
        return np.where(k > 0, at - (k - 1), 0)

    def rank(self, values: np.ndarray) -> np.ndarray:
        """How many numbers are below each value: the place of its successor."""
        values = np.asarray(values).astype(np.uint64)
        if not self.n or not len(values):
            return np.zeros(len(values), np.int64)
        part = values >> _U(self.bits)
        most = int(self.high.shape[0] * 64 - self.n)  # zeros there are, padding included
        beyond = part >= _U(most)
        part = np.where(beyond, 0, part).astype(np.int64)
        low, high = np.minimum(self._after_zeros(part), self.n), np.minimum(self._after_zeros(np.minimum(part + 1, most)), self.n)
        want = values & _U((1 << self.bits) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            less = self._low(middle) < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return np.where(beyond, self.n, low)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        at = self.rank(values)
        inside = np.flatnonzero(at < self.n)
        out = np.full(len(at), -1, np.int64)
        hit = inside[self.access(at[inside]) == np.asarray(values).astype(np.uint64)[inside]]
        out[hit] = at[hit]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": np.asarray(self.ones, np.int64),
                f"{name}.zeros": np.asarray(self.zeros, np.int64), f"{name}.shape": np.array([self.n, self.bits], np.int64)}

    @classmethod
    def open(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.shape"].tolist()
        return cls(n, bits, *(arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros")))


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """One file: the length of a JSON directory, the directory, then the arrays, each at a multiple of eight bytes."""
    from pyarrow import fs
    files, path = fs.FileSystem.from_uri(uri)
    directory, at = {}, 0
    for name, a in arrays.items():
        directory[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(directory).encode()
    head += b" " * (-len(head) % 8)
    with files.open_output_stream(path, compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    return 8 + len(head) + at


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped where the folder is mounted and read into memory elsewhere."""
    from pyarrow import fs
    files, path = fs.FileSystem.from_uri(uri)
    if files.type_name == "local":
        raw = np.memmap(path, np.uint8, "r")
    else:
        with files.open_input_stream(path, compression=None) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    size = int(raw[:8].view("<u8")[0])
    directory = json.loads(bytes(raw[8:8 + size]))
    out = {}
    for name, (kind, n, at) in directory.items():
        start = 8 + size + at
        out[name] = raw[start:start + n * np.dtype(kind).itemsize].view(kind)
    return out
