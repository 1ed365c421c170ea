"""Hashes of many spans of a block of bytes at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Spans beyond this many bytes are hashed one by one, by BLAKE2.
LONG = 256

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_LENGTH, _CHAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one integer; zeros follow the end."""
    tail = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=tail, strides=(1,))


def head(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first bytes of each span, at most eight."""
    return view[starts] & _MASK[np.minimum(lengths, 8)]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span.

    Eight bytes at a time are mixed by permutations, so spans of one length up
    to eight bytes never share a hash.
    """
    view, n = lanes(data), ends - starts
    h = mix(head(view, starts, n) ^ (n.astype(np.uint64) * _LENGTH))
    rest = np.flatnonzero((n > 8) & (n <= LONG))
    at, left = starts[rest] + 8, n[rest] - 8
    while len(rest):
        h[rest] = mix(h[rest] * _CHAIN ^ head(view, at, left))
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the bounds of each; a null is an empty text."""
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]
