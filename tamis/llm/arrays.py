"""Packed column blocks that tasks exchange, and word hashes."""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from xxhash import xxh64_intdigest

#: distinct words that a worker remembers before it starts anew
MEMORY = 150_000


class WordHashes(dict):
    """word -> its 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rows_of(batch, *names: str):
    """The rows of an Arrow batch as tuples, some hundred at a time as Python objects."""
    for lo in range(0, batch.num_rows, 512):
        part = batch.slice(lo, 512)
        yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = np.array(x, np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def pack(*cols: np.ndarray) -> bytes:
    """Columns of one length as compressed bytes; the first must ascend (its differences are kept)."""
    n, body = len(cols[0]), []
    kinds = "".join(f"{c.dtype.kind}{c.dtype.itemsize}" for c in cols)
    for k, c in enumerate(cols):
        c = np.diff(c, prepend=c.dtype.type(0)) if k == 0 else np.ascontiguousarray(c)
        body.append(c.view(np.uint8).reshape(n, c.dtype.itemsize).T.tobytes())
    head = struct.pack("<QB", n, len(kinds)) + kinds.encode()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<QB", raw)
    kinds = raw[9:9 + m].decode()
    at, out = 9 + m, []
    for k in range(0, m, 2):
        dtype = np.dtype(kinds[k:k + 2])
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def unpack_all(blobs) -> list[np.ndarray]:
    """The blocks' columns, joined."""
    return [np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True)]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts, in columns sorted by them."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def by_part(part: np.ndarray, n_parts: int):
    """(part, rows of that part in ascending order) of each part that occurs."""
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p]:edges[p + 1]]
