"""Word kernels over Arrow text buffers, used inside Spark tasks.

A word is a run of bytes outside space and \\x09-\\x0D, as the pattern ``[^\\x20\\x09-\\x0D]+`` has it; no byte of a
UTF-8 sequence is one of these, so words can be cut from the raw bytes. Work arrays stay near one megabyte of text
at a time, whatever the length of a document.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ._common import ship

ship(__name__)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)  # all ASCII but letters and digits
for _a, _z in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_ALNUM[_a:_z] = False
BLOCK = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)  # of the first bytes of a block of eight
LONG = 1024  # bytes from which a word is hashed by a digest


class Words(NamedTuple):
    data: np.ndarray  # the bytes of all texts
    starts: np.ndarray  # of each word
    ends: np.ndarray
    first: np.ndarray  # of each text, its first word; one more entry at the end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def split(column: pa.Array, space: np.ndarray = SPACE) -> Words:
    """The words of each text of a column; ``space`` marks the bytes between words."""
    data, off = buffers(column)
    n = len(data)
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(space[data], out=solid[1:-1])
    begin = solid[1:] & ~solid[:-1]  # at i: a word starts with byte i
    end = solid[:-1] & ~solid[1:]  # at i: a word ends before byte i
    cut = off[1:-1]  # two texts meet here
    begin[cut] |= solid[1:][cut]
    end[cut] |= solid[:-1][cut]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    return Words(data, starts, ends, np.searchsorted(starts, off))


def blocks(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` (8 at most) bytes from each place on as one value; ``data`` goes on for 8 bytes after its last word."""
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at])
    return eight.view("<u8").ravel() & MASK[n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data`` (which goes on for 8 bytes after the last span): blocks of eight bytes, scrambled one
    into the next, and from eight bytes on the length. Spans of up to seven bytes never collide, longer ones by chance only."""
    n = ends - starts
    first = blocks(data, starts, np.minimum(n, 8))
    h = mix(np.where(n < 8, first | (n.astype(U64) << U64(56)), first))
    at, k = np.flatnonzero(n > 8), 8
    while len(at) and k < LONG:
        at = at[n[at] <= LONG] if k == 8 else at
        h[at] = mix(h[at] * U64(0xA24BAED4963EE407) + mix(blocks(data, starts[at] + k, np.minimum(n[at] - k, 8)) + U64(k)))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    at = np.flatnonzero(n >= 8)
    h[at] = mix(h[at] ^ mix(n[at]))
    return h


def hashes(w: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower``: A-Z count as a-z."""
    out = np.empty(len(w.starts), U64)
    lo, n = 0, len(w.starts)
    while lo < n:
        a = w.starts[lo]
        hi = max(lo + 1, int(np.searchsorted(w.ends, a + BLOCK, "right")))
        z = w.ends[hi - 1]
        data = np.zeros(z - a + 16, np.uint8)
        data[: z - a] = LOWER[w.data[a:z]] if lower else w.data[a:z]
        out[lo:hi] = spans_hash(data, w.starts[lo:hi] - a, w.ends[lo:hi] - a)
        lo = hi
    return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on (of those with k words from there)."""
    n = max(0, len(h) - k + 1)
    x = np.zeros(n, U64)
    for i in range(k):
        x *= U64(0xA24BAED4963EE407)
        x += h[i : i + n]
    return mix(x)


def chunks(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    c = batch.column(batch.schema.get_field_index(column))
    _, off = buffers(c)
    lo = 0
    while lo < len(c):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
