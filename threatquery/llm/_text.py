"""Word and hash kernels over Arrow string columns.

Texts stay in the UTF-8 buffers that Arrow delivers; all work is vectorised
over bytes and words. Only A-Z are lower-cased, which never changes the length
of a text, and bytes of multi-byte characters are word bytes in both alphabets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    h = h + _C1
    h ^= h >> U64(30)
    h *= _C2
    h ^= h >> U64(27)
    h *= _C3
    h ^= h >> U64(31)
    return h


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_string_view(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = pc.fill_null(array, "")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def parts(batches, name: str = "text", most: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """Batches whose texts have about ``most`` bytes, one row at least."""
    for batch in batches:
        _, offsets = column(batch.column(batch.schema.get_field_index(name)))
        for a, b in slices(offsets, most):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """The words of some texts: lower-cased bytes, byte spans, and the first word of each text (with an end)."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.low, self.starts, self.ends)


def words(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> Words:
    """Words never cross texts."""
    low = LOWER[data]
    inside = alphabet[low]
    before = np.empty(len(low), bool)
    after = np.empty(len(low), bool)
    if len(low):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(low))]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(low, starts, ends, np.searchsorted(starts, offsets))


def loads(low: np.ndarray) -> np.ndarray:
    """View whose element p holds the eight bytes from p, little-endian; bytes after the end are 0."""
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    return np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same in every process and batch."""
    at = loads(low)
    left = ends - starts
    h = left.astype(U64) * _C2
    h = mix(h ^ (at[starts] & _MASK[np.minimum(left, 8)]))
    live = np.flatnonzero((left > 8) & (left <= 256))
    done = 8
    while len(live):
        rest = left[live] - done
        h[live] = mix(h[live] ^ (at[starts[live] + done] & _MASK[np.minimum(rest, 8)]))
        live = live[rest > 8]
        done += 8
    for k in np.flatnonzero(left > 256):
        h[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of the ranges start .. start + length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    heads = np.cumsum(lengths) - lengths
    return np.repeat(starts - heads, lengths) + np.arange(total)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[k]:first[k + 1]] for each k; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]
