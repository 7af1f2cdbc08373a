"""Words of whole Arrow text batches as arrays: positions, owners and 64-bit hashes, no Python strings.

A text column is one buffer of UTF-8 bytes. Separators are ASCII, so word ends can be found on bytes.
The hash of a word is a polynomial over random byte values modulo 2**64, finished with a mixer;
two words of a large vocabulary share a hash with a chance near 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: For work that holds some forty bytes per byte of a slice beside other large things.
SMALL_SLICE = 1 << 18

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_AGAIN = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but space and the five control characters from tab to carriage return.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: Digits, letters and every byte of a character beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALPHANUMERIC[_low:_high] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, content = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = max(to, at + 1)
        yield at, to
        at = to


def find(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Owner, first byte and end byte of every word; a word never crosses the end of a text."""
    n = len(data)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    each = np.diff(np.searchsorted(start, offsets))
    return np.repeat(np.arange(len(offsets) - 1), each), start, end


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, again: bool = False
) -> np.ndarray:
    """A 64-bit hash of each byte range, whatever its place; ``again`` gives an independent one."""
    up, down = _raised(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_AGAIN if again else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def together(*parts: np.ndarray) -> np.ndarray:
    """A hash of a sequence of hashes; the order counts."""
    h = np.zeros(np.shape(parts[0]), np.uint64)
    for part in parts:
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + part)
    return h


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c in counts, one after the other."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts)
