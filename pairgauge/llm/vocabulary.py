"""Words of Arrow text slices as exact codes into a local dictionary, for operators that count words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def coded(
    data: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, pa.Array]:
    """The code of every word and the words by code; the ranges are all maximal runs of ``kind``.

    Only bytes inside words are kept, so word k ends where word k + 1 begins and Arrow's own
    dictionary, which compares whole values, can do the work.
    """
    size = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=size[1:])
    inside = data[kind[data]]
    column = pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(size), pa.py_buffer(inside)]
    ).dictionary_encode()
    codes = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, column.dictionary
