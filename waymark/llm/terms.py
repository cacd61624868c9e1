"""Maximal runs of chosen bytes as dictionary-coded terms, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import string_buffers

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # only A-Z


def byte_class(*runs: tuple[int, int]) -> np.ndarray:
    """Which bytes a term may hold, from inclusive runs; all bytes of characters beyond ASCII are in."""
    inside = np.zeros(256, bool)
    inside[128:] = True
    for first, last in runs:
        inside[first : last + 1] = True
    return inside


LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
WORD_CHARACTERS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


def coded_terms(column: pa.Array, inside: np.ndarray, chunk: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, pa.DictionaryArray]]:
    """(first row, term bounds by row, terms) for runs of rows of about chunk bytes; a longer text makes a run of its own.

    The terms of a run are one dictionary array, so that each different term of the run is handled as a string once.
    """
    offsets, data = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        part = _FOLD[data[offsets[row] : offsets[end]]]
        local = offsets[row : end + 1] - offsets[row]
        solid = inside[part]
        first = np.zeros(len(part) + 1, bool)
        first[local] = True
        before = np.concatenate(([False], solid[:-1])) if len(part) else solid
        after = np.concatenate((solid[1:], [False])) if len(part) else solid
        starts = np.flatnonzero(solid & (~before | first[:-1]))
        ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(part[solid].tobytes()))
        yield row, np.searchsorted(starts, local), terms.dictionary_encode()
        row = end
