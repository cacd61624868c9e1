"""Character n-grams (one to three) of words as packed 63-bit numbers, counted with array operations."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code

BITS, MASK = 21, (1 << 21) - 1
SPACE = 32


@cache
def _letters() -> np.ndarray:
    """By code point: 2 a letter, 1 a mark that belongs to one, 0 all else."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        kinds[c] = 2 if kind == "L" else kind == "M"
    return kinds


def grams(text: str) -> tuple[np.ndarray, bool]:
    """All n-grams of the lower-cased words with one space around each word, and whether there is a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    kinds = _letters()[codes]
    if not (kinds == 2).any():
        return np.zeros(0, np.int64), False
    word = kinds > 0
    before = np.concatenate(([False], word[:-1]))
    keep = word | before
    run = np.concatenate(([SPACE], np.where(word, codes, SPACE)[keep], [SPACE])).astype(np.int64)
    if run[-2] == SPACE:
        run = run[:-1]
    one = run[run != SPACE] << (2 * BITS)
    two = (run[:-1] << (2 * BITS)) | (run[1:] << BITS)
    three = two[:-1] | run[2:]
    return np.concatenate((one, two, three)), True


def unpack(gram: int) -> str:
    return "".join(chr(c) for c in (gram >> (2 * BITS), gram >> BITS & MASK, gram & MASK) if c)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                found, _ = grams(text.as_py())
                held.setdefault(label, []).append(np.unique(found, return_counts=True))
                if len(held[label]) >= 256:
                    held[label] = [_merge(held[label])]
    for label, parts in held.items():
        keys, counts = _merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["label", "gram", "n"])


def gram_counts(df: DataFrame) -> DataFrame:
    """(label, gram, n) over a table (label string, text string): counted in each task, then summed."""
    ship_code(df.sparkSession)
    return df.mapInArrow(_count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
