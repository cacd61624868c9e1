"""Shared pieces: durable intermediate tables, vectorised word hashing, the document columns of the given tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ship_code, written

#: The white space of every word rule in this subpackage: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, a lost executor costs a reread only."""
    ship_code(df.sparkSession)
    return written(df, name, free=False)  # as the figures of the check tool were taken


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, with as many underscores as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_decided(df: DataFrame, id_col: str, key: Column, decided: DataFrame) -> DataFrame:
    """The rows of df that `decided` (id, key, kept, once) keeps; all columns stay.

    Rows are told apart by id and key, a null id being an id of its own. Of kept rows with equal id and key one stays where
    `once` is true, else all.
    """
    k, a, b = free_names(df, "key_", "decided_id", "decided_key")

    def side(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").alias(a), F.col("key").alias(b)).distinct()

    lost = side(decided.filter("not kept"))
    repeated = materialize(side(decided.filter("kept and once").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), "repeated")
    keyed = df.withColumn(k, key)
    same = keyed[id_col].eqNullSafe(F.col(a)) & (keyed[k] == F.col(b))
    left = keyed.join(lost, same, "left_anti")
    if not repeated.isEmpty():
        left = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates([id_col, k]))
    return left.drop(k)


HOT = 1000


def hot_join(left: DataFrame, right: DataFrame, on: str, key: str, weight: str) -> DataFrame:
    """left joined to right, which has one row for each key and, as `weight`, its number of rows in left.

    Keys with more than a HOT-th of all rows, fewer than HOT of them whatever the input, are broadcast, so that their rows
    are never dealt by key. Both tables should be written ones.
    """
    least = left.count() // HOT
    hot, same = F.broadcast(right.filter(F.col(weight) > least)), F.col(on) == F.col(key)
    return left.join(hot, same).unionByName(left.join(hot.select(key), same, "left_anti").join(right.filter(F.col(weight) <= least), same))


def salted_join(left: DataFrame, right: DataFrame, on: dict[str, str], spread: Column, parts: int = 256) -> DataFrame:
    """left joined to right on left names to right names; rows of a hot key are dealt over several tasks by `spread`.

    A key with more than a HOT-th of left's rows is hot; there are fewer than HOT, and their number of salts is broadcast.
    The rows of right with a hot key are repeated once for each salt. left should be a written table.
    """
    total = left.count()
    names, (salt, many) = list(on), free_names(left, "salt_", "many_")
    hot = left.groupBy(*names).agg(F.count(F.lit(1)).alias(many)).filter(F.col(many) > total // HOT)
    hot = materialize(hot.select(*(F.col(x).alias(f"hot_{x}") for x in names), F.ceil(F.col(many) * parts / max(total, 1)).alias(many)), "hot_keys")

    def marked(rows: DataFrame, columns: list[str]) -> DataFrame:
        same = [F.col(c) == F.col(f"hot_{x}") for c, x in zip(columns, names, strict=True)]
        return rows.join(F.broadcast(hot), same, "left").drop(*(f"hot_{x}" for x in names))

    one, other = marked(left, names), marked(right, list(on.values()))
    one = one.withColumn(salt, F.when(F.col(many).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col(many)))).drop(many)
    other = other.withColumn("right_salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(many) - 1, F.lit(0).cast("long"))))).drop(many)
    return one.join(other, [F.col(a) == F.col(b) for a, b in on.items()] + [F.col(salt) == F.col("right_salt_")]).drop(salt, "right_salt_")


def held_out(doc_id):
    """True for the fifth of the rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z, nothing else is folded
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_STEP_BACK = pow(_STEP, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _STEP_BACK)):
            out = np.full(max(n, 1 << 19), base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, UTF-8 bytes) of a string column; nulls become empty texts."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def hashed_words(column: pa.Array, chunk: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word bounds by row, 64-bit word hashes) for runs of rows of about chunk bytes; A-Z are folded.

    The hash of a word is a polynomial over its bytes from prefix sums modulo 2**64, so that a whole run of rows takes a
    few array operations. Rows without words have equal bounds.
    """
    offsets, data = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        local = offsets[row : end + 1] - offsets[row]
        solid = ~_IS_SPACE[part]
        first = np.zeros(len(part) + 1, bool)
        first[local] = True
        before = np.concatenate(([False], solid[:-1])) if len(part) else solid
        after = np.concatenate((solid[1:], [False])) if len(part) else solid
        starts = np.flatnonzero(solid & (~before | first[:-1]))
        ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        forth, back = _power(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * forth[:-1], dtype=np.uint64)))
        words = _mix((sums[ends] - sums[starts]) * back[starts])
        yield row, np.searchsorted(starts, local), words
        row = end


_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of k words; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    n, k = max(1, len(words) - k + 1), min(k, len(words))
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _PLACE[j]
    return _mix(out)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, from prefix sums; fewer words make none."""
    if len(words) < n:
        return words[:0]
    forth, back = _power(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * forth[:-1], dtype=np.uint64)))
    return _mix((sums[n:] - sums[:-n]) * back[: len(words) - n + 1])
