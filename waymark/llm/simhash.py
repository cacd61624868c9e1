"""SimHash near-dedup by deletion-variant signatures.

1. One pass makes the 64-bit fingerprint of each text: bit b is set where over half of its 3-word shingles, repeats
   included, have it set in their XXH64. Equal fingerprints are one node from here on.
2. Fingerprints within `distance` 3 bits, cut into two segments of 32, have one segment that differs in at most one bit.
   Each is indexed under every segment with one bit left out (64 variants): two that link share a variant, of the bit
   that differs, or any where the segment is equal. So a variant matters only where both values of its bit occur, but for
   the first of each segment, which also serves equal segments.
3. Variants are joined by equality and verified on all 64 bits. One with two members is a pair at once, one of up to
   `small` is joined within itself. A fuller one, up to `crowd`, goes to one task, which hands on a spanning forest of its
   links, never its pairs.
4. A variant beyond `crowd` is cut further in the same way: its members agree on one segment but for a bit, and differ in
   at most three bits of the other, so that one half of it differs in at most one. Two such steps leave 11 free bits: at
   most 2,048 different fingerprints, whatever the input. So no cap is needed.
5. Components of the links give the answer.

Defined cases: a text without words, null included, has fingerprint zero, and links like any other; one with fewer than
three words has one shingle of them all. Of a component, the smallest id stands for it; null ids come last, and a
component with only null ids has a null one. Repeated rows have one fingerprint. Very long texts are read whole, in runs
of words. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, ship_code, string_buffers
from .components import components

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 32


def fingerprint(text: np.ndarray, k: int = 3, seed: int = 42, run: int = 1 << 16) -> int:
    """The fingerprint of UTF-8 bytes, as a signed 64-bit number; shingles are hashed in runs of `run`."""
    space = _SPACE[text]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]  # of each run of white space the first; none at the start
    body = _FOLD[text[keep]]
    starts = np.flatnonzero(np.concatenate(([True], body[:-1] == 32)) & (body != 32)) if len(body) else np.zeros(0, np.int64)
    if not len(starts):
        return 0
    ends = np.append(starts[1:] - 1, len(body) - (body[-1] == 32))
    n, last = max(1, len(starts) - k + 1), min(k, len(starts)) - 1
    view, ones = memoryview(body.tobytes()), np.zeros(64, np.int64)
    for at in range(0, n, run):
        to = min(at + run, n)
        hashed = [xxhash.xxh64_intdigest(view[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + last : to + last].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = string_buffers(batch.column(1))
        found = [fingerprint(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])


def _variants(rows: DataFrame, key: str, low: Column, width: int) -> DataFrame:
    """(key, fp, bit, first, rest): rows under each variant of the two halves of the 2 * width bits from `low` on.

    key: the variant, with the key that it refines; bit: the value of the bit left out; first: whether it serves equal
    segments; rest: where the other half begins.
    """
    spread = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("v"))
    half, out = F.floor(F.col("v") / width).cast("int"), F.pmod(F.col("v"), F.lit(width))
    base = low + half * width
    segment = F.call_function("shiftrightunsigned", F.col("fp"), base).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), out)
    masked = segment.bitwiseAND(F.bitwise_not(one))
    return spread.select(
        F.xxhash64(F.col(key), F.col("v"), masked).alias("key"),
        "fp",
        (segment.bitwiseAND(one) != 0).alias("bit"),
        (out == 0).alias("first"),
        (low + (1 - half) * width).cast("int").alias("rest"),
    )


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _forest(table: pa.Table, distance: int) -> pa.Table:
    """Spanning links of the fingerprints of one variant, from one row of comparisons for each."""
    fps = np.unique(table.column("fp").to_numpy())
    bits = fps.view(np.uint64)
    left, links, front = np.arange(len(fps)), [], []
    while len(left) or front:
        if not front:
            front, left = [left[0]], left[1:]
        at = front.pop()
        near = np.bitwise_count(bits[left] ^ bits[at]) <= distance
        found, left = left[near], left[~near]
        links += [(at, x) for x in found]
        front += found.tolist()
    ends = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": fps[ends[:, 0]], "b": fps[ends[:, 1]]})


def links_of(nodes: DataFrame, distance: int = 3, small: int = 32, crowd: int = 4096) -> DataFrame:
    """(a, b): links between the different fingerprints (column fp) that connect all those within `distance` bits."""
    if distance != 3:
        raise ValueError("two segments with one wildcard are for a distance of 3")

    def forest(table: pa.Table) -> pa.Table:
        return _forest(table, distance)

    rows, key, low, width = nodes.select("fp", F.lit(0).cast("long").alias("over")), "over", F.lit(0), 32
    found = None
    while True:
        posts = _variants(rows, key, low, width)
        sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.min("bit").alias("none"), F.max("bit").alias("some"), F.any_value("first").alias("first"))
        useful = materialize(sizes.filter("n > 1 and (first or none != some)").select(F.col("key").alias("k"), "n", "a", "b"), "variants")
        pairs = useful.filter("n = 2").select("a", "b")
        fuller = useful.filter("n > 2").select("k", "n")
        members = materialize(posts.join(fuller, F.col("key") == F.col("k")).select("key", "fp", "rest", "n"), "members")
        few = members.filter(F.col("n") <= small)
        one, other = few.select("key", F.col("fp").alias("a")), few.select(F.col("key").alias("k"), F.col("fp").alias("b"))
        pairs = pairs.unionByName(one.join(other, (F.col("key") == F.col("k")) & (F.col("a") < F.col("b"))).select("a", "b"))
        pairs = pairs.filter(_apart("a", "b") <= distance).distinct()
        last = width <= 8
        many = members.filter((F.col("n") > small) & (F.lit(last) | (F.col("n") <= crowd)))
        pairs = pairs.unionByName(many.select("key", "fp").groupBy("key").applyInArrow(forest, "a long, b long"))
        pairs = materialize(pairs, "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        rows = members.filter(F.col("n") > crowd).select("fp", F.col("key").alias("over"), "rest")
        if last or rows.isEmpty():
            return found
        key, low, width = "over", F.col("rest"), width // 2


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of df: id, fingerprint (16 hex digits), component_id."""
    ship_code(df.sparkSession)
    read = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    signed = materialize(read.mapInArrow(_sign, f"id {read.schema['id'].dataType.simpleString()}, fp long"), "signed")
    nodes = materialize(signed.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight")), "nodes")
    roots = components(links_of(nodes, **how), "a", "b").select("node", "root")
    named = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "weight", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    told = materialize(named.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("k"), "component_id", "weight"), "told")
    return hot_join(signed, told, "fp", "k", "weight").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
