"""Ranked lexical search over all documents, with bags scored once.

1. One pass reduces each document to its number of terms and its term frequencies within the vocabulary of the items.
   The number of documents with terms, the number of all terms and the document frequencies of the vocabulary come from
   that written table.
2. Documents with equal frequencies and equal length norm have equal scores on every item. They form a class: grouped by
   a hash, with the frequencies and the norm as further keys, so that equality is verified and not presumed. A class
   knows its smallest id.
3. Each task scores its classes against all items at once and hands on the `top` best of each item, by score and then
   smallest id. A document among the best of an item is in such a class: any class before its own has a member that
   comes before all of its own.
4. Only the chosen classes are expanded: their members with the smallest ids, `top` at most, are found by hash, verified
   on the frequencies, and cut before they are shuffled, however large a class is.

The items are the stated queries. They pass in blocks of at most `block` (item, term) pairs, so that what a task holds of
them, and what is broadcast, is bounded; a single item with more terms is a block of its own.

Defined cases: a null or empty text, and one without terms, is no document in any count and is never found. Rows that
repeat an item id are one item with the terms of all; an item without terms finds nothing. Repeated document ids are
documents of their own, and all are found. Ids are integers; null ids come after all others. Very long texts are read
whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_code
from .terms import WORD_CHARACTERS, coded_terms

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = 2**63 - 1


def _bags(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    """(id, n, codes, tfs) of the rows (id, text) that have terms; codes: places in the vocabulary, ascending."""
    size = max(len(vocabulary), 1)
    for batch in batches:
        for row, bounds, terms in coded_terms(batch.column(1), WORD_CHARACTERS):
            n = np.diff(bounds)
            known = pc.index_in(terms.dictionary, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            codes = known[terms.indices.to_numpy()] if len(terms) else np.zeros(0, np.int32)
            keys, tfs = np.unique((np.repeat(np.arange(len(n)), n) * size + codes)[codes >= 0], return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(keys // size, minlength=len(n)))))
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (keys % size, tfs)]
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n.astype(np.int64)), *lists], ["id", "n", "codes", "tfs"])
            yield out.filter(pa.array(n > 0))


class _Best:
    """The best `top` rows of each item so far, by score, then smallest id."""

    def __init__(self, items: int, top: int):
        self.top, self.least, self.rows, self.waiting = top, np.zeros(items, np.int64), [np.zeros(0, np.int64)] * 4, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> None:
        """scores: a row for each class, a column for each item."""
        at, item = np.nonzero((scores > 0) & (scores >= self.least))
        self.parts.append((item, scores[at, item], ids[at], classes[at]))
        self.waiting += len(at)
        if self.waiting > 1 << 18:
            self.settle()

    def settle(self) -> None:
        item, score, ids, classes = (np.concatenate(x) for x in zip(self.rows, *self.parts, strict=True))
        order = np.lexsort((ids, -score, item))
        first = np.searchsorted(item[order], item[order])
        order = order[np.arange(len(order)) - first < self.top]
        self.rows, self.parts, self.waiting = [x[order] for x in (item, score, ids, classes)], [], 0
        found = np.bincount(self.rows[0], minlength=len(self.least))
        full = np.flatnonzero(found >= self.top)
        self.least[full] = self.rows[1][np.cumsum(found)[full] - 1]


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, starts: np.ndarray, of: np.ndarray, items: int, top: int, cells: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """(item, score, least, cls): the best classes of this task for each item.

    The items of vocabulary code c are of[starts[c]:starts[c + 1]]. Classes are scored in runs of at most about `cells`
    scores and as many single contributions.
    """
    best, many = _Best(items, top), np.diff(starts)
    for batch in batches:
        classes, ids, m = (batch.column(k).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        lists = batch.column(3)
        lengths = np.asarray(lists.value_lengths())
        codes, tf = (np.asarray(batch.column(k).flatten()).astype(np.int64) for k in (3, 4))
        rows = np.repeat(np.arange(len(lengths)), lengths)
        worth = weights[codes] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[rows]))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        work = np.concatenate(([0], np.cumsum(many[codes])))[ends]  # contributions before each class
        row = 0
        while row < len(lengths):
            end = min(max(row + 1, int(np.searchsorted(work, work[row] + cells, "right")) - 1), row + max(1, cells // max(items, 1)))
            part = slice(ends[row], ends[end])
            each = many[codes[part]]
            place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[codes[part]], each)
            scores = np.zeros((end - row) * items, np.int64)
            np.add.at(scores, np.repeat(rows[part] - row, each) * items + of[place], np.repeat(worth[part], each))
            best.add(scores.reshape(end - row, items), ids[row:end], classes[row:end])
            row = end
    best.settle()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows], ["item", "score", "least", "cls"])


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term), each once."""
    found = F.regexp_extract_all(F.translate(items[text_col], UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(items[id_col].alias("item"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def _blocks(pairs: DataFrame, block: int) -> Iterator[list[tuple]]:
    """Runs of whole items of at most `block` (item, term) pairs; only a run at a time reaches the driver."""
    part: list[tuple] = []
    item: list[tuple] = []
    for row in pairs.orderBy("item", "term").toLocalIterator():
        if item and row["item"] != item[0][0]:
            if part and len(part) + len(item) > block:
                yield part
                part = []
            part, item = part + item, []
        item.append((row["item"], row["term"]))
    if part and len(part) + len(item) > block:
        yield part
        part = []
    if part or item:
        yield part + item


def _ranked(docs: DataFrame, block: list[tuple], item_type: str, top: int) -> DataFrame:
    """(name, rank, id, score) of one block of items."""
    spark = docs.sparkSession
    names = list(dict.fromkeys(x for x, _ in block))
    words = sorted({x for _, x in block})
    place = {x: k for k, x in enumerate(words)}
    numbers = {x: k for k, x in enumerate(names)}
    asked = sorted((place[term], numbers[item]) for item, term in block)
    starts = np.searchsorted(np.array([c for c, _ in asked]), np.arange(len(words) + 1))
    of = np.array([i for _, i in asked], np.int64)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _bags(batches, pa.array(words, pa.large_string()))

    counted = materialize(docs.mapInArrow(bags, "id long, n long, codes array<int>, tfs array<int>"), "bags")
    totals = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    weights = np.zeros(len(words), np.int64)
    w = F.floor(1000 * F.log((F.lit(2.0) * totals["docs"] + 2) / (2 * F.col("df") + 1)))
    held = counted.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    for code, weight in held.select("code", w.cast("long")).toLocalIterator():  # as many as the block has terms
        weights[code] = weight

    norm = F.call_function("div", F.col("n").cast("decimal(19,0)") * F.lit(50 * totals["docs"]).cast("decimal(19,0)"), F.lit(max(totals["all"], 1)).cast("decimal(19,0)"))
    found = counted.filter(F.size("codes") > 0).select("id", "codes", "tfs", (100 - 50 + norm).cast("long").alias("m"))
    found = found.withColumn("hash", F.xxhash64("codes", "tfs", "m"))
    same = ["hash", "m", "codes", "tfs"]
    classes = found.groupBy(*same).agg(F.min("id").alias("least"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(batches, weights, starts, of, len(names), top)

    best = classes.select("cls", "least", "m", "codes", "tfs").mapInArrow(score, "item long, score long, least long, cls long")
    by_item = Window.partitionBy("item")
    chosen = best.withColumn("place", F.row_number().over(by_item.orderBy(F.desc("score"), "least", "cls"))).filter(F.col("place") <= top)
    chosen = materialize(chosen.select("item", "score", "cls"), "chosen")
    wanted = materialize(classes.join(chosen.select("cls").distinct(), "cls", "left_semi").select("cls", *same), "wanted")
    hashes = F.broadcast(wanted.select("hash").distinct())  # at most `top` numbers for each item of the block
    members = found.join(hashes, "hash", "left_semi")
    order = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("id").asc_nulls_last()))
    members = members.withColumn("place", order).filter(F.col("place") <= top).drop("place").join(wanted, same).select("cls", "id")
    full = chosen.join(members, "cls").withColumn("rank", F.row_number().over(by_item.orderBy(F.desc("score"), F.col("id").asc_nulls_last())))
    told = spark.createDataFrame(list(enumerate(names)), f"item long, name {item_type}")
    return full.filter(F.col("rank") <= top).join(told, "item").select("name", "rank", "id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = 50, block: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item with a score above 0."""
    ship_code(docs.sparkSession)
    asked = materialize(item_terms(items, item_id, item_text), "item_terms")
    read = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id].dataType.simpleString()
    out = None
    for part in _blocks(asked, block):
        found = _ranked(read, part, item_type, top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"name {item_type}, rank int, id long, score long")
    return out.select(F.col("name").alias(item_id), "rank", F.col("id").cast(id_type).alias(id_col), "score")
