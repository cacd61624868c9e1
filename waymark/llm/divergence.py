"""Divergence of sources by their terms, with late string materialization.

1. One pass counts each term by language and source within a task and writes (lang, source, digest, term, tf, df), a
   64-bit digest beside the string.
2. All counting shuffles read the digests, never the strings: sums by group, sums by language, terms kept by their
   number of documents. A digest that several terms share counts at least as many documents as any of them, so that no
   term is lost.
3. The least and the greatest string of each kept digest (map-side minima of kept digests only) name it, and tell where
   several terms collide. Colliding digests, and no others, are counted again by their strings.
4. Ranks of terms are cut at the value of the last place wanted, by digests; only terms at or above it get their text.
5. The value of a pair of sources is a sum over all kept terms. Terms that neither source holds are worth the same and
   are counted, terms of one source go by the histogram of their counts, and only terms of both meet in a join, whose
   keys (language, term) hold at most one row for each source.

All arithmetic is exact: products that may pass 64 bits are decimals.

Defined cases: null texts, languages and sources are empty; every row counts as a document, also where ids repeat. A group
without terms, or a language that keeps none, still has its pairs (value 0 where nothing is kept). Very long texts are
counted whole. An empty table gives no rows. Ties go by the UTF-8 order of the item. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_code
from .terms import LETTERS, coded_terms

_COUNTED = "lang string, source string, term string, tf long, df long"


class _Counts:
    """Counts by (group, term) of what a task has read since the last flush."""

    def __init__(self, most: int):
        self.most, self.groups, self.parts, self.rows = most, {}, [], 0

    def add(self, groups: np.ndarray, bounds: np.ndarray, terms: pa.DictionaryArray) -> None:
        """groups: of each row of the run."""
        n = max(len(terms.dictionary), 1)
        codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        by_doc, tf = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * n + codes, return_counts=True)
        keys, at = np.unique(groups[by_doc // n] * n + by_doc % n, return_inverse=True)
        sums = np.zeros((2, len(keys)), np.int64)
        np.add.at(sums[0], at, tf)
        np.add.at(sums[1], at, 1)
        self.parts.append((keys // n, pa.DictionaryArray.from_arrays(pa.array((keys % n).astype(np.int32)), terms.dictionary), sums))
        self.rows += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            terms = pa.chunked_array([x[1] for x in self.parts]).unify_dictionaries().combine_chunks()
            n = len(terms.dictionary)
            groups, sums = np.concatenate([x[0] for x in self.parts]), np.concatenate([x[2] for x in self.parts], axis=1)
            keys, at = np.unique(groups * n + terms.indices.to_numpy(), return_inverse=True)
            out = np.zeros((2, len(keys)), np.int64)
            np.add.at(out[0], at, sums[0])
            np.add.at(out[1], at, sums[1])
            names = list(self.groups)
            langs, sources = (pa.array([x[k] for x in names], pa.string()).take(pa.array(keys // n)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([langs, sources, terms.dictionary.take(pa.array(keys % n)).cast(pa.string()), pa.array(out[0]), pa.array(out[1])], ["lang", "source", "term", "tf", "df"])
        self.groups, self.parts, self.rows = {}, [], 0

    def group_ids(self, langs: list[str], sources: list[str]) -> np.ndarray:
        return np.fromiter((self.groups.setdefault(x, len(self.groups)) for x in zip(langs, sources, strict=True)), np.int64, len(langs))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts(1 << 20)
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, bounds, terms in coded_terms(batch.column(2), LETTERS):
            end = row + len(bounds) - 1
            counts.add(counts.group_ids(langs[row:end], sources[row:end]), bounds, terms)
            if counts.rows >= counts.most:
                yield from counts.flush()
    yield from counts.flush()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), in decimals."""
    top = F.lit(10**9).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    below = (total + 2 * kept).cast("decimal(19,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, below))


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def kept_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups: lang, source; entries: lang, source, digest, split, tf, all_tf; names: digest, name) of the kept terms.

    split is a term's text where its digest is shared by several terms, else empty.
    """
    columns = [F.coalesce(df[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = df.select(*columns)
    groups = materialize(docs.select("lang", "source").distinct(), "groups")
    digest = F.xxhash64("term").bitwiseAND(F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("long"))
    counted = materialize(docs.mapInArrow(_count, _COUNTED).withColumn("digest", digest), "counted")
    by_group = materialize(_summed(counted.select("lang", "source", "digest", "tf", "df"), "lang", "source", "digest"), "by_group")

    def kept(rows: DataFrame, *keys: str) -> DataFrame:
        return _summed(rows, "lang", *keys).filter(F.col("df") >= least_docs).select("lang", *keys, F.col("tf").alias("all_tf"))

    digests = materialize(kept(by_group, "digest"), "kept").select("digest").distinct()
    told = counted.select("digest", "term").join(digests, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("name"), F.max("term").alias("last"))
    names = materialize(told, "names")
    shared = names.filter("name != last").select("digest")
    entries = by_group.withColumn("split", F.lit(""))
    if not shared.isEmpty():
        again = _summed(counted.join(shared, "digest", "left_semi").withColumnRenamed("term", "split"), "lang", "source", "digest", "split")
        entries = materialize(entries.join(shared, "digest", "left_anti").unionByName(again), "split")
    whole = kept(entries, "digest", "split")
    return groups, materialize(entries.join(whole, ["lang", "digest", "split"]), "entries"), names.select("digest", "name")


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank for each source of each language; bits: of a term's digest."""
    ship_code(df.sparkSession)
    groups, entries, names = kept_counts(df, text_col, lang_col, source_col, least_docs, bits)
    totals = entries.groupBy("lang", "source").agg(F.sum("tf").alias("total"))
    langs = entries.select("lang", "digest", "split", "all_tf").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_tf").alias("lang_total"))
    sized = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    sized = materialize(sized.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("kept"))), "sized")
    shares = entries.join(sized, ["lang", "source"]).withColumns({"p": _share(F.col("tf"), F.col("total"), F.col("kept")), "q": _share(F.col("all_tf"), F.col("lang_total"), F.col("kept"))})
    shares = materialize(shares.select("lang", "source", "digest", "split", "tf", "p", "p0", "q"), "shares")

    other = sized.select(F.col("lang").alias("l"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    met = (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item"))
    none = _gap(F.col("p0"), F.col("q0"))
    neither = sized.join(other, met).select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * none).otherwise(0).alias("value"))
    histogram = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    alone = histogram.join(other, met).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (_gap(F.col("p"), F.col("q0")) - none)).alias("value"))
    second = shares.select(F.col("lang").alias("l"), F.col("digest").alias("d"), F.col("split").alias("s"), F.col("source").alias("item"), F.col("p").alias("p2"), F.col("p0").alias("q0"))
    in_both = (F.col("lang") == F.col("l")) & (F.col("digest") == F.col("d")) & (F.col("split") == F.col("s")) & (F.col("source") < F.col("item"))
    excess = _gap(F.col("p"), F.col("p2")) - _gap(F.col("p"), F.col("q0")) - _gap(F.col("p0"), F.col("p2")) + none
    both = shares.join(second, in_both).groupBy("lang", "source", "item").agg(F.sum(excess).alias("value"))

    def turned(rows: DataFrame) -> DataFrame:
        return rows.unionByName(rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    pairs = neither.unionByName(turned(alone)).unionByName(turned(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    scored = shares.filter("p > q").withColumn("value", _gap(F.col("p"), F.col("q")))
    within = Window.partitionBy("lang", "source")
    best = scored.withColumn("place", F.row_number().over(within.orderBy(F.desc("value"), "digest", "split"))).filter(F.col("place") <= top)
    least = best.groupBy("lang", "source").agg(F.min("value").alias("least"))
    asked = scored.join(least, ["lang", "source"]).filter("value >= least").join(names, "digest")
    terms = asked.select("lang", "source", F.when(F.col("split") == "", F.col("name")).otherwise(F.col("split")).alias("item"), "value")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        place = F.row_number().over(within.orderBy(F.desc("value"), "item"))
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), place.alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").filter(F.col("rank") <= top))
