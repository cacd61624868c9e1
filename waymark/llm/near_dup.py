"""MinHash near-dedup by an inverted join over signature coordinates.

1. One pass turns each text into its set of k-word shingles (64-bit hashes), a signature of `coords` minima and a
   128-bit name of the set. Texts with equal sets form a class; from here on only classes are compared.
2. A class posts itself under its (coordinate, value) pairs. Pairs that no other class has can't collide. Two classes
   with at least `matches` equal coordinates share one of the `coords - matches + 1` rarest pairs of either (prefix), so
   only these are joined; the long lists of frequent pairs are skipped and count only in the check of the full
   signatures. A class with fewer than `matches` shared pairs drops out before any join.
3. Posting lists of up to `small` classes are joined within themselves. In a longer list every class is compared with
   the list's most central class (its pivot). Classes linked to the pivot are connected by that and need no comparison
   among themselves. Where some class isn't linked to its pivot, it alone is compared with the list's other classes: all
   carry their differences to the pivot, from which similarities follow exactly, and are dealt into blocks of at most
   about `block` classes a side, so that no task gets a whole list. A block emits a spanning forest of the links it
   finds, never its pairs.
4. All links are confirmed on the full sets: 100 * intersection >= 100 s * union. Components give the answer.

With 32 coordinates and 16 matches a pair of similarity 0.8 is missed with probability below 1e-4.

Defined cases: null and empty texts have no shingles, link with nothing and are their own component. Equal sets have
similarity 1. The id that stands for a component is its smallest; null ids count as larger than any, and a component
with only null ids has a null one. Repeated rows fall into one class; rows that repeat the smallest id are all marked as
kept, and the dropping form leaves one of them. Rows are decided by id and text together, so that an id with several
texts loses only copies. Very long texts are read whole; an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, hashed_words, hot_join, keep_decided, materialize, salted_join, shingle_hashes, ship_code
from .components import components

_COORDINATES = np.random.default_rng(811).integers(0, 2**63, (2, 256), dtype=np.uint64)


def _signature(found: np.ndarray, coords: int) -> np.ndarray:
    """Least values of the set under `coords` hash functions, as 32-bit numbers."""
    factor, shift = _COORDINATES[0, :coords] * U64(2) + U64(1), _COORDINATES[1, :coords]
    out = np.full(coords, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 4096):
        out = np.minimum(out, (found[at : at + 4096, None] * factor + shift).min(axis=0))
    return (out >> U64(32)).astype(np.uint32).view(np.int32)


def _name(found: np.ndarray) -> bytes:
    """128 bits that name the set, from sums that don't depend on order."""
    a, b = found.sum(dtype=np.uint64), (found * (found >> U64(7) | U64(1))).sum(dtype=np.uint64)
    return np.array([a ^ U64(len(found)), b], np.uint64).tobytes()


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, bounds, words in hashed_words(column):
        for i in range(len(bounds) - 1):
            yield row + i, np.unique(shingle_hashes(words[bounds[i] : bounds[i + 1]], k))


def _sign(batches: Iterator[pa.RecordBatch], k: int, coords: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, names, signs = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows, []
        for i, found in _sets(batch.column(2), k):
            sizes[i] = len(found)
            if len(found):
                names[i] = _name(found)
                signs.append(_signature(found, coords))
        ends = np.concatenate(([0], np.cumsum((sizes > 0) * coords))).astype(np.int32)
        values = pa.array(np.concatenate(signs) if signs else np.zeros(0, np.int32), pa.int32())
        columns = [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), values)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "key", "cls", "n_shingles", "sig"])


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(cls, hashes) of the rows (cls, text) whose text has the set that cls names."""
    for batch in batches:
        wanted, names, found = batch.column(0).to_pylist(), [], []
        for i, hashes in _sets(batch.column(1), k):
            if len(hashes) and _name(hashes) == wanted[i]:
                names.append(wanted[i])
                found.append(hashes.view(np.int64))
        ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)], ["cls", "hashes"])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text); key, a digest of the text, tells rows apart where ids are null or repeated."""
    return df.select(df[id_col].alias("id"), text_key(df[text_col]).alias("key"), df[text_col].alias("text"))


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _ordered() -> Column:
    """By what the row that stands for others is least: null ids last."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))


def _postings(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """(g, c, n, keys): each class under its rarest shared coordinate-value pairs; keys: all that it shares with others."""
    key = F.shiftleft(F.col("coord").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    posted = classes.select("cls", "n_shingles", F.posexplode("sig").alias("coord", "value")).select("cls", "n_shingles", key.alias("g"))
    shared = posted.groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select(F.col("g").alias("k"), "df")
    listed = (
        hot_join(posted, materialize(shared, "shared"), "g", "k", "df")
        .groupBy("cls", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("found"))  # at most `coords` of them
        .filter(F.size("found") >= matches)
    )
    return listed.select(
        "cls", "n_shingles", F.col("found.g").alias("keys"), F.explode(F.slice("found.g", 1, F.size("found") - (matches - 1))).alias("g")
    ).select("g", F.col("cls").alias("c"), F.col("n_shingles").alias("n"), "keys")


def _pairs_within(posts: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b) of classes in one list with `matches` equal coordinates or more."""
    left = posts.select(F.col("g").alias("ga"), F.col("c").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    right = posts.select(F.col("g").alias("gb"), F.col("c").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    alike = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    on = (F.col("ga") == F.col("gb")) & (F.col("a") < F.col("b")) & alike & (F.size(F.array_intersect("ka", "kb")) >= matches)
    return left.join(right, on).select("a", "b").distinct()


def _split_lists(posts: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Postings of the lists of 2 to `small` classes, and (pivot, c) of the longer lists."""
    sizes = posts.groupBy("g").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("g").alias("k"), "size")
    sized = hot_join(posts, materialize(sizes, "sizes"), "g", "k", "size").drop("k")
    long = materialize(sized.filter(F.col("size") > small).select("g", "c", "size"), "long_lists")
    central = long.groupBy("c").agg(F.count(F.lit(1)).alias("lists")).select(F.col("c").alias("x"), "lists")
    pivots = (
        long.join(central, F.col("c") == F.col("x"))
        .groupBy("g")
        .agg(F.max(F.struct("lists", "c"))["c"].alias("pivot"), F.max("size").alias("weight"))
        .select(F.col("g").alias("k"), "pivot", "weight")
    )
    stars = hot_join(long, materialize(pivots, "pivots"), "g", "k", "weight").select("pivot", "c").filter("pivot != c").distinct()
    return sized.filter(F.col("size") <= small), stars


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs (a written table) with the sets of both; the a side may be hot."""
    one = salted_join(pairs, sets.select(F.col("cls").alias("x"), F.col("hashes").alias("ha")), {a: "x"}, F.col(b)).drop("x")
    return one.join(sets.select(F.col("cls").alias("x"), F.col("hashes").alias("hb")), F.col(b) == F.col("x")).drop("x")


def _linked(percent: int) -> Column:
    both = F.size(F.array_intersect("ha", "hb"))
    return both * 100 >= (F.size("ha") + F.size("hb") - both) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _with_sets(pairs, sets, "a", "b").filter(_linked(percent)).select("a", "b")


def _compared(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, n, diff): pivot, class, whether they are linked, size of the class's set, its difference to the pivot's."""
    both = _with_sets(stars.select(F.col("pivot").alias("a"), F.col("c").alias("b")), sets, "a", "b")
    diff = F.concat(F.array_except("ha", "hb"), F.array_except("hb", "ha"))
    return both.select("a", "b", _linked(percent).alias("linked"), F.size("hb").alias("n"), diff.alias("diff"))


def _blocks(compared: DataFrame, block: int) -> DataFrame:
    """Rows of compared by (a, i, j): those to be compared further (asks), and all of the pivot's, once for each partner block."""
    counts = compared.groupBy("a").agg(F.count_if(~F.col("linked")).alias("asking"), F.count(F.lit(1)).alias("all")).filter("asking > 0")
    counts = counts.select(F.col("a").alias("k"), F.ceil(F.col("asking") / block).alias("rows"), F.ceil(F.col("all") / block).alias("columns"), "all")
    dealt = hot_join(compared, materialize(counts, "counts"), "a", "k", "all").drop("k", "all")
    asking = dealt.filter("not linked").select(
        "a", F.pmod(F.xxhash64("b"), "rows").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("j"), F.lit(True).alias("asks"), "b", "n", "diff"
    )
    asked = dealt.select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), F.pmod(F.xxhash64("b", F.lit(1)), "columns").alias("j"), F.lit(False).alias("asks"), "b", "n", "diff"
    )
    return asking.unionByName(asked)


def _forest(table: pa.Table, percent: int) -> pa.Table:
    """Spanning links between the asking classes and the others of one block."""
    names, sizes, lists = table.column("b").to_pylist(), table.column("n").to_numpy(), table.column("diff").combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    _, tokens = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    rows = np.repeat(np.arange(len(names)), lengths)
    asks = np.asarray(table.column("asks").combine_chunks().to_numpy(zero_copy_only=False), bool)
    ask, other = np.flatnonzero(asks), np.flatnonzero(~asks)
    shared = np.zeros((len(ask), len(other)), np.float32)
    for at in range(0, int(tokens.max(initial=-1)) + 1, 8192):  # columns of the incidence matrix in strips
        inside = (tokens >= at) & (tokens < at + 8192)
        strip = np.zeros((len(names), 8192), np.float32)
        strip[rows[inside], tokens[inside] - at] = 1
        shared += strip[ask] @ strip[other].T
    apart = lengths[ask][:, None] + lengths[other][None, :] - 2 * shared.astype(np.int64)
    total = sizes[ask].astype(np.int64)[:, None] + sizes[other][None, :]
    linked = (total - apart) * 100 >= (total + apart) * percent
    links, rows_left, columns_left = [], np.ones(len(ask), bool), np.ones(len(other), bool)
    for root in range(len(ask)):
        front = [root] if rows_left[root] else []
        rows_left[root] = False
        while front:
            r = front.pop()
            for c in np.flatnonzero(linked[r] & columns_left):
                columns_left[c] = False
                links.append((names[ask[r]], names[other[c]]))
                more = np.flatnonzero(linked[:, c] & rows_left)
                rows_left[more] = False
                links += [(names[ask[x]], names[other[c]]) for x in more]
                front += more.tolist()
    return pa.table({"a": pa.array([x for x, y in links if x != y], pa.binary()), "b": pa.array([y for x, y in links if x != y], pa.binary())})


def near_dup_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, coords: int = 32, matches: int = 16, small: int = 16, block: int = 256
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: id, key, cls, n_shingles; classes: cls, rep; links: a, b between classes); rep: (none, id, key) of the least row."""
    ship_code(df.sparkSession)
    keyed = _keyed(df, id_col, text_col)
    id_type = keyed.schema["id"].dataType.simpleString()
    rows = materialize(
        keyed.mapInArrow(partial(_sign, k=k, coords=coords), f"id {id_type}, key string, cls binary, n_shingles long, sig array<int>"), "signed"
    )
    classes = materialize(
        rows.filter("n_shingles > 0").groupBy("cls", "n_shingles").agg(F.min(_ordered()).alias("rep"), F.any_value("sig").alias("sig")), "classes"
    )
    few, stars = _split_lists(materialize(_postings(classes, coords, matches), "postings"), small)
    pairs, stars = materialize(_pairs_within(few, percent, matches), "pairs"), materialize(stars, "stars")
    ends = [x.select(F.col(c).alias("want")) for x, c in ((pairs, "a"), (pairs, "b"), (stars, "pivot"), (stars, "c"))]
    wanted = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct()
    wanted = classes.join(wanted, F.col("cls") == F.col("want")).select("cls", F.col("rep.id").alias("want_id"), F.col("rep.key").alias("want_key"))
    texts = keyed.join(wanted, (F.col("key") == F.col("want_key")) & F.col("id").eqNullSafe(F.col("want_id"))).select("cls", "text")
    sets = texts.mapInArrow(partial(_full_sets, k=k), "cls binary, hashes array<long>")
    sets = materialize(sets.dropDuplicates(["cls"]), "sets")  # rows may repeat id and text
    compared = materialize(_compared(stars, sets, percent), "compared")

    def forest(table: pa.Table) -> pa.Table:
        return _forest(table, percent)

    further = _blocks(compared, block).groupBy("a", "i", "j").applyInArrow(forest, "a binary, b binary")
    links = _confirmed(pairs, sets, percent).unionByName(compared.filter("linked").select("a", "b")).unionByName(further)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return rows, classes.select("cls", "rep"), materialize(links, "links")


def _decided(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id, key, n_shingles, least: the least row of the component, null where there are no shingles) for each row of df."""
    rows, classes, links = near_dup_classes(df, id_col, text_col, **how)
    roots = components(links, "a", "b")
    named = materialize(classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("weight")).select(F.col("root").alias("r"), "least", "weight")
    told = hot_join(named, materialize(least, "least"), "root", "r", "weight").select(F.col("cls").alias("c"), "least")
    told = materialize(told, "told")
    return rows.join(told, F.col("cls") == F.col("c"), "left").select("id", "key", "n_shingles", "least")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id, kept."""
    component = F.when(F.col("n_shingles") > 0, F.col("least.id")).otherwise(F.col("id"))
    return _decided(df, id_col, text_col, **how).select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df with one row of each component, its least by (id, text digest), and all rows without words; all columns stay."""
    has, least = F.col("n_shingles") > 0, F.col("least")
    kept = ~has | (F.col("id").eqNullSafe(least["id"]) & (F.col("key") == least["key"]))
    decided = _decided(df, id_col, text_col, **how).select("id", "key", kept.alias("kept"), has.alias("once"))
    return keep_decided(df, id_col, text_key(df[text_col]), materialize(decided, "decided"))
