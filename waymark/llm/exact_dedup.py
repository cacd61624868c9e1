"""Exact dedup with a heavy-hitter split: frequent digests are settled map-side, the rest by an ordinary shuffle.

1. Each text is reduced to the SHA-256 of its normalised form; only (id, digest) goes on.
2. Spark's frequent-items sketch (a Misra-Gries summary, mergeable, at most `tracked` counters) proposes the `heavy`
   most frequent digests. Any digest with more than rows / heavy copies is among them.
3. Their exact counts and smallest ids come from a broadcast join with map-side aggregation. Those with at least
   `min_copies` rows are the verified winners; there are at most `heavy` of them, whatever the input.
4. Rows of a winner get their decision by a second broadcast join and never enter a shuffle. All other rows are
   shuffled by digest into one window.

Defined cases: a null text counts as empty, and all such rows form one group. A null id loses against any id. In a
group that has only null ids, and among rows that repeat the smallest id, each such row is marked as kept; the dropping
form leaves one of them. Rows are decided by id and text together, so that an id with several texts loses only copies.
Very long texts are read whole. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, keep_decided, materialize


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def frequent_digests(digests: DataFrame, heavy: int, tracked: int, min_copies: int) -> DataFrame:
    """(h_digest, h_keep, h_size) of the verified frequent digests: at most `heavy` rows."""
    top = digests.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
    proposed = top.select(F.explode("top.item").alias("h_digest"))
    return (
        digests.join(F.broadcast(proposed), F.col("digest") == F.col("h_digest"))
        .groupBy("h_digest")
        .agg(F.min("id").alias("h_keep"), F.count(F.lit(1)).alias("h_size"))
        .filter(F.col("h_size") >= min_copies)
    )


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1000, tracked: int = 8192, min_copies: int = 8
) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(df.select(df[id_col].alias("id"), text_digest(df[text_col]).alias("digest")), "digests")
    winners = F.broadcast(materialize(frequent_digests(digests, heavy, tracked, min_copies), "frequent"))
    settled = digests.join(winners, F.col("digest") == F.col("h_digest")).select("id", "digest", "h_keep", "h_size")
    of_digest = Window.partitionBy("digest")
    rest = digests.join(winners, F.col("digest") == F.col("h_digest"), "left_anti").select(
        "id",
        "digest",
        F.min("id").over(of_digest).alias("h_keep"),
        F.count(F.lit(1)).over(of_digest).alias("h_size"),
    )
    return settled.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("h_keep").alias("keep_id"),
        F.col("h_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("h_keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts: that with the smallest id, one of those that repeat it; all columns stay."""
    decided = exact_dedup(df, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("key"), "kept", F.lit(True).alias("once"))
    return keep_decided(df, id_col, text_digest(df[text_col]), materialize(decided, "decided"))
