"""Documents, evidence and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space, fold, named_elsewhere
from ..sources.shared import written


def pending_documents(docs: DataFrame) -> DataFrame:
    """Documents that nothing was extracted from yet, oldest fetch first within each source."""
    return docs.filter("extracted_at is null").orderBy("source_id", "fetched_at", "document_id")


def memo_antijoin(texts: DataFrame, memo: DataFrame, version: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(work list, hits): inputs whose key of content, version and model is not in the memo, and the stored readings."""
    key = F.sha2(F.concat_ws("|", F.sha2("text", 256), F.lit(version), F.lit(model)), 256)
    keyed = texts.withColumn("memo_key", key)
    return keyed.join(memo.select("memo_key"), "memo_key", "left_anti"), keyed.join(memo, "memo_key")


def verify_evidence(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims (document_id, evidence) with whether the evidence, spaces collapsed, stands in their document; blank fails."""
    joined = claims.join(docs.select("document_id", "text"), "document_id")
    quote = collapse_space(F.col("evidence"))
    return joined.withColumn("verified", F.coalesce((quote != "") & F.contains(collapse_space(F.col("text")), quote), F.lit(False))).drop("text")


def passages_in_documents(passages: DataFrame, docs: DataFrame, words: int = 8) -> DataFrame:
    """(item_id, doc_id) of passages that stand in documents, spaces collapsed.

    Outer words of a passage may be parts of words in a document, so runs are taken from its inner words. Of these runs of
    `words` words (or as many as it has, if fewer) the one that fewest documents have makes the candidates, which are then
    tested in full. Runs are 64-bit hashes; documents keep only those that some passage has before they are shuffled.
    A passage of one or two words has no inner word; it is looked for among the 3-character pieces of the documents.
    """
    split = passages.select("item_id", collapse_space(F.col("text")).alias("passage")).filter("passage <> ''").withColumn("w", F.split("passage", " "))
    split = split.withColumn("n", F.least(F.lit(words), F.size("w") - 2))
    bodies = docs.select("doc_id", collapse_space(F.col("text")).alias("body"))

    def grams(hashes: str, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(n, F.slice(hashes, i + 1, n)))

    inner = split.filter("n > 0").withColumn("h", F.transform(F.slice("w", 2, F.size("w") - 2), lambda x: F.xxhash64(x)))
    asked = inner.select("item_id", F.explode(F.array_distinct(grams("h", F.col("n")))).alias("gram"))
    lengths = sorted(r["n"] for r in split.filter("n > 0").select("n").distinct().collect())  # at most `words` numbers
    nothing = F.array().cast("array<bigint>")
    runs = [F.when(F.size("h") >= n, grams("h", F.lit(n))).otherwise(nothing) for n in lengths]
    # characters in place of words where there are no inner ones; shorter than three, every document is a candidate by its letters
    short = split.filter("n <= 0").select("item_id", "passage")
    three = _pieces(F.col("passage"))
    asked = asked.unionByName(short.select("item_id", F.explode(three).alias("gram")))
    needed = asked.select("gram").distinct()
    sizes = sorted(r["k"] for r in short.select(F.least(F.lit(3), F.length("passage")).alias("k")).distinct().collect())
    parts = [*runs, *(_pieces(F.col("body"), k) for k in sizes), nothing]
    hashed = bodies.withColumn("w", F.split("body", " ")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    posts = hashed.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("gram")).join(needed, "gram", "left_semi")
    posts = written(posts, "posts")
    counts = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # a run that no document has rules its passage out
    rarest = asked.join(counts, "gram", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).filter("r.df > 0")
    hits = rarest.select("item_id", F.col("r.gram").alias("gram")).join(posts, "gram").select("item_id", "doc_id")
    tested = hits.join(split.select("item_id", "passage"), "item_id").join(bodies, "doc_id")
    return tested.filter(F.contains("body", F.col("passage"))).select("item_id", "doc_id").distinct()


def _pieces(text: Column, k: int = 3) -> Column:
    """Hashes of the runs of k characters, or of the whole text if it is shorter."""
    n = F.least(F.lit(k), F.length(text))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.xxhash64(n, F.substr(text, i, n)))).otherwise(F.array().cast("array<bigint>"))


def relevance_gate(links: DataFrame, column: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(links whose folded text fits the pattern, number of kept and skipped ones by page)."""
    fits = F.coalesce(fold(F.col(column)).rlike(pattern), F.lit(False))
    counted = links.groupBy("page_id").agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("skipped"))
    return links.filter(fits), counted


def dictionary_mentions(docs: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """(doc_id, feature_id, place) for each pattern of an ordered dictionary that a folded text holds, each feature once.

    A text that names a place outside the region mentions nothing."""
    flat = docs.filter(~F.coalesce(named_elsewhere(F.col("text")), F.lit(False))).select("doc_id", fold(F.col("text")).alias("flat"))
    hits = F.array_compact(F.array(*(F.when(F.col("flat").rlike(p), F.lit(f)) for f, p in patterns)))
    return flat.select("doc_id", F.posexplode(F.array_distinct(hits)).alias("place", "feature_id"))


def first_claim_wins(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Within a document, the first sentence of each key."""
    place = F.row_number().over(Window.partitionBy("doc_id", *keys).orderBy("place"))
    return sentences.withColumn("nth", place).filter("nth = 1").drop("nth")


def cap_links(links: DataFrame, most: int = 25) -> DataFrame:
    """The first `most` links of each page in page order, with how many were cut."""
    w = Window.partitionBy("page_id").orderBy("place")
    return (
        links.withColumns({"nth": F.row_number().over(w), "total": F.count(F.lit(1)).over(Window.partitionBy("page_id"))})
        .filter(F.col("nth") <= most)
        .withColumn("cut", F.greatest(F.col("total") - most, F.lit(0)))
        .drop("total")
    )


def validate_claims(raw: DataFrame, docs: DataFrame, types: tuple[str, ...], statuses: tuple[str, ...]) -> DataFrame:
    """Raw claims with the first reason that rejects each; null passes."""
    joined = raw.join(docs.select("document_id", collapse_space(F.col("text")).alias("body")), "document_id", "left")
    quote, mention = collapse_space(F.col("evidence")), collapse_space(F.col("mention"))
    said = collapse_space(F.coalesce("dates_text", F.lit(""))) if "dates_text" in raw.columns else F.lit("")
    reason = (
        F.when(F.coalesce(quote, F.lit("")) == "", "no evidence")
        .when(~F.coalesce(F.contains("body", quote), F.lit(False)), "evidence not in document")
        .when(F.col("type").isNull() | ~F.col("type").isin(*types), "unknown type")
        .when(F.col("status").isNull() | ~F.col("status").isin(*statuses), "unknown status")
        .when(F.coalesce(mention, F.lit("")) == "", "no mention")
        .when(~F.contains(fold(F.col("body")), fold(mention)), "mention not in document")
        .when((said != "") & ~F.contains(quote, said), "dates outside the evidence")
        .when(F.col("severity").isNull() | ~F.col("severity").between(0, 3), "severity out of range")
    )
    return joined.withColumn("reject_reason", reason).drop("body")


def unknown_values(items: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Raw values outside the vocabulary with their counts."""
    return items.filter(F.col(column).isNotNull() & ~F.col(column).isin(*vocabulary)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def text_length_gate(pages: DataFrame, most: int = 20_000, least: int = 400) -> DataFrame:
    """Prose cut to `most` characters; pages under `least` are left out."""
    return pages.filter(F.length("prose") >= least).withColumn("prose", F.substring("prose", 1, most))
