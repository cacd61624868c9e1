"""Free-text mentions to features; what is ambiguous goes to a queue, never to a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_exact, key_loose, key_tight, names_an_approach, slugify
from ..sources.shared import written
from .similar import best_pairs, similar_pairs

TIERS = (("exact", key_exact), ("tight", key_tight), ("loose", key_loose))


def alias_index(forms: DataFrame) -> DataFrame:
    """(tier, key, feature_id, form) of name forms (feature_id, form, place): one row for each feature and key, the first form kept."""
    keyed = forms.select("feature_id", "form", "place", F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), k(F.col("form")).alias("key")) for t, k in TIERS))).alias("k"))
    keyed = keyed.select("feature_id", "form", "place", "k.tier", "k.key").filter("key <> ''")
    return keyed.groupBy("tier", "key", "feature_id").agg(F.min(F.struct("place", "form"))["form"].alias("form"))


def surface_forms(features: DataFrame, name: str = "name", localised: str | None = None, aliases: str | None = None) -> DataFrame:
    """(feature_id, form, place): default name, localised names (map) and aliases (array) as one bag."""
    parts = [F.array(F.col(name))]
    if localised:
        parts.append(F.coalesce(F.map_values(localised), F.array().cast("array<string>")))
    if aliases:
        parts.append(F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return features.select("feature_id", F.posexplode(F.concat(*parts)).alias("place", "form")).filter("form is not null")


def ambiguous_keys(index: DataFrame) -> DataFrame:
    """Keys that several features own, with how many and the smallest."""
    return index.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("owners"), F.min("feature_id").alias("first_owner")).filter("owners > 1")


def resolve_exact_tiers(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """Mentions (mention, ...) with feature_id, tier and score 100: the first tier where exactly one feature owns the key."""
    sole = index.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("owners"), F.min("feature_id").alias("owner")).filter("owners = 1")
    out = mentions
    for tier, key in TIERS:
        one = sole.filter(F.col("tier") == tier).select(F.col("key").alias(f"{tier}_key"), F.col("owner").alias(f"{tier}_owner"))
        out = out.withColumn(f"{tier}_key", key(F.col("mention"))).join(one, f"{tier}_key", "left")
    found = F.coalesce(*(F.col(f"{t}_owner") for t, _ in TIERS))
    tier = F.coalesce(*(F.when(F.col(f"{t}_owner").isNotNull(), t) for t, _ in TIERS))
    names = [f"{t}_{x}" for t, _ in TIERS for x in ("key", "owner")]
    return out.withColumns({"feature_id": found, "tier": tier, "score": F.when(found.isNotNull(), 100.0)}).drop(*names)


def similar_keys(mentions: DataFrame, index: DataFrame, floor: float = 60.0, tier: str = "loose") -> DataFrame:
    """(mention, key, score) of the tier's keys that score at least `floor` against the mention's key."""
    asked = mentions.select("mention").distinct().withColumn("m_key", dict(TIERS)[tier](F.col("mention")))
    pairs = similar_pairs(asked.select(F.col("m_key").alias("key")), index.filter(F.col("tier") == tier).select("key"), floor)
    return asked.join(pairs, F.col("m_key") == F.col("a")).select("mention", F.col("b").alias("key"), "score")


def top_candidates(pairs: DataFrame, most: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "key"))
    return pairs.withColumn("place", place).filter(F.col("place") <= most)


def best_keys(mentions: DataFrame, index: DataFrame, floor: float = 60.0, tier: str = "loose", most: int = 5) -> DataFrame:
    """top_candidates of similar_keys, without scoring every key over the floor."""
    asked = mentions.select("mention").distinct().withColumn("m_key", dict(TIERS)[tier](F.col("mention")))
    pairs = best_pairs(asked.select(F.col("m_key").alias("key")), index.filter(F.col("tier") == tier).select("key"), floor, most)
    return top_candidates(asked.join(pairs, F.col("m_key") == F.col("a")).select("mention", F.col("b").alias("key"), "score"), most)


def resolve_fuzzy(mentions: DataFrame, index: DataFrame, accept: float = 88.0, tier: str = "loose") -> DataFrame:
    """One row for each mention: feature_id if all owners of the best keys are one feature and the score is accepted; and
    the keys that came into question, best first."""
    index = written(index.filter(F.col("tier") == tier).select("tier", "key", "feature_id"), "index")
    top = best_keys(mentions, index, tier=tier).withColumn("best", F.max("score").over(Window.partitionBy("mention")))  # five at most
    top = written(top, "top")
    best = top.join(index.select("key", "feature_id"), "key").groupBy("mention").agg(
        F.max("best").alias("score"),
        F.min(F.when(F.col("score") == F.col("best"), F.col("feature_id"))).alias("low"),
        F.max(F.when(F.col("score") == F.col("best"), F.col("feature_id"))).alias("high"),
        F.count_distinct("feature_id").alias("n_candidates"),
    )
    told = best.withColumn("feature_id", F.when((F.col("score") >= accept) & (F.col("low") == F.col("high")), F.col("low"))).drop("low", "high")
    keys = top.groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("place", "key", "score"))).alias("candidates"))  # five at most
    return mentions.select("mention").distinct().join(told, "mention", "left").join(keys, "mention", "left")


def resolve_chain(mentions: DataFrame, index: DataFrame, accept: float = 88.0) -> DataFrame:
    """Mentions with feature_id, tier, score and candidates: the exact tiers, and for what these leave, a similar key of at
    least `accept` whose owners are one feature. A tie between features resolves to none of them."""
    index = written(index.select("tier", "key", "feature_id"), "index")
    exact = resolve_exact_tiers(mentions, index)
    lost = written(exact.filter("feature_id is null and mention is not null").select("mention").distinct(), "lost")
    near = written(resolve_fuzzy(lost, index, accept), "near")
    near = near.select(F.col("mention").alias("asked_"), F.col("feature_id").alias("near_"), F.col("score").alias("near_score_"), "candidates")
    joined = exact.join(near, F.col("mention") == F.col("asked_"), "left")
    by_name = F.col("feature_id").isNull() & F.col("near_").isNotNull()
    return joined.withColumns(
        {"tier": F.when(by_name, "similar").otherwise(F.col("tier")), "score": F.when(by_name, F.col("near_score_")).otherwise(F.col("score")), "feature_id": F.coalesce("feature_id", "near_")}
    ).drop("asked_", "near_", "near_score_")


def join_by_external_id(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims (source_id, external_ref) with the feature that the facts give; null goes to the queue, never to the name."""
    return claims.join(facts.select("source_id", "external_ref", "feature_id").distinct(), ["source_id", "external_ref"], "left")


def resolve_child(mentions: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions (parent_id, mention) to children of the same exact key; and new child rows for the others."""
    asked = mentions.withColumn("key", key_exact(F.col("mention")))
    children = features.filter("parent_id is not null").select("parent_id", key_exact(F.col("name")).alias("key"), "feature_id").groupBy("parent_id", "key").agg(F.min("feature_id").alias("feature_id"))
    found = asked.join(children, ["parent_id", "key"], "left")
    parents = features.select(F.col("feature_id").alias("parent_id"), slugify(F.col("name")).alias("parent_slug"))
    new = found.filter("feature_id is null").join(parents, "parent_id").select("parent_id", F.concat("parent_slug", F.lit("-"), slugify(F.col("mention"))).alias("slug")).distinct()
    return found, new


def fan_out_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (title, subtitle) to each target (title, subtitle_prefix, feature_id) of the longest prefix that fits."""
    joined = rows.join(targets, "title").filter(F.startswith("subtitle", "subtitle_prefix"))
    longest = F.max(F.length("subtitle_prefix")).over(Window.partitionBy("row_id"))
    return joined.withColumn("longest", longest).filter(F.length("subtitle_prefix") == F.col("longest")).drop("longest")


def attribute_to_site(mentions: DataFrame) -> DataFrame:
    """A resolved mention stays; an unresolved one goes to the page's own feature and says so."""
    return mentions.withColumns({"attributed_by": F.when(F.col("feature_id").isNull(), "site"), "feature_id": F.coalesce("feature_id", "site_of")})


def scoped_altitude_match(mentions: DataFrame, index: DataFrame, features: DataFrame, tolerance: int = 200, accept: float = 88.0) -> DataFrame:
    """Matches by the chain whose altitude is known on both sides and close enough; each failure has its reason."""
    told = resolve_chain(mentions, index, accept)
    found = told.join(features.select("feature_id", F.col("altitude_m").alias("own_altitude")), "feature_id", "left")
    reason = (
        F.when(F.col("feature_id").isNull(), "no match")
        .when(F.col("own_altitude").isNull() | F.col("altitude_m").isNull(), "altitude unknown")
        .when(F.abs(F.col("own_altitude") - F.col("altitude_m")) > tolerance, "altitude differs")
    )
    return found.withColumn("reason", reason)


def resolution_hooks(claims: DataFrame, policy: DataFrame, features: DataFrame, facts: DataFrame, index: DataFrame, accept: float = 88.0) -> tuple[DataFrame, DataFrame]:
    """(claims with feature_id, resolved_by and attributed_by, queue with reason and candidates): each source's own way from
    a claim to its feature.

    policy: (source_id, resolution), a source without one resolves by name. The ways, by what a claim carries: `child`
    (parent_id, mention), `slug` (slug), `external_id` (external_ref), `scoped` (mention, altitude_m), `site` (mention,
    site_of), `general` (mention).

    A site's mention that names an approach is queued before any lookup: it often holds the place's own name, and would be
    filed on the place. What is left goes by the chain of exact tiers and similar names, and what the chain leaves, to the
    page's own feature. What no way resolves is in the queue with its reason and the keys that came into question.
    """
    told = claims.join(policy, "source_id", "left").withColumn("resolution", F.coalesce("resolution", F.lit("general")))
    told = written(told, "claims")

    def of(*ways: str) -> DataFrame:
        return told.filter(F.col("resolution").isin(*ways))

    none = {"candidates": F.lit(None).cast("array<struct<place:int,key:string,score:double>>"), "attributed_by": F.lit(None).cast("string")}
    names = [*told.columns, "feature_id", "reason", *none]
    approach = (F.col("resolution") == "site") & F.coalesce(names_an_approach(F.col("mention")), F.lit(False))
    named = of("general", "site")
    kept_off = named.filter(approach).withColumns({"feature_id": F.lit(None).cast(features.schema["feature_id"].dataType), "reason": F.lit("names an approach"), **none})
    chained = resolve_chain(named.filter(~approach), index, accept)
    at_site = (F.col("resolution") == "site") & F.col("feature_id").isNull() & F.col("site_of").isNotNull()
    chained = chained.withColumns({"attributed_by": F.when(at_site, "site"), "feature_id": F.when(at_site, F.col("site_of")).otherwise(F.col("feature_id"))})
    chained = chained.withColumn("reason", F.when(F.col("feature_id").isNull(), "no match"))
    child, _ = resolve_child(of("child"), features)
    slugs = features.select(slugify(F.col("name")).alias("slug"), "feature_id").groupBy("slug").agg(F.min("feature_id").alias("feature_id"), F.count(F.lit(1)).alias("owners")).filter("owners = 1").drop("owners")
    scoped = scoped_altitude_match(of("scoped"), index, features, accept=accept).withColumn("attributed_by", none["attributed_by"])
    scoped = scoped.withColumn("feature_id", F.when(F.col("reason").isNull(), F.col("feature_id")))
    parts = [
        kept_off,
        chained,
        child.withColumns({"reason": F.when(F.col("feature_id").isNull(), "no such child"), **none}),
        of("slug").join(slugs, "slug", "left").withColumns({"reason": F.when(F.col("feature_id").isNull(), "no such slug"), **none}),
        join_by_external_id(of("external_id"), facts).withColumns({"reason": F.when(F.col("feature_id").isNull(), "unknown id"), **none}),
        scoped,
    ]
    out = parts[0].select(*names)
    for part in parts[1:]:
        out = out.unionByName(part.select(*names))
    out = written(out.withColumnRenamed("resolution", "resolved_by"), "resolved")
    return out.filter("feature_id is not null").drop("reason", "candidates"), out.filter("feature_id is null")


def open_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions that nobody has resolved or dismissed."""
    return mentions.filter("resolved_to is null and not coalesce(dismissed, false)")


def mention_queue(mentions: DataFrame, most: int = 50) -> DataFrame:
    """Open mentions, seen most often first."""
    return open_mentions(mentions).orderBy(F.desc("seen_count"), "source_id", "mention").limit(most)


def count_mentions(sightings: DataFrame) -> DataFrame:
    """Sightings (source_id, mention, seen_at) by source and mention regardless of case."""
    return sightings.groupBy("source_id", F.lower("mention").alias("mention")).agg(F.count(F.lit(1)).alias("seen_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
