"""Which claims hold, which of them wins, and what follows from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOTICE_TYPES, day, first_by

# Days for which a claim of a type stays presentable, and sources that set their own.
STALE_DAYS = {"operational_status": 1, "closure": 90, "restriction": 90, "opening": 30, "condition": 14, "hazard_observation": 7}
DEFAULT_STALE_DAYS = 14


def live_claims(claims: DataFrame, as_of) -> DataFrame:
    """Not superseded, and valid on the day; both ends count, null ends are open."""
    at = day(as_of)
    return claims.filter(
        F.col("superseded_at").isNull()
        & F.col("superseded_by").isNull()
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= at))
        & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))
    )


def eligible_claims(claims: DataFrame, as_of) -> DataFrame:
    """Live claims that need no review or have had it."""
    return live_claims(claims, as_of).filter(~F.coalesce("needs_review", F.lit(False)) | F.col("reviewed_at").isNotNull())


def noteworthy() -> Column:
    """Whether a claim is worth a notice: never a schedule; severe, or of a notice type."""
    return ~F.coalesce("schedule", F.lit(False)) & ((F.col("severity") >= 1) | F.col("type").isin(*NOTICE_TYPES))


def claims_with_trust(claims: DataFrame, sources: DataFrame) -> DataFrame:
    return claims.join(sources.select("source_id", "trust", F.col("name").alias("source_name")), "source_id")


def stale_days(by_source: dict[tuple[int, str | None], int] | None = None) -> Column:
    """Days by source and type, then by source, then by type, then the default."""
    out = F.when(F.lit(False), F.lit(0))
    for (source, kind), days in sorted((by_source or {}).items(), key=lambda x: (x[0][1] is None, x[0][0])):
        match = F.col("source_id") == source
        out = out.when(match if kind is None else match & (F.col("type") == kind), days)
    for kind, days in STALE_DAYS.items():
        out = out.when(F.col("type") == kind, days)
    return out.otherwise(DEFAULT_STALE_DAYS)


def current_status(claims: DataFrame, sources: DataFrame, as_of, by_source: dict | None = None) -> DataFrame:
    """One row for each feature with claims: the eligible claim with the highest trust, then newest, then most severe.

    Features whose claims are all ineligible are unknown. Remaining ties go to the larger claim id.
    """
    order = [F.desc("trust"), F.desc("observed_at"), F.desc("severity"), F.desc("id")]
    won = first_by(claims_with_trust(eligible_claims(claims, as_of), sources), ["feature_id"], *order)
    won = won.select(
        "feature_id", "status", "severity", F.col("id").alias("claim_id"), "source_id", "observed_at", "last_seen_at", F.date_add("observed_at", stale_days(by_source)).alias("stale_after")
    )
    every = claims.select("feature_id").distinct()
    return every.join(won, "feature_id", "left").withColumns(
        {"status": F.coalesce("status", F.lit("unknown")), "severity": F.coalesce("severity", F.lit(0))}
    )


def _not_winner(claims: DataFrame, status: DataFrame) -> DataFrame:
    return claims.join(status.select(F.col("claim_id").alias("id")), "id", "left_anti")


def advisories(claims: DataFrame, status: DataFrame, as_of) -> DataFrame:
    """Live claims of severity 1 or more that aren't the winner; no review gate."""
    return _not_winner(live_claims(claims, as_of).filter("severity >= 1"), status)


def other_notice_counts(claims: DataFrame, status: DataFrame, as_of) -> DataFrame:
    """Live noteworthy claims besides the winner, for features with a status row."""
    others = _not_winner(live_claims(claims, as_of).filter(noteworthy()), status)
    return others.join(status.select("feature_id"), "feature_id", "left_semi").groupBy("feature_id").agg(F.count(F.lit(1)).alias("other_notices"))


def other_notices(claims: DataFrame, status: DataFrame, as_of) -> DataFrame:
    """The same claims with their place: most severe first, then newest."""
    others = _not_winner(live_claims(claims, as_of).filter(noteworthy()), status)
    place = F.row_number().over(Window.partitionBy("feature_id").orderBy(F.desc("severity"), F.desc("observed_at"), F.desc("id")))
    return others.withColumn("place", place)


def distinct_features(claims: DataFrame) -> DataFrame:
    return claims.select("feature_id").distinct()


def touched_features(*parts: DataFrame) -> DataFrame:
    """Features that any of the parts names."""
    out = parts[0].select("feature_id")
    for more in parts[1:]:
        out = out.union(more.select("feature_id"))
    return out.distinct()


def orphan_status(status: DataFrame, claims: DataFrame) -> DataFrame:
    """Status rows whose winning claim is missing or gone."""
    return status.join(claims.select(F.col("id").alias("claim_id")), "claim_id", "left_anti")


def write_status(status: DataFrame, recomputed: DataFrame) -> DataFrame:
    """The status table with the rows of recomputed features replaced."""
    return status.join(recomputed.select("feature_id").distinct(), "feature_id", "left_anti").unionByName(recomputed)


def is_stale(as_of) -> Column:
    return F.coalesce(F.col("stale_after") < day(as_of), F.lit(False))


def is_overdue(as_of, default_minutes: int = 1440) -> Column:
    """Last seen over two cadences ago, or never, where there is a status and a winner."""
    minutes = F.coalesce("interval_min", F.lit(default_minutes)) * 2
    late = F.col("last_seen_at").isNull() | (F.unix_seconds(F.col("last_seen_at").cast("timestamp")) + minutes * 60 < F.unix_seconds(day(as_of).cast("timestamp")))
    return F.when(F.col("claim_id").isNotNull(), late).otherwise(F.lit(False))


def doubt(stale: Column, overdue: Column) -> Column:
    return F.when(stale, "old").when(overdue, "unchecked")


def last_reported(claims: DataFrame, status: DataFrame) -> DataFrame:
    """For features of unknown or no status: the claim retired as unmentioned that was seen last."""
    known = status.filter("status <> 'unknown'").select("feature_id")
    gone = claims.filter("retired_reason = 'unmentioned'").join(known, "feature_id", "left_anti")
    return first_by(gone, ["feature_id"], F.desc("last_seen_at"), F.desc("id"))


def feature_history(claims: DataFrame, sources: DataFrame, most: int = 50) -> DataFrame:
    """The newest claims of each feature that nothing superseded, with their source."""
    place = F.row_number().over(Window.partitionBy("feature_id").orderBy(F.desc("observed_at"), F.desc("id")))
    kept = claims.filter("superseded_at is null and superseded_by is null").withColumn("place", place).filter(F.col("place") <= most)
    return kept.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")


def status_coverage(features: DataFrame, status: DataFrame) -> DataFrame:
    """Features by status and winning source; `none` for features without a status row."""
    joined = features.join(status.select("feature_id", "status", "source_id"), "feature_id", "left")
    return joined.groupBy(F.coalesce("status", F.lit("none")).alias("status"), "source_id").agg(F.count(F.lit(1)).alias("n"))
