"""Review queues, decisions and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STATUSES, TRANSIENT, TYPES, day
from .status import live_claims


def review_queue(claims: DataFrame, features: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims that wait for review, newest first."""
    waiting = claims.filter("needs_review and reviewed_at is null and superseded_at is null")
    joined = waiting.join(features.filter("active").select("feature_id", "name"), "feature_id").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return joined.orderBy(F.desc("observed_at"), F.desc("id"))


def editable_claims(claims: DataFrame, features: DataFrame, as_of, most: int = 200) -> DataFrame:
    """Claims that hold on the day, superseded_by ignored; the newest `most`."""
    at = day(as_of)
    holding = claims.filter(F.col("superseded_at").isNull() & (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)))
    return holding.join(features.filter("active").select("feature_id", "name"), "feature_id").orderBy(F.desc("observed_at"), F.desc("id")).limit(most)


def sibling_claims(claims: DataFrame) -> DataFrame:
    """Pairs of claims of one document that nothing superseded, the other's state said."""
    alive = claims.filter("superseded_at is null")
    a = alive.select("document_id", F.col("id").alias("claim_id"))
    state = F.when(F.coalesce("needs_review", F.lit(False)) & F.col("reviewed_at").isNull(), "waiting").otherwise("accepted")
    b = alive.select("document_id", F.col("id").alias("sibling_id"), state.alias("state"))
    return a.join(b, "document_id").filter("claim_id <> sibling_id")


def manual_claim_check(claims: DataFrame) -> DataFrame:
    """Hand-written claims with the first reason against them; null passes."""
    reason = (
        F.when(F.col("type").isNull() | ~F.col("type").isin(*TYPES), "unknown type")
        .when(F.col("status").isNull() | ~F.col("status").isin(*STATUSES), "unknown status")
        .when(F.coalesce(F.trim("summary"), F.lit("")) == "", "no summary")
        .when(F.col("status").isin(*TRANSIENT) & F.col("valid_from").isNull() & F.col("valid_to").isNull(), "no dates")
    )
    return claims.withColumn("reject_reason", reason)


def apply_override(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims with windows, statuses and summaries of decisions (claim_id, ...); what changed is recorded.

    A decision that leaves a transient status without any date is refused and leaves the claim as it was.
    """
    new = decisions.select(F.col("claim_id").alias("id"), *(F.col(c).alias(f"new_{c}") for c in ("valid_from", "valid_to", "status")))
    joined = claims.join(new, "id", "left")
    status = F.coalesce("new_status", "status")
    start, end = F.coalesce("new_valid_from", "valid_from"), F.coalesce("new_valid_to", "valid_to")
    refused = status.isin(*TRANSIENT) & start.isNull() & end.isNull()
    changed = F.array_compact(F.array(*(F.when(F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in ("valid_from", "valid_to", "status"))))
    out = joined.withColumns({"changed": F.when(refused, F.array().cast("array<string>")).otherwise(changed)})
    return out.withColumns({c: F.when(refused, F.col(c)).otherwise(F.coalesce(f"new_{c}", c)) for c in ("valid_from", "valid_to", "status")}).drop("new_valid_from", "new_valid_to", "new_status")


def review_digest(queue: DataFrame, as_of) -> DataFrame:
    """(source_name, waiting, oldest_days) by falling count."""
    return queue.groupBy("source_name").agg(F.count(F.lit(1)).alias("waiting"), F.max(F.datediff(day(as_of), F.col("observed_at"))).alias("oldest_days")).orderBy(F.desc("waiting"), "source_name")


def apply_decisions(claims: DataFrame, decisions: DataFrame, as_of) -> DataFrame:
    """Accepted claims get reviewed_at, rejected ones superseded_at. decisions: claim_id, accept."""
    joined = claims.join(decisions.select(F.col("claim_id").alias("id"), "accept"), "id", "left")
    return joined.withColumns(
        {
            "reviewed_at": F.when(F.col("accept"), day(as_of)).otherwise(F.col("reviewed_at")),
            "superseded_at": F.when(~F.col("accept"), day(as_of)).otherwise(F.col("superseded_at")),
        }
    ).drop("accept")


def demote_undated(claims: DataFrame) -> DataFrame:
    """A transient status without a window becomes unknown; what it said is kept."""
    hit = F.col("status").isin(*TRANSIENT) & F.col("valid_from").isNull() & F.col("valid_to").isNull()
    return claims.withColumns({"undated_status": F.when(hit, F.col("status")), "status": F.when(hit, "unknown").otherwise(F.col("status"))})


def demote_unbounded(claims: DataFrame) -> DataFrame:
    """A claim with no window, or one end only, is unknown with severity 0."""
    hit = F.col("valid_from").isNull() | F.col("valid_to").isNull()
    return claims.withColumns({"status": F.when(hit, "unknown").otherwise(F.col("status")), "severity": F.when(hit, 0).otherwise(F.col("severity"))})


def widen_single_day_opening(claims: DataFrame, days: int = 30) -> DataFrame:
    """An opening that names one day lasts `days` days."""
    hit = (F.col("type") == "opening") & F.startswith(F.coalesce("date_rule", F.lit("")), F.lit("single"))
    return claims.withColumn("valid_to", F.when(hit, F.date_add("valid_from", days)).otherwise(F.col("valid_to")))


def live_count_by_type(claims: DataFrame, as_of) -> DataFrame:
    return live_claims(claims, as_of).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
