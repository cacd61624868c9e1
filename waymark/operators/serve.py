"""The tables that readers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.shared import written
from .common import day


def feature_filter(view: DataFrame, kind: str | None = None, status: str | None = None) -> DataFrame:
    out = view.filter("active")
    out = out.filter(F.col("kind") == kind) if kind else out
    return out.filter(F.col("status") == status) if status else out


def features_view(features: DataFrame, status: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Every feature with its status, winning claim, source and parent's name; all joins are left joins on one key."""
    won = claims.select(F.col("id").alias("claim_id"), "type", "valid_from", "valid_to")
    parents = features.select(F.col("feature_id").alias("parent_id"), F.col("name").alias("parent_name"))
    named = sources.select("source_id", F.col("name").alias("source_name"), "interval_min")
    return features.join(status, "feature_id", "left").join(won, "claim_id", "left").join(named, "source_id", "left").join(parents, "parent_id", "left")


def children_of(features: DataFrame, status: DataFrame) -> DataFrame:
    """(parent_id, feature_id, name, status) in name order; no status reads unknown."""
    children = features.filter("parent_id is not null").join(status.select("feature_id", "status"), "feature_id", "left")
    return children.select("parent_id", "feature_id", "name", F.coalesce("status", F.lit("unknown")).alias("status")).orderBy("parent_id", "name", "feature_id")


def feed(claims: DataFrame, features: DataFrame, sources: DataFrame, n: int = 50) -> DataFrame:
    """The newest claims that nothing superseded; at most 200."""
    joined = claims.filter("superseded_at is null").join(features.select("feature_id", "name"), "feature_id").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    return joined.select("id", "feature_id", "name", "source_name", "type", "status", "observed_at").orderBy(F.desc("observed_at"), F.desc("id")).limit(min(n, 200))


def tracked(view: DataFrame) -> DataFrame:
    """Parentless features with something to say."""
    return view.filter(F.col("parent_id").isNull() & (F.col("claim_id").isNotNull() | F.col("reason").isNotNull()))


def exceptional(season: Column, doubt: Column) -> Column:
    return ~season.eqNullSafe(F.lit("open")) | doubt.isNotNull()


def split_notices(notices: DataFrame) -> DataFrame:
    return notices.withColumn("in_force", F.col("status").isin("closed", "restricted"))


def country_counts(view: DataFrame, column: str) -> DataFrame:
    return view.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def substring_search(features: DataFrame, needle: str) -> DataFrame:
    """Features whose folded name or id text holds the folded needle; an empty needle finds nothing."""
    if not needle.strip():
        return features.limit(0)
    return features.filter(F.contains(fold(F.col("name")), fold(F.lit(needle))))


SEASON_RANK = ("closed", "restricted", "open", "unstaffed", "unknown")


def season_rank(season: Column) -> Column:
    out = F.when(season == SEASON_RANK[0], 0)
    for k, name in enumerate(SEASON_RANK[1:], 1):
        out = out.when(season == name, k)
    return out.otherwise(len(SEASON_RANK))


def ledger(view: DataFrame, *order) -> DataFrame:
    """View rows under an order that ends in the feature id, with their place.

    Rows are dealt by range of the order and numbered within each range; each range begins where those before it end.
    """
    keys = [*order, F.col("feature_id")]
    ranged = written(view.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("n"))  # one row for each task
    before = counts.select("range_", (F.sum("n").over(Window.orderBy("range_")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range_").orderBy(*keys))
    return ranged.withColumn("place", nth).join(before, "range_").withColumn("place", (F.col("place") + F.col("before")).cast("int")).drop("range_", "before")


def notice_mix(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count_if(F.expr("status in ('closed', 'restricted')")).alias("notices"),
        F.count_if(F.expr("status = 'closed'")).alias("closed"),
        F.count_if(F.expr("status = 'restricted'")).alias("restricted"),
        F.count_if(F.expr("status = 'unknown'")).alias("asleep"),
    )


def altitude_label(low: Column, high: Column, own: Column) -> Column:
    return (
        F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" m")))
        .when(F.coalesce(high, low, own).isNotNull(), F.concat(F.coalesce(high, low, own).cast("string"), F.lit(" m")))
    )


def map_colour_state(season: Column, has_status: Column) -> Column:
    return F.when(season.isin("open", "closed", "restricted", "unstaffed"), season).when(has_status, "unknown").otherwise("context")


def said_about(reason: Column, summary: Column) -> Column:
    """(text, quoted): the season's reason, else the summary, else a fixed phrase; quoted if it is in quotation marks."""
    told = F.coalesce(reason, summary, F.lit("Nothing reported"))
    return F.struct(told.alias("text"), told.rlike(r'^["“«].*["”»]$').alias("quoted"))


def geojson_lines(view: DataFrame) -> DataFrame:
    """Line features (geometry: array of (lon, lat)) as GeoJSON text with colour, whether the status is known, whether the
    line is only a sketch between two points, and a summary."""
    coordinates = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    shape = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    known = F.col("status").isNotNull()
    told = F.struct(
        "feature_id", "name", known.alias("known"), map_colour_state(F.col("status"), known).alias("colour"), (F.size("geometry") == 2).alias("schematic"),
        F.concat_ws(": ", "name", F.coalesce("status", F.lit("unknown"))).alias("summary"),
    )
    return view.filter(F.size("geometry") >= 2).select("feature_id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), told.alias("properties"))).alias("json"))


def sitemap_rows(view: DataFrame, root: str) -> DataFrame:
    """Address and last change (the observation's day, never the last sighting's) of each feature."""
    return view.select(F.concat_ws("/", F.lit(root), "kind", F.col("feature_id").cast("string")).alias("url"), F.col("observed_at").alias("last_modified"))


def due_sources(sources: DataFrame, as_of) -> DataFrame:
    """Sources (last_fetch_at, failures, interval_min) that are due: never fetched, or past a cadence that backs off to 8 fold."""
    wait = F.col("interval_min") * F.least(F.pow(F.lit(2.0), F.col("failures")), F.lit(8.0)) * 60
    at = F.unix_seconds(day(as_of).cast("timestamp"))
    return sources.filter(F.col("last_fetch_at").isNull() | (F.unix_seconds(F.col("last_fetch_at").cast("timestamp")) + wait <= at))


def source_run_state(runs: DataFrame) -> DataFrame:
    """(source_id, last_fetch_at, last_success_at, failures since then) from the runs."""
    ok = runs.filter("ok").groupBy("source_id").agg(F.max(F.struct("started_at", "run_id")).alias("good"))
    joined = runs.join(ok, "source_id", "left")
    since = F.col("good").isNull() | (F.struct("started_at", "run_id") > F.col("good"))
    error = F.col("error") if "error" in runs.columns else F.lit(None).cast("string")
    last = F.max(F.when(~F.col("ok") & since, F.struct("started_at", "run_id", error.alias("error"))))["error"]
    return joined.groupBy("source_id").agg(
        F.max("started_at").alias("last_fetch_at"), F.max("good.started_at").alias("last_success_at"), F.count_if(~F.col("ok") & since).alias("failures"), last.alias("last_error")
    )


def health(runs: DataFrame, features: DataFrame) -> DataFrame:
    return runs.agg(F.max(F.when(F.col("ok"), F.col("started_at"))).alias("last_ok")).crossJoin(features.agg(F.count(F.lit(1)).alias("features")))


def unserved_sources(sources: DataFrame, registry: list[int]) -> DataFrame:
    return sources.filter(~F.col("source_id").isin(*registry))
