"""Seasons, calendars and the wording of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import day
from .status import live_claims


def season_status(claims: DataFrame, as_of) -> DataFrame:
    """One row for each feature with claims: season, reason, claim_id, from the first branch that applies.

    1 the worst live closure or restriction that says closed or restricted; 2 a live schedule; 3 the newest unstaffed
    opening where no opening says open; 4 the newest open opening; 5 any schedule ever; 6 unknown.
    """
    live = live_claims(claims, as_of)
    worst = F.struct("severity", "observed_at", "id", "type")
    newest = F.struct("observed_at", "id")
    stops = F.col("type").isin("closure", "restriction") & F.col("status").isin("closed", "restricted")
    opening, schedule = F.col("type") == "opening", F.coalesce("schedule", F.lit(False))
    now = live.groupBy("feature_id").agg(
        F.max(F.when(stops, worst)).alias("stop"),
        F.max(F.when(schedule, newest)).alias("planned"),
        F.max(F.when(opening & ~schedule & (F.col("status") == "unstaffed"), newest)).alias("unstaffed"),
        F.max(F.when(opening & ~schedule & (F.col("status") == "open"), newest)).alias("opened"),
    )
    ever = claims.groupBy("feature_id").agg(F.max(F.when(schedule, F.struct("last_seen_at", "id"))).alias("ever"))
    s = ever.join(now, "feature_id", "left")
    c = F.col
    branch = (
        F.when(c("stop").isNotNull(), 1)
        .when(c("planned").isNotNull(), 2)
        .when(c("unstaffed").isNotNull() & c("opened").isNull(), 3)
        .when(c("opened").isNotNull(), 4)
        .when(c("ever").isNotNull(), 5)
        .otherwise(6)
    )
    b = c("branch")
    return s.withColumn("branch", branch).select(
        "feature_id",
        "branch",
        F.when(b == 1, F.when(c("stop.type") == "closure", "closed").otherwise("restricted")).when(b.isin(2, 4), "open").when(b == 3, "unstaffed").when(b == 5, "closed").otherwise("unknown").alias("season"),
        F.when(b == 2, "in_season").when(b == 5, "out_of_season").alias("reason"),
        F.when(b == 1, c("stop.id")).when(b == 2, c("planned.id")).when(b == 3, c("unstaffed.id")).when(b == 4, c("opened.id")).when(b == 5, c("ever.id")).alias("claim_id"),
    )


def schedule_clocks(claims: DataFrame) -> DataFrame:
    """Both clocks of each feature's schedule claim that was seen last, retired ones included."""
    found = claims.filter("schedule").groupBy("feature_id").agg(F.max(F.struct("last_seen_at", "observed_at", "id")).alias("m"))
    return found.select("feature_id", F.col("m.id").alias("claim_id"), F.col("m.observed_at").alias("observed_at"), F.col("m.last_seen_at").alias("last_seen_at"))


def run_around(days: DataFrame, as_of) -> DataFrame:
    """The unbroken run of equal days that holds as_of, for each (entity, state); days: one row for each day."""
    place = F.row_number().over(Window.partitionBy("entity", "state").orderBy("day"))
    runs = days.withColumn("island", F.date_sub("day", place)).groupBy("entity", "state", "island").agg(F.min("day").alias("start"), F.max("day").alias("end"))
    return runs.filter((F.col("start") <= day(as_of)) & (F.col("end") >= day(as_of))).drop("island")


def season_from(days: DataFrame, as_of, gap: int = 28, ahead: int = 28) -> DataFrame:
    """(entity, start, end): the first group of days, gaps up to `gap`, that isn't over; none if it starts too far ahead."""
    w = Window.partitionBy("entity").orderBy("day")
    broken = F.coalesce((F.datediff("day", F.lag("day").over(w)) > gap).cast("int"), F.lit(0))
    groups = days.select("entity", "day").distinct().withColumn("broken", broken).withColumn("season", F.sum("broken").over(w))
    spans = groups.groupBy("entity", "season").agg(F.min("day").alias("first"), F.max("day").alias("end"))
    at = day(as_of)
    coming = spans.filter(F.col("end") >= at).groupBy("entity").agg(F.min(F.struct("first", "end")).alias("s"))
    return coming.filter(F.datediff("s.first", at) <= ahead).select("entity", at.alias("start"), F.col("s.end").alias("end"))


def bookable_in_window(days: DataFrame, windows: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Days of the given states inside each entity's window."""
    joined = windows.join(days, "entity", "left")
    inside = F.col("state").isin(*states) & (F.col("day") >= F.col("start")) & (F.col("day") <= F.col("end"))
    return joined.groupBy("entity", "start", "end").agg(F.count_if(inside).alias("bookable"))


def sector_rollup(items: DataFrame, keys: list[str]) -> DataFrame:
    """Status of a group of members: items have is_pending, is_open; all pending or none at all is unknown."""
    g = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_open").alias("n_open"), F.bool_and("is_pending").alias("pending"))
    none, every = F.col("n_open") == 0, F.col("n_open") == F.col("total")
    return g.withColumns(
        {
            "status": F.when(F.col("pending"), "unknown").when(none, "closed").when(every, "open").otherwise("restricted"),
            "severity": F.when(F.col("pending") | every, 0).otherwise(1),
            "note": F.concat(F.col("n_open").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" open")),
        }
    )


def day_window(times: DataFrame, keys: list[str]) -> DataFrame:
    """First opening and last closing over texts such as 08:30 - 16:45."""
    found = times.select(*keys, F.regexp_extract("hours", r"(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})", 1).alias("o"), F.regexp_extract("hours", r"(\d{1,2}:\d{2})\s*-\s*(\d{1,2}:\d{2})", 2).alias("c"))
    padded = found.filter("o <> ''").select(*keys, F.lpad("o", 5, "0").alias("o"), F.lpad("c", 5, "0").alias("c"))
    return padded.groupBy(*keys).agg(F.min("o").alias("opens"), F.max("c").alias("closes"))


def pending_phase(at: Column, opens: Column, closes: Column, zone: str = "Europe/Paris") -> Column:
    """before, after or inside the window, by the local clock."""
    clock = F.date_format(F.from_utc_timestamp(at, zone), "HH:mm")
    return F.when(clock < opens, "before").when(clock > closes, "after").otherwise("inside")


def describe_window(start: Column, end: Column) -> Column:
    """A window in English: one day, one month, one year, two years, until, from."""

    def full(c: Column) -> Column:
        return F.date_format(c, "d MMM yyyy")

    same_year, same_month = F.year(start) == F.year(end), F.month(start) == F.month(end)
    return (
        F.when(start.isNull() & end.isNull(), F.lit(None).cast("string"))
        .when(start.isNull(), F.concat(F.lit("until "), full(end)))
        .when(end.isNull(), F.concat(F.lit("from "), full(start)))
        .when(start == end, full(start))
        .when(same_year & same_month, F.concat(F.dayofmonth(start).cast("string"), F.lit("-"), full(end)))
        .when(same_year, F.concat(F.date_format(start, "d MMM"), F.lit(" - "), full(end)))
        .otherwise(F.concat(full(start), F.lit(" - "), full(end)))
    )


def phrase_for_now(as_of) -> Column:
    """An opening in the tense of the day; other claims keep their summary."""
    c, at = F.col, day(as_of)
    keep = (c("type") != "opening") | (c("status") == "unknown") | c("valid_from").isNull()
    started = c("valid_from") <= at
    return (
        F.when(keep | (started & F.coalesce("approximate", F.lit(False))), c("summary"))
        .when(started & c("valid_to").isNotNull() & F.coalesce("wardened", F.lit(False)), F.concat(F.lit("Wardened until "), F.date_format("valid_to", "d MMM yyyy")))
        .when(started, F.concat(F.lit("Open since "), F.date_format("valid_from", "d MMM yyyy")))
        .otherwise(F.concat(F.lit("Reopening "), F.date_format("valid_from", "d MMM yyyy")))
    )


def since_label(minutes: Column) -> Column:
    """The longer wording: just now, minutes and hours ago, yesterday, days ago. Halves round up."""
    whole = F.floor(minutes + 0.5)
    hours = F.floor(whole / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    return (
        F.when(minutes.isNull(), "never checked")
        .when(whole < 2, "just now")
        .when(whole < 60, F.concat(whole.cast("string"), F.lit(" min ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days == 1, "yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def age_label(minutes: Column) -> Column:
    """Minutes under an hour (at least 1), hours under two days, else days; null is never. Halves round up."""
    hours, days = F.floor(minutes / 60 + 0.5), F.floor(minutes / 1440 + 0.5)
    return (
        F.when(minutes.isNull(), "never")
        .when(minutes < 60, F.concat(F.greatest(F.lit(1), F.floor(minutes + 0.5)).cast("string"), F.lit(" min")))
        .when(minutes < 2880, F.concat(hours.cast("string"), F.lit(" h")))
        .otherwise(F.concat(days.cast("string"), F.lit(" d")))
    )


def local_time_label(at: Column, zone: str = "Europe/Paris", form: str = "d MMM yyyy HH:mm") -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), form), F.lit("never"))


def review_window_label(as_of) -> Column:
    """The window for reviewers, with notes on its roughness and on past or coming ones."""
    c = F.col
    return F.concat(
        F.coalesce(describe_window(c("valid_from"), c("valid_to")), F.lit("no dates")),
        F.when(F.coalesce("approximate", F.lit(False)), " (approximate)").otherwise(""),
        F.when(c("valid_to") < day(as_of), " (past)").when(c("valid_from") > day(as_of), " (not yet)").otherwise(""),
    )
