"""How claims retire one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .common import day, first_by, overlaps, prefixed

KEYS = ("feature_id", "source_id", "type")
NEAR = 8  # later claims of a key that are looked at side by side
TOP = 14  # windows of 2**TOP days and more, and half-open ones, stand in one bin


def _first_later(claims: DataFrame, order: tuple[str, str], strict: bool, answer: str) -> DataFrame:
    """(id, answer): for each claim, the least `answer` of the later claims of its key (by order) that have a newer
    observation (strictly, or not older) and an overlapping window.

    Claims are dealt by range of (key, order), so that a hot key falls into slices, and each is held against the next NEAR
    later ones of its slice; the nearest that fits has the least answer. What finds none there, has further later claims
    and is not newer than all of them is joined to these by bins of days: a window stands in the one or two bins of its
    own width and is met by the narrower and the wider ones at the wider one's width. Pairs thus grow with windows that
    overlap, not with the square of a key.
    """
    slim = claims.select("id", "seq", *KEYS, "observed_at", "valid_from", "valid_to")
    sliced = written(slim.repartitionByRange(*KEYS, *order).withColumn("slice", F.spark_partition_id()), "slices")
    later = Window.partitionBy("slice", *KEYS).orderBy(*(F.desc(c) for c in order))
    newer = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
    out = sliced.withColumns({"nth": F.row_number().over(later), "newest": F.max("observed_at").over(later.rowsBetween(Window.unboundedPreceding, -1))})
    for i in range(1, NEAR + 1):
        out = out.withColumns({f"b{i}_{c}": F.lag(c, i).over(later) for c in ("id", "seq", "observed_at", "valid_from", "valid_to")})
    fits = [F.col(f"b{i}_id").isNotNull() & newer(F.col("observed_at"), F.col(f"b{i}_observed_at")) & overlaps("", f"b{i}_") for i in range(1, NEAR + 1)]
    out = out.withColumn("answer", F.coalesce(*(F.when(fit, F.col(f"b{i}_{answer}")) for i, fit in enumerate(fits, 1))))
    tops = sliced.groupBy("slice", *KEYS).agg(F.max("observed_at").alias("top"))
    after = Window.partitionBy(*KEYS).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = tops.select("slice", *KEYS, F.max("top").over(after).alias("beyond")).filter("beyond is not null")
    out = out.select(*sliced.columns, "nth", "newest", "answer").join(beyond, ["slice", *KEYS], "left")
    unseen = F.greatest(F.when(F.col("nth") > NEAR + 1, F.col("newest")), F.col("beyond"))
    out = out.withColumn("open", F.col("answer").isNull() & F.coalesce(newer(F.col("observed_at"), unseen), F.lit(False))).filter("answer is not null or open")
    out = written(out.select("id", "answer", "open", *(F.when(F.col("open"), F.col(c)).alias(c) for c in slim.columns if c != "id")), "near")  # of the answered only ids
    found = out.filter("answer is not null").select("id", "answer")
    left = out.filter("open").select(*slim.columns)
    others = slim.join(left.select(*KEYS).distinct(), list(KEYS), "left_semi")
    rank = F.struct(*(F.col(f"b_{c}") for c in order)) > F.struct(*(F.col(f"a_{c}") for c in order))
    fit = rank & newer(F.col("a_observed_at"), F.col("b_observed_at")) & overlaps("a_", "b_")
    for wide, narrow in ((others, left), (left, others)):
        w, n = ("b_", "a_") if wide is others else ("a_", "b_")
        one = prefixed(_binned(wide, False), w)
        other = prefixed(_binned(narrow, True, above=w == "a_"), n)
        on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in (*KEYS, "level", "bin")]
        found = found.unionByName(one.join(other, [*on, fit]).select(F.col("a_id").alias("id"), F.col(f"b_{answer}").alias("answer")))
    return found.groupBy("id").agg(F.min("answer").alias("answer"))


def _binned(df: DataFrame, climb: bool, above: bool = False) -> DataFrame:
    """df by (level, bin) of its window: at its own level, or (climb) at that and every wider one, or at wider ones only."""
    low, high = F.unix_date("valid_from"), F.unix_date("valid_to")
    own = F.when(low.isNull() | high.isNull(), F.lit(TOP)).otherwise(F.least(F.lit(TOP), F.ceil(F.log2(F.greatest(high - low, F.lit(0)) + 1.0)).cast("int")))
    levels = F.sequence(own + int(above), F.lit(TOP)) if climb else F.array(own)
    if climb and above:
        levels = F.when(own < TOP, levels).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("level", F.explode(levels))
    first, last = (F.floor(x / F.pow(F.lit(2.0), F.col("level"))) for x in (low, F.greatest(low, high)))
    bins = F.when(F.col("level") >= TOP, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))
    return out.withColumn("bin", F.explode(bins))


def supersede_replaced(claims: DataFrame) -> DataFrame:
    """(id, replaced_by_seq): claims that a later arrival of the same feature, source and type retires, and the first such.

    Arrival is (seq, id). A stored claim with a strictly newer observation stays.
    """
    return _first_later(claims, ("seq", "id"), False, "seq").withColumnRenamed("answer", "replaced_by_seq")


def live_after_replacement(claims: DataFrame) -> DataFrame:
    return claims.join(supersede_replaced(claims), "id", "left_anti")


def supersede_backfill(claims: DataFrame) -> DataFrame:
    """(id, superseded_at): batch form by strictly newer observation; the day of the first newer one."""
    return _first_later(claims, ("observed_at", "id"), True, "observed_at").withColumnRenamed("answer", "superseded_at")


def lift_undated_closures(claims: DataFrame) -> DataFrame:
    """Closures without any date that a strictly newer opening of the same feature and source lifts."""
    opened = claims.filter("type = 'opening'").groupBy("feature_id", "source_id").agg(F.max("observed_at").alias("opened_at"))
    closures = claims.filter("type = 'closure' and valid_from is null and valid_to is null")
    return closures.join(opened, ["feature_id", "source_id"]).filter("observed_at < opened_at")


def inherit_review(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New claims with the review of the latest approved claim that says the same; rejections are never inherited.

    The same: equal feature, source, type, status and evidence, the evidence not blank.
    """
    keys = ["feature_id", "source_id", "type", "status", "evidence"]
    approved = stored.filter("reviewed_at is not null and superseded_at is null and trim(evidence) <> ''")
    latest = approved.groupBy(*keys).agg(F.max("reviewed_at").alias("carried_at"))
    joined = new.join(latest, keys, "left")
    return joined.withColumns(
        {
            "reviewed_at": F.when(F.col("needs_review") & F.col("reviewed_at").isNull(), F.col("carried_at")).otherwise(F.col("reviewed_at")),
            "review_note": F.when(F.col("needs_review") & F.col("reviewed_at").isNull() & F.col("carried_at").isNotNull(), F.concat(F.lit("[carried forward] "), F.col("carried_at"))),
        }
    ).drop("carried_at")


def backfill_from_successor(claims: DataFrame, as_of) -> DataFrame:
    """superseded_at of claims with a successor: the day it came, else as_of."""
    successors = claims.select(F.col("id").alias("superseded_by"), F.col("observed_at").alias("came_at"))
    joined = claims.join(successors, "superseded_by", "left")
    filled = F.when(F.col("superseded_by").isNotNull() & F.col("superseded_at").isNull(), F.coalesce("came_at", day(as_of))).otherwise(F.col("superseded_at"))
    return joined.withColumn("superseded_at", filled).drop("came_at")


def retirement_cutoffs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, cutoff): start of the Nth newest successful run; sources that don't ask or have fewer runs are left out."""
    asked = sources.filter("retire_after is not null").select("source_id", "retire_after")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    ok = runs.filter("ok").join(asked, "source_id").withColumn("place", place)
    return ok.filter("place = retire_after").select("source_id", F.col("started_at").alias("cutoff"))


def retire_unmentioned(claims: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims not seen in the last N successful runs of a source that asks for it."""
    return claims.join(retirement_cutoffs(runs, sources), "source_id").filter("last_seen_at < cutoff")


def unmentioned_backfill(claims: DataFrame, source_id: int, since, gap_days: int = 0) -> DataFrame:
    """Past retirements of one source since a day, with no successor and a long enough gap, get their reason."""
    hit = (
        (F.col("source_id") == source_id)
        & (F.col("superseded_at") >= day(since))
        & F.col("superseded_by").isNull()
        & (F.datediff("superseded_at", "last_seen_at") > gap_days)
    )
    return claims.withColumn("retired_reason", F.when(hit, "unmentioned").otherwise(F.col("retired_reason")))


def settle(every: DataFrame, runs: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The claims of a written table that live on: replacement, then lifting, then, with runs, retirement of the unmentioned.

    Only ids are written for what goes; the claims themselves are not copied again, and who reads the result moves no more
    columns than it asks for."""
    replaced = written(supersede_replaced(every).select("id"), "replaced")
    about = every.filter("type = 'opening' or (type = 'closure' and valid_from is null and valid_to is null)")
    lifted = lift_undated_closures(about.select("id", "feature_id", "source_id", "type", "observed_at", "valid_from", "valid_to").join(replaced, "id", "left_anti")).select("id")
    live = every.join(written(replaced.unionByName(lifted), "gone"), "id", "left_anti")
    if runs is not None:
        cutoffs = written(retirement_cutoffs(runs, sources), "cutoffs")
        live = live.join(cutoffs, "source_id", "left").filter("cutoff is null or last_seen_at is null or last_seen_at >= cutoff")
    return live.select(*every.columns)


def supersede_by_document(claims: DataFrame, renewed: DataFrame) -> DataFrame:
    """Claims after documents are read again: their live claims give way to the new ones, which arrive last; then
    replacement and lifting run over all that lives."""
    again = renewed.select("document_id").distinct()
    kept = claims.join(again, "document_id", "left_anti").select(*claims.columns)
    last = claims.agg(F.max("seq").alias("last_seq"))
    arrived = renewed.crossJoin(F.broadcast(last)).withColumn("seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))).drop("last_seq")
    return settle(written(kept.unionByName(arrived.select(*claims.columns)), "every"))


def append_statements(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored claims and new ones; nothing is ever dropped, and a claim that is there already isn't added twice."""
    return stored.unionByName(new.join(stored.select("id"), "id", "left_anti"), allowMissingColumns=True)


def purge_source(tables: dict[str, DataFrame], source_id: int) -> dict[str, DataFrame]:
    """Tables without the rows of one source."""
    return {k: df.filter(F.col("source_id") != source_id) if "source_id" in df.columns else df for k, df in tables.items()}


def keep_first_document(docs: DataFrame, keys: list[str], *order) -> DataFrame:
    """The earliest row of each source and content; later ones are sightings."""
    return first_by(docs, keys, *order)
