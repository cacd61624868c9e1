"""Status, lifecycle, seasons, review and serving over the line items as claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import facts as fa
from ..operators import lifecycle as li
from ..operators import review as re
from ..operators import season as se
from ..operators import serve as sv
from ..operators import status as st
from ..sources import tables as tb
from .registry import AS_OF, query

LIVE = """superseded_at IS NULL AND superseded_by IS NULL AND (valid_from IS NULL OR valid_from <= $as_of) AND (valid_to IS NULL OR valid_to >= $as_of)"""
ELIGIBLE = f"{LIVE} AND (NOT coalesce(needs_review, false) OR reviewed_at IS NOT NULL)"
NOTE = "NOT coalesce(schedule, false) AND (severity >= 1 OR type IN ('closure', 'restriction', 'hazard_observation'))"
STATUS = f"""
won AS (SELECT * FROM (SELECT s.*, trust, row_number() OVER (PARTITION BY feature_id ORDER BY trust DESC, observed_at DESC, severity DESC, id DESC) AS rn
  FROM stmt s JOIN src USING (source_id) WHERE {ELIGIBLE}) WHERE rn = 1),
stat AS (SELECT f.feature_id, coalesce(w.status, 'unknown') AS status, coalesce(w.severity, 0) AS severity, w.id AS claim_id, w.source_id, w.observed_at, w.last_seen_at,
  w.observed_at + (CASE w.type WHEN 'closure' THEN 90 WHEN 'restriction' THEN 90 WHEN 'opening' THEN 30 ELSE 14 END) AS stale_after
  FROM (SELECT DISTINCT feature_id FROM stmt) f LEFT JOIN won w ON w.feature_id = f.feature_id)
"""


def status_of(spark, d):
    return st.current_status(tb.claims(spark, d), tb.sources(spark, d), AS_OF)


@query(f"SELECT id, feature_id, status FROM stmt WHERE {LIVE}")
def live_claims(spark, d):
    return st.live_claims(tb.claims(spark, d), AS_OF).select("id", "feature_id", "status")


@query(f"SELECT id, feature_id, status FROM stmt WHERE {ELIGIBLE}")
def eligible_claims(spark, d):
    return st.eligible_claims(tb.claims(spark, d), AS_OF).select("id", "feature_id", "status")


@query(f"SELECT type, severity, count(*) AS n FROM stmt WHERE {NOTE} GROUP BY ALL")
def noteworthy(spark, d):
    return tb.claims(spark, d).filter(st.noteworthy()).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name AS source_name, trust, count(*) AS n FROM stmt JOIN src USING (source_id) GROUP BY ALL")
def claims_with_trust(spark, d):
    return st.claims_with_trust(tb.claims(spark, d), tb.sources(spark, d)).groupBy("source_name", "trust").agg(F.count(F.lit(1)).alias("n"))


@query(f"{STATUS} -- main\nSELECT feature_id, status, severity, claim_id, source_id, observed_at, last_seen_at, stale_after FROM stat")
def current_status(spark, d):
    return status_of(spark, d)


@query("SELECT source_id, type, CASE WHEN source_id = 2 THEN 365 WHEN source_id = 3 AND type = 'opening' THEN 240 WHEN type IN ('closure', 'restriction') THEN 90 WHEN type = 'opening' THEN 30 ELSE 14 END AS days, count(*) AS n FROM stmt GROUP BY ALL")
def stale_days(spark, d):
    days = st.stale_days({(2, None): 365, (3, "opening"): 240}).alias("days")
    return tb.claims(spark, d).groupBy("source_id", "type", days).agg(F.count(F.lit(1)).alias("n"))


@query(f"{STATUS} -- main\nSELECT id, feature_id, severity, observed_at FROM stmt WHERE {LIVE} AND severity >= 1 AND id NOT IN (SELECT claim_id FROM stat WHERE claim_id IS NOT NULL)")
def advisories(spark, d):
    return st.advisories(tb.claims(spark, d), status_of(spark, d), AS_OF).select("id", "feature_id", "severity", "observed_at")


@query(f"{STATUS} -- main\nSELECT feature_id, count(*) AS other_notices FROM stmt WHERE {LIVE} AND {NOTE} AND id NOT IN (SELECT claim_id FROM stat WHERE claim_id IS NOT NULL) GROUP BY 1")
def other_notice_counts(spark, d):
    return st.other_notice_counts(tb.claims(spark, d), status_of(spark, d), AS_OF)


@query(f"{STATUS} -- main\nSELECT id, feature_id, row_number() OVER (PARTITION BY feature_id ORDER BY severity DESC, observed_at DESC, id DESC) AS place FROM stmt WHERE {LIVE} AND {NOTE} AND id NOT IN (SELECT claim_id FROM stat WHERE claim_id IS NOT NULL)")
def other_notices(spark, d):
    return st.other_notices(tb.claims(spark, d), status_of(spark, d), AS_OF).select("id", "feature_id", "place")


@query("SELECT DISTINCT feature_id FROM stmt")
def distinct_features(spark, d):
    return st.distinct_features(tb.claims(spark, d))


@query("SELECT feature_id FROM stmt WHERE type = 'closure' AND severity = 3 UNION SELECT feature_id FROM stmt WHERE retired_reason IS NOT NULL")
def touched_features(spark, d):
    c = tb.claims(spark, d)
    return st.touched_features(c.filter("type = 'closure' and severity = 3"), c.filter("retired_reason is not null"))


@query(f"{STATUS} -- main\nSELECT feature_id, claim_id FROM stat WHERE claim_id IS NULL OR claim_id NOT IN (SELECT id FROM stmt WHERE source_id <> 3)")
def orphan_status(spark, d):
    return st.orphan_status(status_of(spark, d), tb.claims(spark, d).filter("source_id <> 3")).select("feature_id", "claim_id")


@query(f"{STATUS} -- main\nSELECT feature_id, CASE WHEN feature_id % 3 = 0 THEN 'unknown' ELSE status END AS status FROM stat")
def write_status(spark, d):
    now = status_of(spark, d).select("feature_id", "status")
    return st.write_status(now, now.filter("feature_id % 3 = 0").withColumn("status", F.lit("unknown")))


@query(f"""{STATUS} -- main
SELECT feature_id, coalesce(stale_after < $as_of, false) AS stale,
  CASE WHEN claim_id IS NOT NULL THEN last_seen_at IS NULL OR epoch(last_seen_at::TIMESTAMP) + coalesce(interval_min, 1440) * 120 < epoch($as_of::TIMESTAMP) ELSE false END AS overdue,
  CASE WHEN coalesce(stale_after < $as_of, false) THEN 'old' WHEN claim_id IS NOT NULL AND (last_seen_at IS NULL OR epoch(last_seen_at::TIMESTAMP) + coalesce(interval_min, 1440) * 120 < epoch($as_of::TIMESTAMP)) THEN 'unchecked' END AS doubt
FROM stat LEFT JOIN src USING (source_id)""")
def stale_overdue_doubt(spark, d):
    joined = status_of(spark, d).join(tb.sources(spark, d).select("source_id", "interval_min"), "source_id", "left")
    flags = joined.select("feature_id", st.is_stale(AS_OF).alias("stale"), st.is_overdue(AS_OF).alias("overdue"))
    return flags.withColumn("doubt", st.doubt(F.col("stale"), F.col("overdue")))


@query(f"""{STATUS} -- main
SELECT feature_id, id, last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY last_seen_at DESC, id DESC) AS rn FROM stmt
  WHERE retired_reason = 'unmentioned' AND feature_id NOT IN (SELECT feature_id FROM stat WHERE status <> 'unknown')) WHERE rn = 1""")
def last_reported(spark, d):
    return st.last_reported(tb.claims(spark, d), status_of(spark, d)).select("feature_id", "id", "last_seen_at")


@query("""SELECT id, feature_id, place, name AS source_name FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY observed_at DESC, id DESC) AS place FROM stmt
  WHERE superseded_at IS NULL AND superseded_by IS NULL) JOIN src USING (source_id) WHERE place <= 5""")
def feature_history(spark, d):
    return st.feature_history(tb.claims(spark, d), tb.sources(spark, d), 5).select("id", "feature_id", "place", "source_name")


@query(f"{STATUS} -- main\nSELECT coalesce(status, 'none') AS status, source_id, count(*) AS n FROM feat LEFT JOIN stat USING (feature_id) GROUP BY ALL")
def status_coverage(spark, d):
    return st.status_coverage(tb.features(spark, d), status_of(spark, d))


OVERLAP = "(a.valid_from IS NULL OR b.valid_to IS NULL OR a.valid_from <= b.valid_to) AND (b.valid_from IS NULL OR a.valid_to IS NULL OR b.valid_from <= a.valid_to)"


@query(f"""SELECT a.id, min(b.seq) AS replaced_by_seq FROM stmt a JOIN stmt b USING (feature_id, source_id, type)
WHERE {OVERLAP} AND (b.seq > a.seq OR (b.seq = a.seq AND b.id > a.id)) AND a.observed_at <= b.observed_at GROUP BY 1""")
def supersede_replaced(spark, d):
    return li.supersede_replaced(tb.claims(spark, d))


@query(f"SELECT a.id, min(b.observed_at) AS superseded_at FROM stmt a JOIN stmt b USING (feature_id, source_id, type) WHERE {OVERLAP} AND a.observed_at < b.observed_at GROUP BY 1")
def supersede_backfill(spark, d):
    return li.supersede_backfill(tb.claims(spark, d))


@query("""SELECT id, opened_at FROM stmt JOIN (SELECT feature_id, source_id, max(observed_at) AS opened_at FROM stmt WHERE type = 'opening' GROUP BY ALL) USING (feature_id, source_id)
WHERE type = 'closure' AND valid_from IS NULL AND valid_to IS NULL AND observed_at < opened_at""")
def lift_undated_closures(spark, d):
    return li.lift_undated_closures(tb.claims(spark, d)).select("id", "opened_at")


@query("""latest AS (SELECT feature_id, source_id, type, status, evidence, max(reviewed_at) AS carried FROM stmt
  WHERE reviewed_at IS NOT NULL AND superseded_at IS NULL AND trim(evidence) <> '' AND document_id % 2 = 0 GROUP BY ALL) -- main
SELECT id, CASE WHEN needs_review AND reviewed_at IS NULL THEN carried ELSE reviewed_at END AS reviewed_at,
  CASE WHEN needs_review AND reviewed_at IS NULL AND carried IS NOT NULL THEN '[carried forward] ' || CAST(carried AS VARCHAR) END AS review_note
FROM stmt LEFT JOIN latest USING (feature_id, source_id, type, status, evidence) WHERE document_id % 2 = 1""")
def inherit_review(spark, d):
    c = tb.claims(spark, d)
    return li.inherit_review(c.filter("document_id % 2 = 1"), c.filter("document_id % 2 = 0")).select("id", "reviewed_at", "review_note")


@query("""linked AS (SELECT *, lead(id) OVER (PARTITION BY feature_id, source_id ORDER BY observed_at, id) AS successor FROM stmt) -- main
SELECT a.id, CASE WHEN a.successor IS NOT NULL AND a.superseded_at IS NULL THEN coalesce(b.observed_at, $as_of) ELSE a.superseded_at END AS superseded_at FROM linked a LEFT JOIN stmt b ON a.successor = b.id""")
def backfill_from_successor(spark, d):
    from pyspark.sql import Window

    after = F.lead("id").over(Window.partitionBy("feature_id", "source_id").orderBy("observed_at", "id"))
    return li.backfill_from_successor(tb.claims(spark, d).withColumn("superseded_by", after), AS_OF).select("id", "superseded_at")


CUTOFF = """cut AS (SELECT source_id, started_at AS cutoff FROM (SELECT run.*, retire_after, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS place
  FROM run JOIN src USING (source_id) WHERE ok AND retire_after IS NOT NULL) WHERE place = retire_after)"""


@query(f"{CUTOFF} -- main\nSELECT id, cutoff FROM stmt JOIN cut USING (source_id) WHERE last_seen_at < cutoff")
def retire_unmentioned(spark, d):
    return li.retire_unmentioned(tb.claims(spark, d), tb.runs(spark, d), tb.sources(spark, d)).select("id", "cutoff")


@query("""SELECT CASE WHEN source_id = 4 AND superseded_at >= DATE '1997-01-01' AND superseded_by IS NULL AND superseded_at - last_seen_at > 0 THEN 'unmentioned' ELSE retired_reason END AS retired_reason, source_id, count(*) AS n FROM stmt GROUP BY ALL""")
def unmentioned_backfill(spark, d):
    return li.unmentioned_backfill(tb.claims(spark, d), 4, "1997-01-01").groupBy("retired_reason", "source_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""again AS (SELECT * REPLACE (id || '+' AS id, seq + (SELECT max(seq) FROM stmt) AS seq) FROM stmt WHERE document_id % 7 = 0 AND severity > 0),
every AS (SELECT * FROM stmt WHERE document_id NOT IN (SELECT document_id FROM again) UNION ALL SELECT * FROM again),
gone AS (SELECT a.id FROM every a JOIN every b USING (feature_id, source_id, type) WHERE {OVERLAP} AND (b.seq > a.seq OR (b.seq = a.seq AND b.id > a.id)) AND a.observed_at <= b.observed_at),
alive AS (SELECT * FROM every WHERE id NOT IN (SELECT id FROM gone)),
opened AS (SELECT feature_id, source_id, max(observed_at) AS opened_at FROM alive WHERE type = 'opening' GROUP BY ALL) -- main
SELECT id, seq FROM alive a WHERE NOT (type = 'closure' AND valid_from IS NULL AND valid_to IS NULL AND EXISTS (SELECT 1 FROM opened o WHERE o.feature_id = a.feature_id AND o.source_id = a.source_id AND a.observed_at < opened_at))""")
def supersede_by_document(spark, d):
    c = tb.claims(spark, d)
    again = c.filter("document_id % 7 = 0 and severity > 0").withColumn("id", F.concat("id", F.lit("+")))
    return li.supersede_by_document(c, again).select("id", "seq")


@query("SELECT source_id, count(*) AS n FROM stmt WHERE document_id % 3 < 2 GROUP BY 1")
def append_statements(spark, d):
    c = tb.claims(spark, d)
    return li.append_statements(c.filter("document_id % 3 = 0"), c.filter("document_id % 3 < 2")).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'claims' AS name, count(*) AS n FROM stmt WHERE source_id <> 5 UNION ALL SELECT 'runs', count(*) FROM run WHERE source_id <> 5")
def purge_source(spark, d):
    kept = li.purge_source({"claims": tb.claims(spark, d), "runs": tb.runs(spark, d)}, 5)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in kept.items()]
    return parts[0].unionByName(parts[1])


SEASON = f"""live AS (SELECT * FROM stmt WHERE {LIVE}),
now AS (SELECT feature_id,
  arg_max(struct_pack(i := id, t := type), (severity, observed_at, id)) FILTER (type IN ('closure', 'restriction') AND status IN ('closed', 'restricted')) AS stop,
  arg_max(id, (observed_at, id)) FILTER (schedule) AS planned,
  arg_max(id, (observed_at, id)) FILTER (type = 'opening' AND NOT schedule AND status = 'unstaffed') AS unstaffed,
  arg_max(id, (observed_at, id)) FILTER (type = 'opening' AND NOT schedule AND status = 'open') AS opened FROM live GROUP BY 1),
ever AS (SELECT feature_id, arg_max(id, (last_seen_at, id)) FILTER (schedule) AS ever FROM stmt GROUP BY 1),
b AS (SELECT *, CASE WHEN stop IS NOT NULL THEN 1 WHEN planned IS NOT NULL THEN 2 WHEN unstaffed IS NOT NULL AND opened IS NULL THEN 3 WHEN opened IS NOT NULL THEN 4 WHEN ever IS NOT NULL THEN 5 ELSE 6 END AS branch
  FROM ever LEFT JOIN now USING (feature_id))"""


@query(f"""{SEASON} -- main
SELECT feature_id, branch, CASE branch WHEN 1 THEN CASE WHEN stop.t = 'closure' THEN 'closed' ELSE 'restricted' END WHEN 2 THEN 'open' WHEN 3 THEN 'unstaffed' WHEN 4 THEN 'open' WHEN 5 THEN 'closed' ELSE 'unknown' END AS season,
  CASE branch WHEN 2 THEN 'in_season' WHEN 5 THEN 'out_of_season' END AS reason, CASE branch WHEN 1 THEN stop.i WHEN 2 THEN planned WHEN 3 THEN unstaffed WHEN 4 THEN opened WHEN 5 THEN ever END AS claim_id FROM b""")
def season_status(spark, d):
    return se.season_status(tb.claims(spark, d), AS_OF)


@query("SELECT feature_id, id AS claim_id, observed_at, last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY last_seen_at DESC, observed_at DESC, id DESC) AS rn FROM stmt WHERE schedule) WHERE rn = 1")
def schedule_clocks(spark, d):
    return se.schedule_clocks(tb.claims(spark, d))


@query("""SELECT entity, state, min(day) AS start, max(day) AS "end" FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY entity, state ORDER BY day) AS INT) AS island FROM cal)
GROUP BY entity, state, island HAVING min(day) <= DATE '2024-01-15' AND max(day) >= DATE '2024-01-15'""")
def run_around(spark, d):
    return se.run_around(tb.calendar(spark, d), "2024-01-15")


SEASONS = """days AS (SELECT DISTINCT entity, day FROM cal), broken AS (SELECT *, coalesce(CAST(day - lag(day) OVER (PARTITION BY entity ORDER BY day) > 3 AS INT), 0) AS b FROM days),
grp AS (SELECT entity, day, sum(b) OVER (PARTITION BY entity ORDER BY day) AS g FROM broken), spans AS (SELECT entity, min(day) AS f, max(day) AS e FROM grp GROUP BY entity, g),
coming AS (SELECT entity, min(f) AS f, arg_min(e, f) AS e FROM spans WHERE e >= DATE '2024-01-10' GROUP BY 1),
win AS (SELECT entity, DATE '2024-01-10' AS start, e AS "end" FROM coming WHERE f - DATE '2024-01-10' <= 28)"""


@query(f'{SEASONS} -- main\nSELECT entity, start, "end" FROM win')
def season_from(spark, d):
    return se.season_from(tb.calendar(spark, d), "2024-01-10", gap=3)


@query(f"""{SEASONS} -- main
SELECT w.entity, w.start, w."end", count(*) FILTER (state IN ('view', 'click') AND day BETWEEN start AND "end") AS bookable FROM win w LEFT JOIN cal c ON c.entity = w.entity GROUP BY ALL""")
def bookable_in_window(spark, d):
    days = tb.calendar(spark, d)
    return se.bookable_in_window(days, se.season_from(days, "2024-01-10", gap=3), ("view", "click"))


@query("""SELECT source_id, type, count(*) AS total, count(*) FILTER (status = 'open') AS n_open, bool_and(status = 'unknown') AS pending,
CASE WHEN bool_and(status = 'unknown') THEN 'unknown' WHEN count(*) FILTER (status = 'open') = 0 THEN 'closed' WHEN count(*) FILTER (status = 'open') = count(*) THEN 'open' ELSE 'restricted' END AS status,
CASE WHEN bool_and(status = 'unknown') OR count(*) FILTER (status = 'open') = count(*) THEN 0 ELSE 1 END AS severity, CAST(count(*) FILTER (status = 'open') AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' open' AS note FROM stmt GROUP BY 1, 2""")
def sector_rollup(spark, d):
    items = tb.claims(spark, d).selectExpr("source_id", "type", "status = 'unknown' AS is_pending", "status = 'open' AS is_open")
    return se.sector_rollup(items, ["source_id", "type"])


@query("""SELECT user_id, lpad(min(CAST(hour(ts) AS VARCHAR).lpad(2, '0') || ':00'), 5, '0') AS opens, max(CAST(hour(ts) AS VARCHAR).lpad(2, '0') || ':30') AS closes FROM events GROUP BY 1""")
def day_window(spark, d):
    times = tb.base(spark, d, "events").selectExpr("user_id", "concat(hour(ts), ':00 - ', hour(ts), ':30') AS hours")
    return se.day_window(times, ["user_id"])


@query("""SELECT CASE WHEN strftime(ts + CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%H:%M') < '08:30' THEN 'before'
 WHEN strftime(ts + CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%H:%M') > '16:45' THEN 'after' ELSE 'inside' END AS phase, count(*) AS n FROM events GROUP BY 1""")
def pending_phase(spark, d):
    phase = se.pending_phase(F.col("ts").cast("timestamp"), F.lit("08:30"), F.lit("16:45"))
    return tb.base(spark, d, "events").groupBy(phase.alias("phase")).agg(F.count(F.lit(1)).alias("n"))


DESCRIBE = """CASE WHEN valid_from IS NULL AND valid_to IS NULL THEN NULL WHEN valid_from IS NULL THEN 'until ' || strftime(valid_to, '%-d %b %Y') WHEN valid_to IS NULL THEN 'from ' || strftime(valid_from, '%-d %b %Y')
 WHEN valid_from = valid_to THEN strftime(valid_from, '%-d %b %Y') WHEN year(valid_from) = year(valid_to) AND month(valid_from) = month(valid_to) THEN CAST(day(valid_from) AS VARCHAR) || '-' || strftime(valid_to, '%-d %b %Y')
 WHEN year(valid_from) = year(valid_to) THEN strftime(valid_from, '%-d %b') || ' - ' || strftime(valid_to, '%-d %b %Y') ELSE strftime(valid_from, '%-d %b %Y') || ' - ' || strftime(valid_to, '%-d %b %Y') END"""


@query(f"SELECT id, {DESCRIBE} AS told FROM stmt")
def describe_window(spark, d):
    return tb.claims(spark, d).select("id", se.describe_window(F.col("valid_from"), F.col("valid_to")).alias("told"))


@query("""SELECT id, CASE WHEN type <> 'opening' OR status = 'unknown' OR valid_from IS NULL THEN evidence WHEN valid_from <= $as_of AND severity = 3 THEN evidence
 WHEN valid_from <= $as_of AND valid_to IS NOT NULL AND severity = 1 THEN 'Wardened until ' || strftime(valid_to, '%-d %b %Y') WHEN valid_from <= $as_of THEN 'Open since ' || strftime(valid_from, '%-d %b %Y') ELSE 'Reopening ' || strftime(valid_from, '%-d %b %Y') END AS told FROM stmt""")
def phrase_for_now(spark, d):
    c = tb.claims(spark, d).selectExpr("*", "evidence AS summary", "severity = 3 AS approximate", "severity = 1 AS wardened")
    return c.select("id", se.phrase_for_now(AS_OF).alias("told"))


@query(f"""SELECT id, coalesce({DESCRIBE}, 'no dates') || CASE WHEN severity = 3 THEN ' (approximate)' ELSE '' END || CASE WHEN valid_to < $as_of THEN ' (past)' WHEN valid_from > $as_of THEN ' (not yet)' ELSE '' END AS label FROM stmt""")
def review_window_label(spark, d):
    return tb.claims(spark, d).withColumn("approximate", F.col("severity") == 3).select("id", se.review_window_label(AS_OF).alias("label"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'never' WHEN value * 60 < 60 THEN CAST(greatest(1, CAST(floor(value * 60 + 0.5) AS BIGINT)) AS VARCHAR) || ' min'
 WHEN value * 60 < 2880 THEN CAST(CAST(floor(value * 60 / 60 + 0.5) AS BIGINT) AS VARCHAR) || ' h' ELSE CAST(CAST(floor(value * 60 / 1440 + 0.5) AS BIGINT) AS VARCHAR) || ' d' END AS label FROM events""")
def age_label(spark, d):
    return tb.base(spark, d, "events").select("event_id", se.age_label(F.col("value") * 60).alias("label"))


@query("""SELECT event_id, strftime(ts + CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%-d %b %Y %H:%M') AS label FROM events""")
def local_time_label(spark, d):
    return tb.base(spark, d, "events").select("event_id", se.local_time_label(F.col("ts").cast("timestamp")).alias("label"))


QUEUE = "queue AS (SELECT id, feature_id, f.name, s.name AS source_name, observed_at FROM stmt JOIN feat f USING (feature_id) JOIN src s USING (source_id) WHERE needs_review AND reviewed_at IS NULL AND superseded_at IS NULL AND active)"


@query(f"{QUEUE} -- main\nSELECT id, name, source_name, observed_at FROM queue")
def review_queue(spark, d):
    return re.review_queue(tb.claims(spark, d), tb.features(spark, d), tb.sources(spark, d)).select("id", F.col("name"), "source_name", "observed_at")


@query(f"{QUEUE} -- main\nSELECT source_name, count(*) AS waiting, max($as_of - observed_at) AS oldest_days FROM queue GROUP BY 1")
def review_digest(spark, d):
    return re.review_digest(re.review_queue(tb.claims(spark, d), tb.features(spark, d), tb.sources(spark, d)), AS_OF)


@query("SELECT id, name, observed_at FROM stmt JOIN feat USING (feature_id) WHERE active AND superseded_at IS NULL AND (valid_from IS NULL OR valid_from <= $as_of) AND (valid_to IS NULL OR valid_to >= $as_of) ORDER BY observed_at DESC, id DESC LIMIT 200")
def editable_claims(spark, d):
    return re.editable_claims(tb.claims(spark, d), tb.features(spark, d), AS_OF).select("id", "name", "observed_at")


@query("SELECT a.id AS claim_id, b.id AS sibling_id, CASE WHEN b.needs_review AND b.reviewed_at IS NULL THEN 'waiting' ELSE 'accepted' END AS state FROM stmt a JOIN stmt b USING (document_id) WHERE a.superseded_at IS NULL AND b.superseded_at IS NULL AND a.id <> b.id")
def sibling_claims(spark, d):
    return re.sibling_claims(tb.claims(spark, d)).select("claim_id", "sibling_id", "state")


@query("""SELECT CASE WHEN severity = 0 THEN 'unknown type' WHEN evidence IS NULL THEN 'no summary' WHEN status IN ('open', 'closed', 'restricted') AND valid_from IS NULL AND valid_to IS NULL THEN 'no dates' END AS reject_reason, count(*) AS n FROM stmt GROUP BY 1""")
def manual_claim_check(spark, d):
    c = tb.claims(spark, d).selectExpr("* EXCEPT (type)", "CASE WHEN severity = 0 THEN 'strange' ELSE type END AS type", "evidence AS summary")
    return re.manual_claim_check(c).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("""dec AS (SELECT id, DATE '1998-01-01' AS nf, CASE WHEN severity = 1 THEN 'closed' END AS ns FROM stmt WHERE document_id % 5 = 0 AND severity < 2) -- main
SELECT s.id, coalesce(nf, valid_from) AS valid_from, coalesce(ns, status) AS status, to_json(list_filter([CASE WHEN nf IS NOT NULL AND nf IS DISTINCT FROM valid_from THEN 'valid_from' END, CASE WHEN ns IS NOT NULL AND ns <> status THEN 'status' END], lambda x: x IS NOT NULL))::VARCHAR AS changed FROM stmt s LEFT JOIN dec USING (id)""")
def apply_override(spark, d):
    c = tb.claims(spark, d)
    decisions = c.filter("document_id % 5 = 0 and severity < 2").selectExpr("id AS claim_id", "DATE'1998-01-01' AS valid_from", "CAST(NULL AS DATE) AS valid_to", "CASE WHEN severity = 1 THEN 'closed' END AS status")
    return re.apply_override(c, decisions).select("id", "valid_from", "status", F.to_json("changed").alias("changed"))


@query("SELECT id, CASE WHEN document_id % 4 = 0 THEN $as_of ELSE reviewed_at END AS reviewed_at, CASE WHEN document_id % 4 = 1 THEN $as_of ELSE superseded_at END AS superseded_at FROM stmt")
def review_decisions(spark, d):
    c = tb.claims(spark, d)
    decisions = c.filter("document_id % 4 < 2").selectExpr("id AS claim_id", "document_id % 4 = 0 AS accept")
    return re.apply_decisions(c, decisions, AS_OF).select("id", "reviewed_at", "superseded_at")


UNDATED = "valid_from IS NULL AND valid_to IS NULL AND status IN ('open', 'closed', 'restricted')"


@query(f"SELECT CASE WHEN {UNDATED} THEN 'unknown' ELSE status END AS status, CASE WHEN {UNDATED} THEN status END AS undated_status, count(*) AS n FROM stmt GROUP BY ALL")
def demote_undated(spark, d):
    return re.demote_undated(tb.claims(spark, d)).groupBy("status", "undated_status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN valid_from IS NULL OR valid_to IS NULL THEN 'unknown' ELSE status END AS status, CASE WHEN valid_from IS NULL OR valid_to IS NULL THEN 0 ELSE severity END AS severity, count(*) AS n FROM stmt GROUP BY 1, 2")
def demote_unbounded(spark, d):
    return re.demote_unbounded(tb.claims(spark, d)).groupBy("status", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN type = 'opening' AND severity = 1 THEN valid_from + 30 ELSE valid_to END AS valid_to FROM stmt")
def widen_single_day_opening(spark, d):
    c = tb.claims(spark, d).withColumn("date_rule", F.when(F.col("severity") == 1, "single_named").otherwise("full_range"))
    return re.widen_single_day_opening(c).select("id", "valid_to")


@query(f"{STATUS} -- main\nSELECT feature_id, f.name, status, w.type, s.name AS source_name, p.name AS parent_name FROM feat f LEFT JOIN stat t USING (feature_id) LEFT JOIN stmt w ON w.id = t.claim_id LEFT JOIN src s ON s.source_id = t.source_id LEFT JOIN (SELECT feature_id AS pid, name FROM feat) p ON p.pid = f.parent_id".replace("SELECT feature_id, f.name, status,", "SELECT f.feature_id, f.name, t.status,"))
def features_view(spark, d):
    view = sv.features_view(tb.features(spark, d), status_of(spark, d), tb.claims(spark, d), tb.sources(spark, d))
    return view.select("feature_id", "name", "status", "type", "source_name", "parent_name")


@query(f"{STATUS} -- main\nSELECT f.feature_id, f.name, t.status FROM feat f JOIN stat t ON t.feature_id = f.feature_id WHERE active AND kind = 'economy' AND status = 'closed'")
def feature_filter(spark, d):
    view = tb.features(spark, d).join(status_of(spark, d), "feature_id")
    return sv.feature_filter(view, "economy", "closed").select("feature_id", "name", "status")


@query(f"{STATUS} -- main\nSELECT parent_id, f.feature_id, name, coalesce(t.status, 'unknown') AS status FROM feat f LEFT JOIN stat t ON t.feature_id = f.feature_id WHERE parent_id IS NOT NULL")
def children_of(spark, d):
    return sv.children_of(tb.features(spark, d), status_of(spark, d))


@query("SELECT id, feature_id, f.name, s.name AS source_name, type, status, observed_at FROM stmt JOIN feat f USING (feature_id) JOIN src s USING (source_id) WHERE superseded_at IS NULL ORDER BY observed_at DESC, id DESC LIMIT 200")
def feed(spark, d):
    return sv.feed(tb.claims(spark, d), tb.features(spark, d), tb.sources(spark, d), 500)


@query(f"{STATUS} -- main\nSELECT count(*) FILTER (status IN ('closed', 'restricted')) AS notices, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status = 'restricted') AS restricted, count(*) FILTER (status = 'unknown') AS asleep FROM stat")
def notice_mix(spark, d):
    return sv.notice_mix(status_of(spark, d))


@query(f"{STATUS} -- main\nSELECT f.feature_id, row_number() OVER (ORDER BY t.severity DESC, name, f.feature_id) AS place FROM feat f JOIN stat t ON t.feature_id = f.feature_id WHERE status IN ('closed', 'restricted')")
def ledger_notices(spark, d):
    view = tb.features(spark, d).join(status_of(spark, d).filter("status in ('closed', 'restricted')"), "feature_id")
    return sv.ledger(view, F.desc("severity"), "name").select("feature_id", "place")


@query(f"{STATUS} -- main\nSELECT f.feature_id, row_number() OVER (ORDER BY CASE t.status WHEN 'closed' THEN 0 WHEN 'restricted' THEN 1 WHEN 'open' THEN 2 WHEN 'unstaffed' THEN 3 WHEN 'unknown' THEN 4 ELSE 5 END, name, f.feature_id) AS place FROM feat f JOIN stat t ON t.feature_id = f.feature_id WHERE kind = 'small'")
def ledger_lifts(spark, d):
    view = tb.features(spark, d).filter("kind = 'small'").join(status_of(spark, d), "feature_id")
    return sv.ledger(view, sv.season_rank(F.col("status")), "name").select("feature_id", "place")


@query("SELECT feature_id, row_number() OVER (ORDER BY coalesce(altitude_m, -1) DESC, name, feature_id) AS place FROM feat WHERE kind = 'economy'")
def ledger_huts(spark, d):
    return sv.ledger(tb.features(spark, d).filter("kind = 'economy'"), F.desc(F.coalesce("altitude_m", F.lit(-1))), "name").select("feature_id", "place")


@query("SELECT feature_id, row_number() OVER (ORDER BY coalesce(altitude_m, 0) DESC, name, feature_id) AS place FROM feat WHERE parent_id IS NULL")
def ledger_routes(spark, d):
    return sv.ledger(tb.features(spark, d).filter("parent_id is null"), F.desc(F.coalesce("altitude_m", F.lit(0))), "name").select("feature_id", "place")


@query("SELECT kind, count(*) AS n FROM feat WHERE kind IS NOT NULL GROUP BY 1")
def country_counts(spark, d):
    return sv.country_counts(tb.features(spark, d), "kind")


@query("SELECT feature_id, name FROM feat WHERE contains(lower(name), 'widg')")
def substring_search(spark, d):
    return sv.substring_search(tb.features(spark, d), "WÏDG").select("feature_id", "name")


@query(f"{STATUS} -- main\nSELECT status IN ('closed', 'restricted') AS in_force, count(*) AS n FROM stat GROUP BY 1")
def split_notices(spark, d):
    return sv.split_notices(status_of(spark, d)).groupBy("in_force").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT feature_id, CASE WHEN parent_id IS NOT NULL AND altitude_m <> parent_id THEN CAST(altitude_m AS VARCHAR) || '-' || CAST(parent_id AS VARCHAR) || ' m' ELSE CAST(coalesce(parent_id, altitude_m) AS VARCHAR) || ' m' END AS label FROM feat")
def altitude_label(spark, d):
    return tb.features(spark, d).select("feature_id", sv.altitude_label(F.col("altitude_m"), F.col("parent_id"), F.lit(None).cast("int")).alias("label"))


@query(f"{STATUS} -- main\nSELECT f.feature_id, CASE WHEN status IN ('open', 'closed', 'restricted', 'unstaffed') THEN status WHEN status IS NOT NULL THEN 'unknown' ELSE 'context' END AS colour FROM feat f LEFT JOIN stat t ON t.feature_id = f.feature_id")
def map_colour_state(spark, d):
    view = tb.features(spark, d).join(status_of(spark, d), "feature_id", "left")
    return view.select("feature_id", sv.map_colour_state(F.col("status"), F.col("status").isNotNull()).alias("colour"))


@query(f"{STATUS} -- main\nSELECT 'https://x.example/' || kind || '/' || CAST(f.feature_id AS VARCHAR) AS url, observed_at AS last_modified FROM feat f LEFT JOIN stat t ON t.feature_id = f.feature_id")
def sitemap_rows(spark, d):
    return sv.sitemap_rows(tb.features(spark, d).join(status_of(spark, d), "feature_id", "left"), "https://x.example")


RUNSTATE = """good AS (SELECT source_id, max(started_at) AS gs, arg_max(run_id, (started_at, run_id)) AS gr FROM run WHERE ok GROUP BY 1),
state AS (SELECT source_id, max(started_at) AS last_fetch_at, max(gs) AS last_success_at, count(*) FILTER (NOT ok AND (gs IS NULL OR (started_at, run_id) > (gs, gr))) AS failures FROM run LEFT JOIN good USING (source_id) GROUP BY 1)"""


@query(f"""{RUNSTATE}, err AS (SELECT source_id, 'run ' || CAST(arg_max(run_id, (started_at, run_id)) AS VARCHAR) AS last_error FROM run LEFT JOIN good USING (source_id) WHERE NOT ok AND (gs IS NULL OR (started_at, run_id) > (gs, gr)) GROUP BY 1) -- main
SELECT source_id, last_fetch_at, last_success_at, failures, last_error FROM state LEFT JOIN err USING (source_id)""")
def source_run_state(spark, d):
    return sv.source_run_state(tb.runs(spark, d).withColumn("error", F.concat(F.lit("run "), F.col("run_id").cast("string"))))


@query(f"{RUNSTATE} -- main\nSELECT source_id FROM src LEFT JOIN state USING (source_id) WHERE last_fetch_at IS NULL OR epoch(last_fetch_at::TIMESTAMP) + interval_min * least(pow(2, coalesce(failures, 0)), 8) * 60 <= epoch($as_of::TIMESTAMP)")
def due_sources(spark, d):
    joined = tb.sources(spark, d).join(sv.source_run_state(tb.runs(spark, d)), "source_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    return sv.due_sources(joined, AS_OF).select("source_id")


@query("SELECT max(started_at) FILTER (ok) AS last_ok, (SELECT count(*) FROM feat) AS features FROM run")
def health(spark, d):
    return sv.health(tb.runs(spark, d), tb.features(spark, d))


@query("SELECT source_id, name FROM src WHERE source_id NOT IN (1, 2, 5)")
def unserved_sources(spark, d):
    return sv.unserved_sources(tb.sources(spark, d), [1, 2, 5]).select("source_id", "name")


@query("SELECT feature_id, key, value, source_name FROM (SELECT fact.*, s.name AS source_name, row_number() OVER (PARTITION BY feature_id, key ORDER BY s.name, fetched_at DESC, value) AS rn FROM fact JOIN src s USING (source_id) WHERE value IS NOT NULL) WHERE rn = 1")
def merge_fact_values(spark, d):
    return fa.merge_fact_values(tb.facts(spark, d), tb.sources(spark, d))


@query('SELECT feature_id, key, count(DISTINCT value) AS "values" FROM fact WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) > 1')
def contested_facts(spark, d):
    return fa.contested_facts(tb.facts(spark, d))


@query("SELECT s.name AS source_name, max(fetched_at) AS fetched_at, count(*) AS facts FROM fact JOIN src s USING (source_id) GROUP BY 1")
def fact_sources(spark, d):
    return fa.fact_sources(tb.facts(spark, d), tb.sources(spark, d))


@query("SELECT feature_id, key, value, source_id, 'L' || CAST(source_id AS VARCHAR) AS licence FROM fact WHERE value IS NOT NULL AND key = 'beds' AND source_id IN (SELECT source_id FROM src WHERE source_id <> 3)")
def licence_gate(spark, d):
    licences = tb.sources(spark, d).selectExpr("source_id", "CASE WHEN source_id <> 3 THEN concat('L', source_id) END AS licence")
    return fa.licence_gate(tb.facts(spark, d), licences, ("beds",)).select("feature_id", "key", "value", "source_id", "licence")


@query("SELECT feature_id, source_id, key, CASE WHEN (feature_id, source_id) IN (SELECT (feature_id, source_id) FROM fact WHERE feature_id % 4 = 0) THEN 'new' ELSE value END AS value FROM fact")
def upsert_facts(spark, d):
    facts = tb.facts(spark, d).select("feature_id", "source_id", "key", "value")
    return fa.upsert_facts(facts, facts.filter("feature_id % 4 = 0").withColumn("value", F.lit("new")))


@query("SELECT feature_id, CASE WHEN feature_id % 6 = 0 THEN upper(name) ELSE name END AS name, kind FROM feat UNION ALL SELECT -feature_id, name, kind FROM feat WHERE feature_id % 9 = 0")
def upsert_dimension(spark, d):
    now = tb.features(spark, d).select("feature_id", "name", "kind")
    seed = now.filter("feature_id % 6 = 0").withColumn("name", F.upper("name")).unionByName(now.filter("feature_id % 9 = 0").withColumn("feature_id", -F.col("feature_id")))
    return fa.upsert_dimension(now, seed, "feature_id")


@query("SELECT source_id, CASE WHEN interval_min = 360 THEN 60 ELSE interval_min END AS interval_min FROM src UNION ALL SELECT source_id + 100, 5 FROM src WHERE source_id < 2")
def patch_config(spark, d):
    src = tb.sources(spark, d).select("source_id", "interval_min", tx.slugify(F.col("name")).alias("slug"))
    new = src.filter("source_id < 2").select((F.col("source_id") + 100).alias("source_id"), F.lit(5).alias("interval_min"), F.concat(F.lit("new-"), "slug").alias("slug")).unionByName(src)
    return fa.patch_config(src, src.select("source_id", F.lit(360).alias("old_interval"), F.lit(60).alias("new_interval")), new).select("source_id", "interval_min")


@query("SELECT feature_id, coalesce(parent_id, altitude_m * 2) AS parent_id FROM feat")
def fill_missing(spark, d):
    f = tb.features(spark, d).select("feature_id", "parent_id", "altitude_m")
    return fa.fill_missing(f, f.select("feature_id", (F.col("altitude_m") * 2).cast("long").alias("parent_id")), "feature_id", "parent_id").select("feature_id", "parent_id")


@query("SELECT feature_id, CASE WHEN NOT (parent_id IS NULL AND kind IN ('small', 'large')) THEN lat END AS lat FROM feat")
def geometry_reset(spark, d):
    return fa.geometry_reset(tb.features(spark, d), ("small", "large")).select("feature_id", "lat")


@query("SELECT feature_id, CASE WHEN feature_id % 2 = 0 THEN 'camptocamp' ELSE 'osm' END AS geom_source FROM feat")
def geometry_provenance(spark, d):
    f = tb.features(spark, d).withColumns({"external_ids": F.create_map(F.when(F.col("feature_id") % 2 == 0, "camptocamp").otherwise("osm"), F.lit("1")), "geom_source": F.lit(None).cast("string")})
    return fa.geometry_provenance(f).select("feature_id", "geom_source")


@query("SELECT source_id FROM src LEFT JOIN (SELECT source_id, max(fetched_at) AS newest FROM fact GROUP BY 1) USING (source_id) WHERE newest IS NULL OR newest + 7 <= DATE '2001-11-12'")
def due_facts(spark, d):
    return fa.due_facts(tb.facts(spark, d), tb.sources(spark, d), "2001-11-12").select("source_id")


@query("SELECT feature_id FROM feat WHERE feature_id NOT IN (SELECT feature_id FROM fact WHERE key = 'phone' AND value IS NOT NULL)")
def coverage_gap(spark, d):
    from ..operators.places import coverage_gap as gap

    return gap(tb.features(spark, d), tb.facts(spark, d), "phone").select("feature_id")
