"""Directories, routes, phrases and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as da
from ..functions import text as tx
from ..operators import docs as do
from ..operators import places as pl
from ..operators import resolve as rs
from ..operators import season as se
from ..operators import serve as sv
from ..operators import status as st
from ..sources import tables as tb
from . import jobs
from .claims_queries import OVERLAP, STATUS, status_of
from .registry import AS_OF, query
from .text_queries import ALIAS, BUILDING, CROSS, EXACT, INDEX, LOOSE, NEAR, RING, alias, index_of, similar, strip


@query(f"""dirf AS (SELECT feature_id, altitude_m, lat, lon, CASE WHEN feature_id % 5 = 0 THEN feature_id + 1 END AS curated, 'Customer#' || lpad(CAST(feature_id AS VARCHAR), 9, '0') AS name FROM feat),
a AS (SELECT feature_id, curated AS cand_id, 'curated' AS how FROM dirf WHERE curated IN (SELECT cand_id FROM cand)),
close AS MATERIALIZED (SELECT d.feature_id, c.cand_id, d.key AS dk, c.key AS ck FROM (SELECT *, {EXACT.format("name")} AS key FROM dirf WHERE curated IS NULL) d
  JOIN (SELECT *, {EXACT.format("name")} AS key FROM cand) c ON abs(c.altitude_m - d.altitude_m) <= 120),
scored AS MATERIALIZED (SELECT *, {similar("dk", "ck", 88)} AS score FROM close),
b AS (SELECT * FROM (SELECT feature_id, cand_id, 'name' AS how, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, cand_id) AS rn FROM scored WHERE score >= 88) WHERE rn = 1),
{NEAR}, p AS (SELECT feature_id, min(cand_id) AS cand_id, 'position' AS how FROM near WHERE abs(fa - ca) <= 120 AND feature_id IN (SELECT feature_id FROM dirf WHERE curated IS NULL) AND feature_id NOT IN (SELECT feature_id FROM b) GROUP BY 1 HAVING count(*) = 1) -- main
SELECT * FROM a UNION ALL SELECT feature_id, cand_id, how FROM b UNION ALL SELECT * FROM p""")
def match_directory(spark, d):
    f = tb.features(spark, d).withColumns({"curated_id": F.when(F.col("feature_id") % 5 == 0, F.col("feature_id") + 1), "name": F.concat(F.lit("Customer#"), F.lpad(F.col("feature_id").cast("string"), 9, "0"))})
    return pl.match_directory(f, tb.candidates(spark, d))


@query(f"""f AS (SELECT feature_id, name || ' ' || CAST(feature_id % 60 AS VARCHAR) AS n, CASE WHEN feature_id % 4 = 0 THEN feature_id + 1 END AS pin, altitude_m AS c FROM feat),
r AS (SELECT p_partkey AS route_id, p_name || ' ' || CAST(p_partkey % 60 AS VARCHAR) AS n, p_size * 90 AS c, CAST(p_size AS DOUBLE) AS s, p_partkey % 9 <> 0 AS i FROM part),
ab AS MATERIALIZED (SELECT a.n AS fn, b.n AS rn FROM (SELECT DISTINCT n FROM f) a, (SELECT DISTINCT n FROM r) b),
k0 AS MATERIALIZED (SELECT fn, rn, {similar("fn", "rn", 84)} AS score FROM ab), k AS (SELECT * FROM k0 WHERE score >= 84),
p AS (SELECT f.feature_id, f.c AS fc, r.*, 0 AS tier, 100.0 AS score FROM f JOIN r ON pin = route_id UNION ALL
  SELECT f.feature_id, f.c, r.*, CASE WHEN f.n = r.n THEN 1 ELSE 2 END, score FROM f JOIN k ON k.fn = f.n JOIN r ON r.n = k.rn WHERE pin IS NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY tier, score DESC, route_id) AS nth FROM p) -- main
SELECT feature_id, route_id, tier, CASE WHEN abs(fc - c) > 250 THEN 'climb differs' WHEN s > 30 THEN 'too long' WHEN NOT i THEN 'leaves the box' END AS reason FROM m WHERE nth = 1""")
def reconcile_route(spark, d):
    f = tb.features(spark, d).selectExpr("feature_id", "concat(name, ' ', feature_id % 60) AS name", "CASE WHEN feature_id % 4 = 0 THEN feature_id + 1 END AS pinned_id", "altitude_m AS climb_m")
    r = tb.base(spark, d, "part").selectExpr("p_partkey AS route_id", "concat(p_name, ' ', p_partkey % 60) AS name", "p_size * 90 AS climb_m", "CAST(p_size AS DOUBLE) AS span_km", "p_partkey % 9 <> 0 AS inside")
    return pl.reconcile_route(f, r)


@query(f"""l AS (SELECT cand_id AS line_id, CASE WHEN cand_id % 2 = 0 THEN name ELSE 'Twin line ' || CAST(cand_id % 50 AS VARCHAR) END AS name, lat, lon, CAST(cand_id % 12 AS DOUBLE) AS span FROM cand),
i AS (SELECT *, {EXACT.format("name")} AS key FROM l WHERE ({CROSS}) % 2 = 1 AND span <= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY replace(key, ' ', '-') ORDER BY line_id) AS nth FROM i WHERE key NOT IN (SELECT {EXACT.format("name")} FROM cand WHERE cand_id % 4 = 0)) -- main
SELECT line_id, replace(key, ' ', '-') || CASE WHEN nth > 1 THEN '-' || CAST(nth AS VARCHAR) ELSE '' END AS slug FROM k""")
def new_features_from_lines(spark, d):
    c = tb.candidates(spark, d)
    lines = c.selectExpr("cand_id AS line_id", "CASE WHEN cand_id % 2 = 0 THEN name ELSE concat('Twin line ', cand_id % 50) END AS name", "lat", "lon", "CAST(cand_id % 12 AS DOUBLE) AS span_km")
    return pl.new_features_from_lines(lines, c.filter("cand_id % 4 = 0"), RING).select("line_id", "slug")


SCOPED = f"""sole AS (SELECT tier, key, min(feature_id) AS owner FROM idx GROUP BY 1, 2 HAVING count(*) = 1),
asked AS (SELECT p_partkey, {ALIAS.format(name="p_name", id="p_partkey")} AS mention, CASE WHEN p_partkey % 3 > 0 THEN p_size * 100 END AS alt FROM part),
m AS (SELECT p_partkey, mention, alt, coalesce(e.owner, t.owner, l.owner) AS fid FROM asked LEFT JOIN sole e ON e.tier = 'exact' AND e.key = {EXACT.format('mention')}
 LEFT JOIN sole t ON t.tier = 'tight' AND t.key = {strip(EXACT.format('mention'), BUILDING)} LEFT JOIN sole l ON l.tier = 'loose' AND l.key = {strip(EXACT.format('mention'), LOOSE)}),
lost AS (SELECT DISTINCT mention, {strip(EXACT.format('mention'), LOOSE)} AS m_key FROM m WHERE fid IS NULL), keys AS (SELECT DISTINCT key FROM idx WHERE tier = 'loose'),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, key) AS place FROM (SELECT mention, key, {similar('m_key', 'key', 88)} AS score FROM lost, keys) WHERE score >= 88) WHERE place <= 5),
owned AS (SELECT mention, score, feature_id, max(score) OVER (PARTITION BY mention) AS best FROM top JOIN idx USING (key) WHERE tier = 'loose'),
near AS (SELECT mention, CASE WHEN max(score) >= 88 AND min(feature_id) FILTER (score = best) = max(feature_id) FILTER (score = best) THEN min(feature_id) FILTER (score = best) END AS nid FROM owned GROUP BY 1),
n AS (SELECT p_partkey, alt, coalesce(fid, nid) AS fid FROM m LEFT JOIN near USING (mention)),
told AS (SELECT p_partkey, fid, CASE WHEN fid IS NULL THEN 'no match' WHEN f.altitude_m IS NULL OR alt IS NULL THEN 'altitude unknown' WHEN abs(f.altitude_m - alt) > 200 THEN 'altitude differs' END AS reason FROM n LEFT JOIN feat f ON f.feature_id = fid)"""


def scoped(spark, d):
    asked = tb.base(spark, d, "part").select("p_partkey", alias("p_name", "p_partkey").alias("mention"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") * 100).alias("altitude_m"))
    return rs.scoped_altitude_match(asked, index_of(spark, d), tb.features(spark, d))


@query(f"{INDEX}, {SCOPED} -- main\nSELECT p_partkey, fid AS feature_id, reason FROM told")
def scoped_altitude_match(spark, d):
    return scoped(spark, d).select("p_partkey", "feature_id", "reason")


@query(f"{INDEX}, {SCOPED} -- main\nSELECT coalesce(reason, 'matched') AS reason, count(*) AS n FROM told GROUP BY 1")
def match_report(spark, d):
    return pl.match_report(scoped(spark, d))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def pending_documents(spark, d):
    docs = tb.base(spark, d, "documents").select("doc_id", F.col("doc_id").alias("document_id"), F.col("source").alias("source_id"), F.lit("2026-01-01").cast("timestamp").alias("fetched_at"), F.when(F.col("doc_id") % 3 == 0, F.lit("2026-01-02").cast("timestamp")).alias("extracted_at"))
    return do.pending_documents(docs).select("doc_id")


@query(f"{STATUS} -- main\nSELECT f.feature_id FROM feat f LEFT JOIN stat t ON t.feature_id = f.feature_id WHERE parent_id IS NULL AND t.claim_id IS NOT NULL")
def tracked_with_status(spark, d):
    view = tb.features(spark, d).join(status_of(spark, d), "feature_id", "left").withColumn("reason", F.lit(None).cast("string"))
    return sv.tracked(view).select("feature_id")


@query(f"""{STATUS}, v AS (SELECT f.feature_id, t.status, t.claim_id, CASE WHEN f.feature_id % 3 = 0 THEN 'in_season' WHEN f.feature_id % 3 = 1 THEN '"said so"' END AS reason,
  CASE WHEN coalesce(stale_after < $as_of, false) THEN 'old' END AS doubt FROM feat f LEFT JOIN stat t ON t.feature_id = f.feature_id) -- main
SELECT feature_id, status IS DISTINCT FROM 'open' OR doubt IS NOT NULL AS exceptional, coalesce(reason, claim_id, 'Nothing reported') AS said, coalesce(reason LIKE '"%', false) AS quoted FROM v""")
def exceptional_and_said(spark, d):
    view = tb.features(spark, d).join(status_of(spark, d), "feature_id", "left")
    reason = F.when(F.col("feature_id") % 3 == 0, "in_season").when(F.col("feature_id") % 3 == 1, '"said so"')
    doubt = F.when(F.coalesce(st.is_stale(AS_OF), F.lit(False)), "old")
    told = view.select("feature_id", sv.exceptional(F.col("status"), doubt).alias("exceptional"), sv.said_about(reason, F.col("claim_id")).alias("s"))
    return told.select("feature_id", "exceptional", F.col("s.text").alias("said"), F.col("s.quoted").alias("quoted"))


@query(f"""{STATUS} -- main
SELECT f.feature_id, coalesce(CASE WHEN t.status IN ('open', 'closed', 'restricted', 'unstaffed') THEN t.status WHEN t.status IS NOT NULL THEN 'unknown' END, 'context') AS colour, t.status IS NOT NULL AS known, f.feature_id % 4 = 0 AS schematic,
  f.name || ': ' || coalesce(t.status, 'unknown') AS summary, CASE WHEN f.feature_id % 4 = 0 THEN 2 ELSE 3 END AS points FROM feat f LEFT JOIN stat t ON t.feature_id = f.feature_id WHERE f.feature_id % 4 <> 1""")
def geojson_lines(spark, d):
    f = tb.features(spark, d).join(status_of(spark, d), "feature_id", "left")
    point = F.struct("lon", "lat")
    lines = f.withColumn("geometry", F.when(F.col("feature_id") % 4 == 1, F.array(point)).when(F.col("feature_id") % 4 == 0, F.array(point, point)).otherwise(F.array(point, point, point)))
    read = sv.geojson_lines(lines).select("feature_id", F.from_json("json", "type string, geometry struct<type:string,coordinates:array<array<double>>>, properties struct<colour:string,known:boolean,schematic:boolean,summary:string>").alias("j"))
    return read.filter("j.geometry.type = 'LineString'").select("feature_id", "j.properties.*", F.size("j.geometry.coordinates").alias("points")).select("feature_id", "colour", "known", "schematic", "summary", "points")


MONTHS = "['janvier', 'fevrier', 'mars', 'avril', 'mai', 'juin', 'juillet', 'aout', 'septembre', 'octobre', 'novembre', 'decembre']"


def month_name(c):
    return F.get(F.array(*(F.lit(m) for m in da.MONTHS_FR)), F.month(c) - 1)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "start", CAST(o_orderdate AS DATE) + 9 AS "end" FROM orders WHERE month(CAST(o_orderdate AS DATE)) = month(CAST(o_orderdate AS DATE) + 9)""")
def assume_year(spark, d):
    """Spans within one month, written without their year, read back with it."""
    a = F.to_date("o_orderdate")
    o = tb.base(spark, d, "orders").filter(F.month(a) == F.month(F.date_add(a, 9)))
    phrase = F.concat(F.lit("du "), F.dayofmonth(a).cast("string"), F.lit(" au "), F.dayofmonth(F.date_add(a, 9)).cast("string"), F.lit(" "), month_name(a))
    w = o.select("o_orderkey", da.assume_year(phrase, F.year(a)).alias("w"))
    return w.select("o_orderkey", "w.start", "w.end")


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) < 12 THEN CAST(date_trunc('month', o_orderdate) AS DATE) + 9 END AS "start", CASE WHEN month(o_orderdate) < 12 THEN CAST(date_trunc('month', o_orderdate + INTERVAL 1 MONTH) AS DATE) + 20 END AS "end" FROM orders""")
def extract_coarse_window(spark, d):
    a = F.to_date("o_orderdate")
    phrase = F.concat(F.lit("gardé début "), month_name(a), F.lit(" à fin "), month_name(F.add_months(a, 1)))
    w = tb.base(spark, d, "orders").select("o_orderkey", da.extract_coarse_window(phrase, F.year(a)).alias("w"))
    return w.select("o_orderkey", "w.start", "w.end")


@query("""SELECT o_orderkey % 2 = 0 AS agrees, count(*) AS n FROM orders GROUP BY 1""")
def cross_check_window(spark, d):
    a = F.to_date("o_orderdate")
    said = F.concat(F.lit("le "), F.dayofmonth(a).cast("string"), F.lit(" "), month_name(a), F.lit(" "), F.year(a).cast("string"))
    claimed = F.date_format(F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(F.date_add(a, 1)), "yyyy-MM-dd")
    checked = tb.base(spark, d, "orders").select(da.cross_check_window(da.extract_date_window(said), claimed, claimed).alias("c"))
    return checked.groupBy(F.col("c.complaint").isNull().alias("agrees")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + 60 AS valid_to FROM orders""")
def timetable_to_claims(spark, d):
    a, b = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 60)

    def full(c):
        return F.concat_ws(" ", F.dayofmonth(c).cast("string"), month_name(c), F.year(c).cast("string"))

    pages = tb.base(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Horaires du "), full(a), F.lit(" au "), full(b), F.lit(". Rappel: du "), full(a), F.lit(" au "), full(b)).alias("text"))
    return jobs.timetable_to_claims(pages).select("doc_id", "valid_from", "valid_to")


# Each fourth order has two labelled pairs in one block, a pair without label, a season on one line, or one in words.
SEASONS = """o AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS kind, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 60 AS b FROM orders)"""
PAIRS = """SELECT doc_id, 'Printemps' AS label, a AS valid_from, a + 9 AS valid_to FROM o WHERE kind = 0
UNION ALL SELECT doc_id, 'Été', a + 20, b FROM o WHERE kind = 0 UNION ALL SELECT doc_id, NULL, a, b FROM o WHERE kind = 1"""


def season_text(spark, d):
    a = F.to_date("o_orderdate")

    def full(days):
        c = F.date_add(a, days)
        return F.concat_ws(" ", F.dayofmonth(c).cast("string"), month_name(c), F.year(c).cast("string"))

    def opens(start, end):
        return F.concat(F.lit("Ouverture du refuge le "), full(start)), F.concat(F.lit("Fermeture du refuge le "), full(end), F.lit(" à 7h"))

    kind = F.col("o_orderkey") % 4
    apart = F.array(F.lit("Période de gardiennage :"), F.lit("Printemps :"), *opens(0, 9), F.lit(""), F.lit("Été :"), *opens(20, 60))
    lines = F.when(kind == 0, apart).when(kind == 1, F.array(*opens(0, 60))).when(kind == 2, F.array(F.concat(F.lit("Été : "), full(0), F.lit(" au "), full(60)))).otherwise(
        F.array(F.lit("Fermeture annuelle inconnue"), F.lit("Période de gardiennage : De mi juin à fin septembre"))
    )
    o = tb.base(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("block"), F.year(a).alias("year"), F.posexplode(lines).alias("place", "line"))
    return o


@query(f"{SEASONS} -- main\n{PAIRS}")
def open_close_pairs(spark, d):
    return jobs.open_close_pairs(jobs.season_lines(season_text(spark, d))).select("doc_id", "label", "valid_from", "valid_to")


@query(f"""{SEASONS} -- main
SELECT *, false AS approximate FROM ({PAIRS}) UNION ALL SELECT doc_id, 'Été', a, b, false FROM o WHERE kind = 2
UNION ALL SELECT doc_id, NULL, make_date(year(a), 6, 20), make_date(year(a), 9, 21), true FROM o WHERE kind = 3""")
def warden_seasons_to_claims(spark, d):
    return jobs.warden_seasons_to_claims(season_text(spark, d)).select("doc_id", "label", "valid_from", "valid_to", "approximate")


# Rows at five depths of one block for each customer: a hidden one, one without a day, and a season inside a season.
@query("""o AS (SELECT o_custkey AS id, lower(o_orderpriority) AS title, CAST(o_orderdate AS DATE) AS s, o_orderkey % 5 AS depth FROM orders) -- main
SELECT id, CASE depth WHEN 4 THEN 'inner' ELSE 'outer' END AS season, title, min(s) AS "start", max(s + 9) AS "end" FROM o WHERE depth <> 3 GROUP BY ALL""")
def explode_nested_rows(spark, d):
    from ..sources.json_sources import explode_nested_rows as explode

    start = F.to_date("o_orderdate")
    row = F.struct(F.col("o_orderpriority").alias("title"), F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(F.date_add(start, 9), "yyyy-MM-dd").alias("end"))
    o = tb.base(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 5).alias("depth"), row.alias("row"))
    at = [F.collect_list(F.when(F.col("depth") == k, F.col("row"))) for k in range(5)]
    b = o.groupBy("id").agg(*(a.alias(f"r{k}") for k, a in enumerate(at)))
    deep = F.struct(F.lit("inner").alias("season"), F.struct(F.array(F.struct(F.col("r4").alias("rows"))).alias("tables")).alias("page"))
    hidden = F.struct(F.lit(True).alias("hidden"), F.col("r3").alias("rows"))
    block = F.struct(F.lit("outer").alias("season"), F.col("r0").alias("top"), F.struct(F.col("r1").alias("rows"), F.array(F.struct(F.col("r2").alias("list"))).alias("more"), hidden.alias("aside")).alias("x"), F.array(deep).alias("y"), F.lit("no date").alias("title"))
    return explode(b.select("id", F.to_json(F.array(block)).alias("json")), carry=("id",)).select("id", "season", "title", "start", "end")


@query("""SELECT season, title, min(s) AS "start", max(e) AS "end" FROM (SELECT o_custkey % 5 AS season, lower(o_orderpriority) AS title, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 9 AS e FROM orders) GROUP BY 1, 2""")
def calendar_to_claims(spark, d):
    from ..sources.json_sources import explode_nested_rows

    row = F.struct(F.lit(False).alias("hidden"), F.col("o_orderpriority").alias("title"), F.lit("").alias("subtitle"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.date_format(F.date_add(F.to_date("o_orderdate"), 9), "yyyy-MM-dd").alias("end"))
    blocks = tb.base(spark, d, "orders").select(F.to_json(F.array(F.struct(F.lit(False).alias("hidden"), (F.col("o_custkey") % 5).cast("string").alias("season"), F.array(row).alias("rows")))).alias("json"))
    rows = explode_nested_rows(blocks)
    claims = jobs.calendar_to_claims(rows)
    return rows.join(claims.select("title", F.col("valid_from").alias("start"), F.col("valid_to").alias("end")).distinct(), ["title", "start", "end"]).select(F.col("season").cast("long").alias("season"), "title", "start", "end")


@query(f"{NEAR}, one AS (SELECT feature_id, min(cand_id) AS cand_id FROM near WHERE abs(fa - ca) <= 120 GROUP BY 1 HAVING count(*) = 1) -- main\nSELECT feature_id, CAST(c.altitude_m AS VARCHAR) AS altitude, CASE WHEN c.cand_id % 3 <> 0 THEN CAST(c.cand_id % 3 AS VARCHAR) END AS capacity FROM one JOIN cand c USING (cand_id)")
def facts_from_directory(spark, d):
    c = tb.candidates(spark, d).withColumn("capacity", F.col("cand_id") % 3)
    facts = jobs.facts_from_directory(c, pl.match_by_position(tb.features(spark, d), c.drop("capacity")), ("altitude_m", "capacity"))
    return facts.select("feature_id", F.col("facts.altitude_m").alias("altitude"), F.col("facts.capacity").alias("capacity"))


@query("SELECT user_id % 7 AS entity, CAST(ts AS DATE) AS day, 'SERVICED' AS state, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def flatten_availability(spark, d):
    from ..sources.json_sources import flatten_availability as flatten

    cell = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("SERVICED").alias("hutStatus"), F.when(F.col("event_type") == "view", F.lit(2)).alias("freeBeds"))
    envelopes = tb.base(spark, d, "events").select(F.to_json(F.struct((F.col("user_id") % 7).cast("string").alias("feature_slug"), F.array(cell).alias("availability"))).alias("json"))
    return flatten(envelopes).groupBy(F.col("entity").cast("long").alias("entity"), "day", "state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS cand_id, c_name AS name, NULLIF(c_nationkey, 0) AS capacity, CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false END AS water FROM customer WHERE c_custkey % 10 <> 0")
def flatten_geojson(spark, d):
    from ..sources.json_sources import flatten_geojson as flatten

    water = F.when(F.col("c_custkey") % 3 == 0, "oui").when(F.col("c_custkey") % 3 == 1, "non").otherwise("?")
    props = F.struct(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).otherwise(" ").alias("nom"), F.struct(F.col("c_nationkey").alias("valeur")).alias("places"), F.struct(F.struct(water.alias("valeur")).alias("eau")).alias("info_comp"))
    raw = tb.base(spark, d, "customer").select(F.to_json(F.struct(F.array(F.struct(props.alias("properties"))).alias("features"))).alias("json"))
    return flatten(raw).select("cand_id", "name", "capacity", "water")


@query(f"""staged AS (SELECT * REPLACE (id || 'm' AS id, seq + 100000000 AS seq, 'closed' AS status) FROM stmt WHERE document_id % 50 = 0 AND evidence IS NOT NULL AND NOT (valid_from IS NULL AND valid_to IS NULL)),
every AS (SELECT * FROM stmt UNION ALL SELECT * FROM staged),
gone AS (SELECT a.id FROM every a JOIN every b USING (feature_id, source_id, type) WHERE {OVERLAP} AND (b.seq > a.seq OR (b.seq = a.seq AND b.id > a.id)) AND a.observed_at <= b.observed_at) -- main
SELECT DISTINCT feature_id FROM every WHERE id NOT IN (SELECT id FROM gone) AND feature_id IN (SELECT feature_id FROM staged)""")
def manual_write(spark, d):
    c = tb.claims(spark, d)
    staged = c.filter("document_id % 50 = 0").withColumns({"id": F.concat("id", F.lit("m")), "seq": F.col("seq") + 100000000, "status": F.lit("closed"), "summary": F.col("evidence")})
    return jobs.manual_write(c, staged, tb.sources(spark, d), AS_OF).select("feature_id")


LEXICON = [("keit", "quality"), ("eau", "water"), ("ing", "doing"), ("eaux", "water")]


@query("""SELECT doc_id, CASE WHEN f LIKE '%keit%' THEN 'quality ' ELSE '' END || CASE WHEN f LIKE '%eau%' THEN 'water ' ELSE '' END || CASE WHEN f LIKE '%ing%' THEN 'doing ' ELSE '' END AS terms FROM (SELECT doc_id, lower(strip_accents(text)) AS f FROM documents)""")
def glosses(spark, d):
    found = tb.base(spark, d, "documents").select("doc_id", tx.glosses(F.col("text"), LEXICON).alias("g"))
    return found.select("doc_id", F.concat(F.array_join("g", " "), F.when(F.size("g") > 0, " ").otherwise("")).alias("terms"))


@query("SELECT entity, state, count(*) AS runs FROM (SELECT entity, state, day - CAST(row_number() OVER (PARTITION BY entity, state ORDER BY day) AS INT) AS i FROM cal) WHERE false GROUP BY 1, 2 UNION ALL SELECT entity, state, 1 FROM (SELECT DISTINCT entity, state FROM cal WHERE day = DATE '2024-01-12')")
def runs_on_a_day(spark, d):
    r = se.run_around(tb.calendar(spark, d), "2024-01-12")
    return r.groupBy("entity", "state").agg(F.count(F.lit(1)).alias("runs"))
