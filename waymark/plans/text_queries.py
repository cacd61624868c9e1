"""Text, dates, pages, names, places and documents over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as da
from ..functions import geo as ge
from ..functions import text as tx
from ..operators import docs as do
from ..operators import lifecycle as li
from ..operators import places as pl
from ..operators import resolve as rs
from ..sources import tables as tb
from .registry import query

FOLD = "replace(lower(strip_accents({0})), 'ß', 'ss')"
# Fixed values, written out again so that the SQL does not depend on the code that it is held against.
BUILDING = "refuge|rifugio|refugio|hutte|cabane|capanna|bivouac|bivacco|du|de|des|la|le|les|del|della|di|d|l"
LOOSE = "refuge|rifugio|refugio|hutte|cabane|bivouac|bivacco|voie|route|via|arete|cresta|couloir|glacier|ghiacciaio|aiguille|mont|monte|pointe|punta|du|de|des|la|le|les|del|della|di|d|l"
MACHINE = "tph|tc|tcd|tsd|ts|tk|funi|telepherique|telecabine|telesiege|teleski|du|de|des|le|la|les|d"
DAYS = r"\b(lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|lunedi|martedi|mercoledi|giovedi|venerdi|sabato|domenica)\b"
OPENING = r"reouvert|reouverture|rouvre|levee de l'interdiction|levee de l'arrete|retabli|de nouveau accessible|reprise"
CLOSING = r"fermeture|fermes?\b|interdiction|interdit|interdite|suspendu|inaccessible|non accessible|demontage"
EXACT = "trim(regexp_replace(regexp_replace(replace(lower(strip_accents({0})), 'ß', 'ss'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def strip(inner: str, words: str) -> str:
    return f"trim(regexp_replace(regexp_replace({inner}, '\\b({words})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


DOC_EXACT = EXACT.format("left_part")
HEAD = "head AS (SELECT doc_id, text, substr(text, 1, 400) AS left_part FROM documents)"


def heads(spark, d):
    """Documents with the beginning of their text as a title-like column; the text itself stays whole."""
    return tb.base(spark, d, "documents").withColumn("left_part", F.substring("text", 1, 400))


@query(f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents")
def fold(spark, d):
    return tb.base(spark, d, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, {EXACT.format('text')} AS key FROM documents")
def key_exact(spark, d):
    return tb.base(spark, d, "documents").select("doc_id", tx.key_exact(F.col("text")).alias("key"))


@query(f"SELECT doc_id, {strip(EXACT.format('text'), BUILDING)} AS key FROM documents")
def key_tight(spark, d):
    return tb.base(spark, d, "documents").select("doc_id", tx.key_tight(F.col("text")).alias("key"))


@query(f"SELECT doc_id, {strip(EXACT.format('text'), LOOSE)} AS key FROM documents")
def key_loose(spark, d):
    return tb.base(spark, d, "documents").select("doc_id", tx.key_loose(F.col("text")).alias("key"))


@query(f"SELECT item_id, array_to_string(list_transform(string_split({EXACT.format('text')}, ' '), lambda w: CASE w WHEN 'rifugio' THEN 'refuge' WHEN 'refugio' THEN 'refuge' WHEN 'bivacco' THEN 'bivouac' WHEN 'biwak' THEN 'bivouac' WHEN 'capanna' THEN 'cabane' WHEN 'riparo' THEN 'abri' ELSE w END), ' ') AS key FROM benchmark")
def key_translated(spark, d):
    return tb.base(spark, d, "benchmark").select("item_id", tx.key_translated(F.col("text")).alias("key"))


@query(f"SELECT c_custkey, trim(regexp_replace({strip(EXACT.format('c_name'), MACHINE)}, '\\s*\\d+$', '')) AS key FROM customer")
def key_machine(spark, d):
    return tb.base(spark, d, "customer").select("c_custkey", tx.key_machine(F.col("c_name")).alias("key"))


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slugify(spark, d):
    return tb.base(spark, d, "documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents")
def collapse_space(spark, d):
    return tb.base(spark, d, "documents").select("doc_id", tx.collapse_space(F.col("text")).alias("flat"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(replace(lower(strip_accents(text)), 'ß', 'ss'), '‘’“”–—', '''''\"\"--'), '{DAYS}', ' ', 'g'), '\\s+', ' ', 'g')) AS flat FROM documents")
def fold_typography(spark, d):
    return tb.base(spark, d, "documents").select("doc_id", tx.fold_typography(F.col("text")).alias("flat"))


@query("SELECT doc_id, sha256(text) AS identity FROM documents")
def content_identity(spark, d):
    return tb.base(spark, d, "documents").select("doc_id", tx.content_identity(F.col("text")).alias("identity"))


@query("SELECT doc_id, source, text IS NOT NULL AS kept FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first_document(spark, d):
    docs = tb.base(spark, d, "documents").withColumn("identity", tx.content_identity(F.col("text")))
    return li.keep_first_document(docs, ["source", "identity"], F.col("doc_id")).select("doc_id", "source", F.col("text").isNotNull().alias("kept"))


@query("""pieces AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n•;]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?\n•;]+'), 1) AS p FROM documents) -- main
SELECT doc_id, count(*) AS n, sum(length(trim(s))) AS chars FROM pieces WHERE length(trim(s)) >= 12 GROUP BY 1""")
def split_sentences(spark, d):
    s = tb.base(spark, d, "documents").select("doc_id", F.explode(tx.split_sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


TITLED = """head AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Réouverture après fermeture ' WHEN 1 THEN 'Fermeture avant réouverture ' WHEN 2 THEN 'Accès interdit ' WHEN 3 THEN 'De nouveau accessible ' ELSE '' END || text AS title FROM documents)"""


def titled(spark, d):
    word = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Réouverture après fermeture ' WHEN 1 THEN 'Fermeture avant réouverture ' WHEN 2 THEN 'Accès interdit ' WHEN 3 THEN 'De nouveau accessible ' ELSE '' END")
    return tb.base(spark, d, "documents").withColumn("title", F.concat(word, "text"))


@query(f"""{TITLED} -- main
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'opening' WHEN 1 THEN 'closure' WHEN 2 THEN 'closure' WHEN 3 THEN 'opening'
  ELSE CASE WHEN regexp_matches({FOLD.format('title')}, '{CLOSING}') THEN 'closure' END END AS type FROM head""")
def classify_title(spark, d):
    return titled(spark, d).select("doc_id", tx.classify_title(F.col("title")).alias("type"))


@query(f"{TITLED} -- main\nSELECT CASE WHEN regexp_matches({FOLD.format('title')}, 'deconseill|impraticable|dangereux|pas en conditions|non praticable|delicat') THEN 'restriction' WHEN regexp_matches({FOLD.format('title')}, 'reouvert|rouvert|de nouveau|praticable|ouverte?s?\\b') THEN 'opening' END AS type, count(*) AS n FROM head GROUP BY 1")
def classify_sentence(spark, d):
    return titled(spark, d).groupBy(tx.classify_sentence(F.col("title")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT p_partkey, regexp_matches({EXACT.format('p_name')}, '\\b(ancien|ex|red|hot)\\b') AS old FROM part")
def decoy_filter(spark, d):
    name = F.regexp_replace(F.col("p_name"), r"^(red|hot)\b", "Ancien")
    return tb.base(spark, d, "part").select("p_partkey", tx.is_decoy(name).alias("old"))


@query(f"SELECT source AS page_id, count(*) FILTER (hit) AS kept, count(*) FILTER (NOT hit) AS skipped FROM (SELECT source, coalesce({FOLD.format('text')} LIKE '%fermeture%' OR {FOLD.format('text')} LIKE '%queau%', false) AS hit FROM documents) GROUP BY 1")
def relevance_gate(spark, d):
    links = tb.base(spark, d, "documents").select(F.col("source").alias("page_id"), "text")
    return do.relevance_gate(links, "text", "fermeture|queau")[1]


PROSE = """regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style|nav|header|footer|aside|form|noscript|iframe|svg)\\b[^>]*>.*?</(script|style|nav|header|footer|aside|form|noscript|iframe|svg)>', ' ', 'gis')"""


def unescaped(x: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&rsquo;", "’"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


ARTICLE = f"regexp_extract({PROSE}, '<article\\b[^>]*>(.*?)</article>', 1, 'is')"
PAGE = f"trim(regexp_replace({unescaped(f'''regexp_replace({ARTICLE}, '<[^>]*>', ' ', 'gs')''')}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {PAGE} AS prose FROM pages")
def page_prose(spark, d):
    return tb.base(spark, d, "pages").select("page_id", tx.page_prose(F.col("html")).alias("prose"))


TITLE = f"""trim(regexp_replace({unescaped("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is'), '<[^>]*>', ' ', 'gs')")}, '\\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {TITLE} AS title FROM pages")
def page_title(spark, d):
    return tb.base(spark, d, "pages").select("page_id", tx.page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, CASE WHEN trim(ltrim(CASE WHEN starts_with({PAGE}, {TITLE}) THEN substr({PAGE}, length({TITLE}) + 1) ELSE {PAGE} END)) = '' THEN substr({TITLE}, 1, 2000) ELSE substr(trim(CASE WHEN starts_with({PAGE}, {TITLE}) THEN ltrim(substr({PAGE}, length({TITLE}) + 1)) ELSE {PAGE} END), 1, 2000) END AS quote FROM pages")
def quote_body(spark, d):
    h = F.col("html")
    return tb.base(spark, d, "pages").select("page_id", tx.quote_body(tx.page_title(h), tx.page_prose(h)).alias("quote"))


@query("SELECT page_id, count(DISTINCT regexp_replace(l, '[?#].*$', '')) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1, 'is')) AS l FROM pages) GROUP BY 1")
def page_links(spark, d):
    return tb.base(spark, d, "pages").select("page_id", F.size(tx.page_links(F.col("html"))).cast("long").alias("links")).filter("links > 0")


@query("""l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1, 'is')) AS href, generate_subscripts(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1, 'is'), 1) AS p FROM pages),
u AS (SELECT page_id, regexp_replace(href, '[?#].*$', '') AS link, min(p) AS p FROM l GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p) AS nth, count(*) OVER (PARTITION BY page_id) AS total FROM u) -- main
SELECT page_id, link, nth, greatest(total - 3, 0) AS cut FROM n WHERE nth <= 3""")
def cap_articles(spark, d):
    links = tb.base(spark, d, "pages").select("page_id", F.posexplode(tx.page_links(F.col("html"))).alias("place", "link"))
    return do.cap_links(links, 3).select("page_id", "link", "nth", "cut")


@query(f"SELECT page_id, substr({PAGE}, 1, 900) AS prose FROM pages WHERE length({PAGE}) >= 400")
def text_length_gate(spark, d):
    pages = tb.base(spark, d, "pages").select("page_id", tx.page_prose(F.col("html")).alias("prose"))
    return do.text_length_gate(pages, 900)


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages")
def host_of(spark, d):
    return tb.base(spark, d, "pages").select("page_id", F.lower(tx.host_of(F.col("url"))).alias("host"))


@query("SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 3 = 0 THEN 'Yes' WHEN CAST(json_extract(props, '$.k') AS INT) % 3 = 1 THEN 'No' END AS told FROM events")
def tri_state(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 3
    return tb.base(spark, d, "events").select("event_id", tx.tri_state(F.when(k == 0, True).when(k == 1, False)).alias("told"))


@query("SELECT p_partkey, p_size AS metres FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 2 = 1")
def parse_metres(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" m env."))).otherwise("env.")
    return tb.base(spark, d, "part").select("p_partkey", tx.parse_metres(text).alias("metres"))


# Month names in two languages for texts made from the order dates.
MONTHS_SQL = "['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre']"


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS "start",
 CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderdate AS DATE) + 20 WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN NULL WHEN 3 THEN CAST(o_orderdate AS DATE) WHEN 4 THEN CAST(o_orderdate AS DATE) + 20 ELSE CAST(o_orderdate AS DATE) + 3 END AS "end",
 CASE o_orderkey % 6 WHEN 0 THEN 'full_range' WHEN 1 THEN 'single_named' WHEN 2 THEN 'from' WHEN 3 THEN 'until' WHEN 4 THEN 'numeric_range' ELSE 'from_until' END AS rule FROM orders""")
def extract_date_window(spark, d):
    """Date phrases written out from the order dates, read back."""
    months = F.array(*(F.lit(m) for m in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")))

    def named(c):
        return F.concat_ws(" ", F.dayofmonth(c).cast("string"), F.get(months, F.month(c) - 1), F.year(c).cast("string"))

    a = F.to_date("o_orderdate")
    b, c = F.date_add(a, 20), F.date_add(a, 3)
    k = F.col("o_orderkey") % 6
    phrase = (
        F.when(k == 0, F.concat(F.lit("Fermé du Vendredi "), named(a), F.lit(" au "), named(b)))
        .when(k == 1, F.concat(F.lit("le "), named(a)))
        .when(k == 2, F.concat(F.lit("à partir du "), named(a)))
        .when(k == 3, F.concat(F.lit("jusqu’au "), named(a)))
        .when(k == 4, F.concat(F.lit("du "), F.date_format(a, "dd/MM/yyyy"), F.lit(" au "), F.date_format(b, "d/M/yyyy")))
        .otherwise(F.concat(F.lit("du "), named(a), F.lit(" et jusqu'au "), named(c)))
    )
    w = tb.base(spark, d, "orders").select("o_orderkey", da.extract_date_window(phrase).alias("w"))
    return w.select("o_orderkey", "w.start", "w.end", "w.rule")


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def published_day(spark, d):
    return tb.base(spark, d, "orders").groupBy(da.published_day(F.col("o_orderdate")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


METRES = "sqrt(pow((b.lat - a.lat) * 111000.0, 2) + pow((b.lon - a.lon) * 111000.0 * cos(radians(a.lat)), 2))"
NEAR = f"near AS (SELECT a.feature_id, b.cand_id, a.altitude_m AS fa, b.altitude_m AS ca, {METRES} AS m FROM feat a JOIN cand b ON abs(a.lat - b.lat) < 0.0014 AND abs(a.lon - b.lon) < 0.0029 WHERE {METRES} <= 150)"


@query(f"{NEAR} -- main\nSELECT feature_id, cand_id, round(m, 4) AS metres FROM near")
def pairs_within(spark, d):
    p = pl.pairs_within(tb.features(spark, d), tb.candidates(spark, d), 150.0)
    return p.select("feature_id", F.col("r_cand_id").alias("cand_id"), F.round("metres", 4).alias("metres"))


@query(f"SELECT cand_id FROM cand b WHERE NOT EXISTS (SELECT 1 FROM feat a WHERE abs(a.lat - b.lat) < 0.0014 AND abs(a.lon - b.lon) < 0.0029 AND sqrt(pow((a.lat - b.lat) * 111000.0, 2) + pow((a.lon - b.lon) * 111000.0 * cos(radians(b.lat)), 2)) < 150)")
def radius_dedupe(spark, d):
    return pl.radius_dedupe(tb.candidates(spark, d), tb.features(spark, d)).select("cand_id")


@query(f"{NEAR} -- main\nSELECT feature_id, min(cand_id) AS cand_id, round(min(m), 4) AS metres FROM near WHERE abs(fa - ca) <= 120 GROUP BY 1 HAVING count(*) = 1")
def match_by_position(spark, d):
    m = pl.match_by_position(tb.features(spark, d), tb.candidates(spark, d))
    return m.select("feature_id", "cand_id", F.round("metres", 4).alias("metres"))


@query(f"{NEAR} -- main\nSELECT feature_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY m, cand_id) AS rn FROM near) WHERE rn = 1 AND abs(fa - ca) <= 2000")
def nearest_within(spark, d):
    return pl.nearest_within(tb.features(spark, d), tb.candidates(spark, d), altitude=2000).select("feature_id", "cand_id")


RING = [(6.603, 45.75), (6.640, 45.76), (6.648, 45.95), (6.620, 45.88), (6.605, 46.01)]
CROSS = " + ".join(
    f"CAST((({y1} > lat) <> ({y2} > lat)) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} AS INT)" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1], strict=True)
)


@query(f"SELECT feature_id FROM feat WHERE ({CROSS}) % 2 = 1".replace("45.", "45.").replace("6.6", "6.6"))
def point_in_polygon(spark, d):
    return pl.point_in_polygon(tb.features(spark, d), RING).select("feature_id")


# A country for each nation: a box in a grid of five columns, with a dent that goes to no one and a vertex on each side.
COUNTRY = """box AS (SELECT n_nationkey AS ring_id, 45.7195 + (n_nationkey // 5) * 0.067 AS y, 6.5995 + (n_nationkey % 5) * 0.01 AS x FROM nation),
held AS (SELECT p.feature_id, b.ring_id FROM feat p JOIN box b ON p.lat > b.y AND p.lat < b.y + 0.067 AND p.lon > b.x AND p.lon < b.x + 0.01 WHERE NOT (p.lat > b.y + 0.02 AND p.lat < b.y + 0.04 AND p.lon > b.x + 0.004))"""


@query(f"{COUNTRY} -- main\nSELECT feature_id, ring_id FROM held WHERE feature_id % 9 <> 0 UNION ALL SELECT feature_id, feature_id % 25 FROM feat WHERE feature_id % 18 = 0")
def rings_of_points(spark, d):
    y, x = "45.7195D + (n_nationkey div 5) * 0.067D", "6.5995D + (n_nationkey % 5) * 0.01D"
    corners = [(0, 0), (0, 0.003), (0, 0.01), (0.02, 0.01), (0.02, 0.004), (0.04, 0.004), (0.04, 0.01), (0.067, 0.01), (0.067, 0), (0.03, 0)]
    ring = F.array(*(F.struct((F.expr(y) + a).alias("lat"), (F.expr(x) + b).alias("lon")) for a, b in corners))
    rings = tb.base(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ring_id"), ring.alias("ring"))
    told = tb.features(spark, d).filter("feature_id % 9 = 0").select("feature_id", F.when(F.col("feature_id") % 2 == 0, F.col("feature_id") % 25).alias("ring_id"))
    return pl.rings_of_points(tb.features(spark, d), rings, "feature_id", told)


@query("SELECT kind, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, round(sqrt(pow((max(lat) - min(lat)) * 111.0, 2) + pow((max(lon) - min(lon)) * 111.0 * 0.7, 2)), 6) AS span_km FROM feat GROUP BY 1")
def line_extent(spark, d):
    e = pl.line_extent(tb.features(spark, d), ["kind"])
    return e.withColumn("span_km", F.round("span_km", 6))


@query("SELECT feature_id, round(radians(lon) * 6378137.0, 3) AS x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0, 3) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM feat")
def mercator(spark, d):
    m = tb.features(spark, d).withColumn("m", ge.to_mercator(F.col("lat"), F.col("lon"))).withColumn("g", ge.from_mercator(F.col("m.x"), F.col("m.y")))
    return m.select("feature_id", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"), F.round("g.lat", 6).alias("lat"), F.round("g.lon", 6).alias("lon"))


@query("SELECT cand_id FROM cand WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.cand_id % 3 = 0 AND lower(b.name) = lower(cand.name))")
def known_name_dedupe(spark, d):
    c = tb.candidates(spark, d)
    return pl.known_name_dedupe(c, c.filter("cand_id % 3 = 0").withColumn("name", F.upper("name"))).select("cand_id")


@query(f"SELECT a.feature_id, count(*) AS ways FROM (SELECT feature_id, {EXACT.format('name')} AS k FROM feat) a JOIN (SELECT p_partkey, {EXACT.format('p_name')} AS k FROM part) b USING (k) GROUP BY 1")
def match_machines(spark, d):
    ways = tb.base(spark, d, "part").selectExpr("p_partkey AS way_id", "concat(p_name, ' ', p_partkey) AS name")
    return pl.match_machines(tb.features(spark, d), ways).select("feature_id", F.col("n_ways").alias("ways"))


@query("""r AS (SELECT feature_id, CASE WHEN feature_id % 7 = 0 THEN -1 WHEN feature_id % 2 = 0 THEN feature_id END AS pin FROM feat) -- main
SELECT feature_id, CASE WHEN pin IS NOT NULL THEN (SELECT cand_id FROM cand WHERE cand_id = pin) ELSE (SELECT min(cand_id) FROM cand WHERE lower(name) = 'customer#' || lpad(CAST(feature_id AS VARCHAR), 9, '0') OR lower(name) = (SELECT lower(c2.name) FROM cand c2 WHERE c2.cand_id = r.feature_id)) END AS cand_id FROM r""")
def pinned_or_named(spark, d):
    c = tb.candidates(spark, d)
    f = tb.features(spark, d).join(c.select(F.col("cand_id").alias("feature_id"), F.col("name").alias("form")), "feature_id", "left")
    pin = F.when(F.col("feature_id") % 7 == 0, F.lit(-1).cast("long")).when(F.col("feature_id") % 2 == 0, F.col("feature_id"))
    f = f.select("feature_id", pin.alias("pinned_id"), F.array(F.lit("nowhere"), F.coalesce("form", F.lit("none"))).alias("forms"))
    return pl.pinned_or_named(f, c)


@query("""steps AS (SELECT o_orderkey AS r, CAST(o_custkey AS VARCHAR) AS t FROM orders UNION ALL SELECT o_orderkey, CAST(o_custkey + 1 AS VARCHAR) FROM orders) -- main
SELECT r AS route_id, count(*) AS points FROM steps JOIN cand ON CAST(cand_id AS VARCHAR) = t WHERE cand_id % 10 <> 0 GROUP BY 1 HAVING count(*) = 2""")
def waypoint_line(spark, d):
    routes = tb.base(spark, d, "orders").select(F.col("o_orderkey").alias("route_id"), F.array(F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1).cast("string")).alias("waypoints"))
    places = tb.candidates(spark, d).filter("cand_id % 10 <> 0").withColumn("token", F.col("cand_id").cast("string"))
    return pl.waypoint_line(routes, places).select("route_id", F.size("line").cast("long").alias("points"))


@query(f"""geo AS (SELECT *, CASE cand_id % 3 WHEN 0 THEN 'hut' ELSE 'shop' END AS kind FROM cand),
known AS (SELECT * FROM feat) -- main
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT (({CROSS}) % 2 = 1) THEN 'outside' WHEN kind <> 'hut' THEN 'kind'
 WHEN EXISTS (SELECT 1 FROM known a WHERE abs(a.lat - b.lat) < 0.0014 AND abs(a.lon - b.lon) < 0.0029 AND sqrt(pow((a.lat - b.lat) * 111000.0, 2) + pow((a.lon - b.lon) * 111000.0 * cos(radians(b.lat)), 2)) < 150) THEN 'too near' ELSE 'new' END AS reason FROM geo b) GROUP BY 1""")
def new_features_from_candidates(spark, d):
    c = tb.candidates(spark, d).withColumn("kind", F.when(F.col("cand_id") % 3 == 0, "hut").otherwise("shop"))
    told = pl.new_features_from_candidates(c, tb.features(spark, d), RING, ["hut"])
    return told.groupBy(F.coalesce("reason", F.lit("new")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


ALIAS = "'Refuge du ' || {name} || ' ' || CAST(CASE WHEN {id} % 2 = 0 THEN {id} ELSE {id} % 40 END AS VARCHAR)"
INDEX = f"""forms AS (SELECT feature_id, name AS form, 0 AS place FROM feat WHERE active UNION ALL SELECT feature_id, {ALIAS.format(name="name", id="feature_id")}, 1 FROM feat WHERE active),
keyed AS (SELECT feature_id, form, place, 'exact' AS tier, {EXACT.format('form')} AS key FROM forms UNION ALL SELECT feature_id, form, place, 'tight', {strip(EXACT.format('form'), BUILDING)} FROM forms UNION ALL SELECT feature_id, form, place, 'loose', {strip(EXACT.format('form'), LOOSE)} FROM forms),
idx AS (SELECT tier, key, feature_id, arg_min(form, place) AS form FROM keyed WHERE key <> '' GROUP BY 1, 2, 3)"""


def alias(name: str, key: str):
    return F.concat(F.lit("Refuge du "), F.col(name), F.lit(" "), F.expr(f"CAST(CASE WHEN {key} % 2 = 0 THEN {key} ELSE {key} % 40 END AS STRING)"))


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence in SQL, for an a of up to 62 characters: a bit for each of its places."""
    places = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = c THEN 1::BIGINT << i ELSE 0 END))::BIGINT"
    full = f"((1::BIGINT << length({a})) - 1)"
    left = f"list_reduce(list_transform(string_split({b}, ''), lambda c: {places}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count({left}) END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})) END)"


def stretch(a: str, b: str) -> str:
    """The best ratio of a to a stretch of the longer b."""
    window = f"substr({b}, greatest(k, 0) + 1, least(k + length({a}), length({b})) - greatest(k, 0))"
    each = f"list_transform([{window}], lambda w: 200.0::DOUBLE * {lcs(a, 'w')} / (length({a}) + length(w)))[1]"
    return f"list_max(list_transform(range(1 - length({a}), length({b})), lambda k: {each}))"


def similar(a: str, b: str, floor: int = 60) -> str:
    """The weighted ratio of two keys in SQL where it is `floor` or more, else something below; keys whose words repeat, or
    that are over 62 characters long, are not in the given tables."""
    wa, wb = (f"list_sort(list_distinct(string_split({x}, ' ')))" for x in (a, b))
    pair = f"""{{'s': CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END, 'l': CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END,
  'x': array_to_string({wa}, ' '), 'y': array_to_string({wb}, ' '), 'both': array_to_string(list_sort(list_intersect({wa}, {wb})), ' '),
  'own': array_to_string(list_filter({wa}, lambda w: NOT list_contains({wb}, w)), ' '), 'other': array_to_string(list_filter({wb}, lambda w: NOT list_contains({wa}, w)), ' ')}}"""
    gap = "(CASE WHEN p.both = '' THEN 0 ELSE 1 END)"
    total = f"(2 * (length(p.both) + {gap}) + length(p.own) + length(p.other))"
    parts = ", ".join(f"CASE WHEN p.both = '' THEN 0 ELSE 100 - 100.0::DOUBLE * (1 + length(p.{x})) / (2 * length(p.both) + 1 + length(p.{x})) END" for x in ("own", "other"))
    sets = f"(CASE WHEN p.both <> '' AND (p.own = '' OR p.other = '') THEN 100 ELSE greatest(100 - 100.0::DOUBLE * (length(p.own) + length(p.other) - 2 * {lcs('p.own', 'p.other')}) / {total}, {parts}) END)"
    scale = "(CASE WHEN length(p.l) <= 8 * length(p.s) THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END)"
    known = "len(list_filter(string_split(p.s, ''), lambda c: contains(p.l, c)))"
    xs, ys = ("(CASE WHEN length(p.x) <= length(p.y) THEN p.%s ELSE p.%s END)" % tuple(z) for z in ("xy", "yx"))
    wide = f"""CASE WHEN p.both <> '' AND length(p.s) <= 10 THEN greatest({ratio('p.s', 'p.l')}, CASE WHEN contains(p.l, p.s) THEN 100 * {scale} ELSE 95 * {scale} END)
 WHEN p.both = '' AND {scale} * 200 * {known} / (length(p.s) + {known}) < {floor} THEN {ratio('p.s', 'p.l')}
 ELSE greatest({ratio('p.s', 'p.l')}, {scale} * {stretch('p.s', 'p.l')}, CASE WHEN p.both <> '' THEN 95 * {scale} ELSE 0.95::DOUBLE * {scale} * {stretch(xs, ys)} END) END"""
    near = f"greatest({ratio('p.s', 'p.l')}, 0.95::DOUBLE * {ratio('p.x', 'p.y')}, 0.95::DOUBLE * {sets})"
    edits = " AND ".join(f"{w} * (1 - levenshtein({x}, {y})::DOUBLE / (length({x}) + length({y}))) < {floor}" for w, x, y in ((100, "p.s", "p.l"), (95, "p.x", "p.y")))  # never below the ratio
    return f"(list_transform([{pair}], lambda p: CASE WHEN p.s = p.l THEN 100.0::DOUBLE WHEN p.both = '' AND length(p.l) < 1.5 * length(p.s) AND {edits} THEN 0 WHEN length(p.l) < 1.5 * length(p.s) THEN {near} ELSE {wide} END)[1])"


def index_of(spark, d):
    f = tb.features(spark, d).filter("active").withColumn("aliases", F.array(alias("name", "feature_id")))
    return rs.alias_index(rs.surface_forms(f, aliases="aliases"))


@query(f"{INDEX} -- main\nSELECT tier, key, feature_id, form FROM idx")
def alias_index(spark, d):
    return index_of(spark, d)


@query("SELECT count(*) AS n, count(DISTINCT feature_id) AS features FROM (SELECT feature_id FROM feat UNION ALL SELECT feature_id FROM feat)")
def surface_forms(spark, d):
    f = tb.features(spark, d).withColumn("aliases", F.array("kind"))
    return rs.surface_forms(f, aliases="aliases").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("feature_id").alias("features"))


@query(f"{INDEX} -- main\nSELECT tier, key, count(*) AS owners, min(feature_id) AS first_owner FROM idx GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_keys(spark, d):
    return rs.ambiguous_keys(index_of(spark, d))


@query(f"""{INDEX}, sole AS (SELECT tier, key, min(feature_id) AS owner FROM idx GROUP BY 1, 2 HAVING count(*) = 1),
asked AS (SELECT p_partkey, upper({ALIAS.format(name="p_name", id="p_partkey")}) AS mention FROM part) -- main
SELECT p_partkey, coalesce(e.owner, t.owner, l.owner) AS feature_id, CASE WHEN e.owner IS NOT NULL THEN 'exact' WHEN t.owner IS NOT NULL THEN 'tight' WHEN l.owner IS NOT NULL THEN 'loose' END AS tier FROM asked
LEFT JOIN sole e ON e.tier = 'exact' AND e.key = {EXACT.format('mention')} LEFT JOIN sole t ON t.tier = 'tight' AND t.key = {strip(EXACT.format('mention'), BUILDING)} LEFT JOIN sole l ON l.tier = 'loose' AND l.key = {strip(EXACT.format('mention'), LOOSE)}""")
def resolve_exact_tiers(spark, d):
    asked = tb.base(spark, d, "part").select("p_partkey", F.upper(alias("p_name", "p_partkey")).alias("mention"))
    return rs.resolve_exact_tiers(asked, index_of(spark, d)).select("p_partkey", "feature_id", "tier")


SCORED = f"""asked AS (SELECT DISTINCT p_name || ' ' || CAST(p_partkey % 4 AS VARCHAR) || '$end' AS mention FROM part),
keyed_m AS (SELECT mention, {strip(EXACT.format('mention'), LOOSE)} AS m_key FROM asked), keys AS (SELECT DISTINCT key FROM idx WHERE tier = 'loose'),
scored AS (SELECT mention, key, {similar('m_key', 'key')} AS score FROM keyed_m, keys),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, key) AS place FROM scored WHERE score >= 60) WHERE place <= 5)"""


def misspelt(spark, d, end: str):
    return tb.base(spark, d, "part").select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 4).cast("string"), F.lit(end)).alias("mention")).distinct()


@query(f"""{INDEX}, {SCORED.replace("$end", "a")}, owned AS (SELECT mention, score, feature_id, max(score) OVER (PARTITION BY mention) AS best FROM top JOIN idx USING (key) WHERE tier = 'loose'),
told AS (SELECT mention, max(score) AS score, min(feature_id) FILTER (score = best) AS low, max(feature_id) FILTER (score = best) AS high, count(DISTINCT feature_id) AS n_candidates FROM owned GROUP BY 1) -- main
SELECT mention, round(score, 6) AS score, n_candidates, CASE WHEN score >= 88 AND low = high THEN low END AS feature_id FROM asked LEFT JOIN told USING (mention)""")
def resolve_fuzzy(spark, d):
    return rs.resolve_fuzzy(misspelt(spark, d, "a"), index_of(spark, d)).select("mention", F.round("score", 6).alias("score"), "n_candidates", "feature_id")


@query(f"{INDEX}, {SCORED.replace('$end', 'b')} -- main\nSELECT mention, key, round(score, 6) AS score, place FROM top")
def top_candidates(spark, d):
    return rs.best_keys(misspelt(spark, d, "b"), index_of(spark, d)).withColumn("score", F.round("score", 6))


@query("SELECT source_id, lower(mention) AS mention, count(*) AS seen_count, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM ment GROUP BY 1, 2")
def mention_counter(spark, d):
    return rs.count_mentions(tb.mentions(spark, d))


@query("SELECT source_id, lower(mention) AS mention, count(*) AS seen_count FROM ment WHERE source_id <> 2 GROUP BY 1, 2 ORDER BY seen_count DESC, source_id, mention LIMIT 50")
def mention_queue(spark, d):
    m = rs.count_mentions(tb.mentions(spark, d)).withColumns({"resolved_to": F.lit(None).cast("long"), "dismissed": F.col("source_id") == 2})
    return rs.mention_queue(m).select("source_id", "mention", "seen_count")


@query("SELECT o_orderkey, f.feature_id FROM orders LEFT JOIN (SELECT c_custkey AS ref, c_nationkey % 8 AS source_id, c_custkey * 10 AS feature_id FROM customer WHERE c_custkey % 2 = 0) f ON f.ref = o_custkey AND f.source_id = o_orderkey % 8")
def join_by_external_id(spark, d):
    x = tb.base(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 8 AS source_id", "o_custkey AS external_ref")
    f = tb.base(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("CAST(c_nationkey % 8 AS LONG) AS source_id", "c_custkey AS external_ref", "c_custkey * 10 AS feature_id")
    return rs.join_by_external_id(x, f).select("o_orderkey", "feature_id")


@query("SELECT feature_id, coalesce(CASE WHEN feature_id % 3 = 0 THEN feature_id END, parent_id) AS owner, CASE WHEN feature_id % 3 <> 0 THEN 'site' END AS attributed_by FROM feat")
def attribute_to_site(spark, d):
    m = tb.features(spark, d).select(F.col("feature_id").alias("row"), F.when(F.col("feature_id") % 3 == 0, F.col("feature_id")).alias("feature_id"), F.col("parent_id").alias("site_of"))
    return rs.attribute_to_site(m).select(F.col("row").alias("feature_id"), F.col("feature_id").alias("owner"), "attributed_by")


@query(f"SELECT count(*) AS mentions, count(c.fid) AS resolved FROM (SELECT p_partkey, p_partkey - p_partkey % 10 AS pid, lower(p_name) AS k FROM part) m LEFT JOIN (SELECT parent_id, lower(name) AS k, min(feature_id) AS fid FROM feat WHERE parent_id IS NOT NULL GROUP BY 1, 2) c ON c.parent_id = m.pid AND c.k = m.k")
def resolve_child(spark, d):
    m = tb.base(spark, d, "part").selectExpr("p_partkey - p_partkey % 10 AS parent_id", "upper(p_name) AS mention")
    found, _ = rs.resolve_child(m, tb.features(spark, d))
    return found.agg(F.count(F.lit(1)).alias("mentions"), F.count("feature_id").alias("resolved"))


@query("""t AS (SELECT 'economy' AS title, '' AS pre, 1 AS f UNION ALL SELECT 'economy', 'red', 2 UNION ALL SELECT 'economy', 'red w', 3 UNION ALL SELECT 'small', '', 4 UNION ALL SELECT 'small', '', 5),
j AS (SELECT feature_id AS row_id, f, length(pre) AS n, max(length(pre)) OVER (PARTITION BY feature_id) AS m FROM feat JOIN t ON t.title = kind AND starts_with(name, pre)) -- main
SELECT row_id, f AS feature_id FROM j WHERE n = m""")
def fan_out_targets(spark, d):
    targets = spark.createDataFrame([("economy", "", 1), ("economy", "red", 2), ("economy", "red w", 3), ("small", "", 4), ("small", "", 5)], "title string, subtitle_prefix string, feature_id int")
    rows = tb.features(spark, d).selectExpr("feature_id AS row_id", "kind AS title", "name AS subtitle")
    return rs.fan_out_targets(rows, F.broadcast(targets)).select("row_id", "feature_id")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g')))")
def passages_in_documents(spark, d):
    return do.passages_in_documents(tb.base(spark, d, "benchmark"), tb.base(spark, d, "documents"))


@query("""c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_replace(substr(text, 5, 40), '\\s+', '   ', 'g') WHEN 1 THEN '' ELSE 'zz' || substr(text, 1, 20) END AS evidence, text FROM documents) -- main
SELECT doc_id AS document_id, trim(regexp_replace(evidence, '\\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(evidence, '\\s+', ' ', 'g'))) AS verified FROM c""")
def verify_evidence(spark, d):
    docs = tb.base(spark, d, "documents").withColumnRenamed("doc_id", "document_id")
    quote = F.expr(r"CASE document_id % 3 WHEN 0 THEN regexp_replace(substr(text, 5, 40), '\\s+', '   ') WHEN 1 THEN '' ELSE concat('zz', substr(text, 1, 20)) END")
    return do.verify_evidence(docs.select("document_id", quote.alias("evidence")), docs).select("document_id", "verified")


@query("SELECT doc_id FROM documents WHERE sha256(sha256(text) || '|v2|m') NOT IN (SELECT sha256(sha256(text) || '|v2|m') FROM documents WHERE doc_id % 2 = 0)")
def memo_antijoin(spark, d):
    docs = tb.base(spark, d, "documents").select("doc_id", "text")
    memo = docs.filter("doc_id % 2 = 0").select(F.sha2(F.concat_ws("|", F.sha2("text", 256), F.lit("v2"), F.lit("m")), 256).alias("memo_key")).distinct()
    return do.memo_antijoin(docs, memo, "v2", "m")[0].select("doc_id")


DICT = [(1, "idiot"), (2, r"\bqueau"), (3, "keit"), (1, "moron"), (4, "cion")]


@query(f"""hits AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN regexp_matches({FOLD.format('text')}, '{p}') THEN {f} END" for f, p in DICT)}], lambda x: x IS NOT NULL) AS h FROM documents) -- main
SELECT doc_id, feature_id, count(*) OVER () * 0 + 1 AS found FROM (SELECT DISTINCT doc_id, unnest(h) AS feature_id FROM hits)""")
def dictionary_mentions(spark, d):
    return do.dictionary_mentions(tb.base(spark, d, "documents"), DICT).select("doc_id", "feature_id", F.lit(1).cast("long").alias("found"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def unknown_values(spark, d):
    return do.unknown_values(tb.base(spark, d, "events"), "event_type", ["view", "click"])


@query("SELECT doc_id, sentence FROM (SELECT doc_id, trim(s) AS sentence, row_number() OVER (PARTITION BY doc_id, length(trim(s)) % 2 ORDER BY p) AS rn FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n•;]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?\n•;]+'), 1) AS p FROM documents) WHERE length(trim(s)) >= 12) WHERE rn = 1")
def first_claim_wins(spark, d):
    s = tb.base(spark, d, "documents").select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("place", "sentence")).withColumn("kind", F.length("sentence") % 2)
    return do.first_claim_wins(s, ["kind"]).select("doc_id", "sentence")


@query("SELECT user_id, event_type, event_id, reports FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, event_type) AS reports FROM events) WHERE rn = 1")
def newest_report(spark, d):
    e = tb.base(spark, d, "events").withColumn("reports", F.count(F.lit(1)).over(Window.partitionBy("user_id", "event_type")))
    return li.first_by(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "reports")
