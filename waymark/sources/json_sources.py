"""JSON envelopes to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written


def _yes_no(c: Column) -> Column:
    return F.when(c == "oui", True).when(c == "non", False)


GEOJSON = (
    "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:struct<id:long,nom:string,coord:struct<alt:int>,"
    "type:struct<valeur:string>,places:struct<valeur:int>,date:struct<derniere_modif:string>,info_comp:struct<eau:struct<valeur:string>,latrines:struct<valeur:string>>>>>>"
)


def flatten_geojson(raw: DataFrame, column: str = "json") -> DataFrame:
    """One candidate for each GeoJSON feature with an id and a name; a capacity of 0 is unknown."""
    f = raw.select(F.explode(F.from_json(column, GEOJSON)["features"]).alias("f"))
    p = "f.properties."
    out = f.select(
        F.col(p + "id").alias("cand_id"),
        F.trim(p + "nom").alias("name"),
        F.col(p + "coord.alt").alias("altitude_m"),
        F.get("f.geometry.coordinates", F.lit(1)).alias("lat"),
        F.get("f.geometry.coordinates", F.lit(0)).alias("lon"),
        F.col(p + "type.valeur").alias("kind"),
        F.nullif(p + "places.valeur", F.lit(0)).alias("capacity"),
        _yes_no(F.col(p + "info_comp.eau.valeur")).alias("water"),
        _yes_no(F.col(p + "info_comp.latrines.valeur")).alias("latrines"),
        F.try_to_date(p + "date.derniere_modif").alias("modified"),
    )
    return out.filter("cand_id is not null and name <> ''")


AVAILABILITY = "struct<feature_slug:string,hut_id:long,availability:array<struct<date:string,hutStatus:string,freeBeds:int>>>"


def flatten_availability(envelopes: DataFrame, column: str = "json") -> DataFrame:
    """(entity, day, state): days with a date and a state; unless closed, the number of free beds must be known."""
    d = envelopes.select(F.from_json(column, AVAILABILITY).alias("e")).select(F.col("e.feature_slug").alias("entity"), F.explode("e.availability").alias("a"))
    rows = d.select("entity", F.try_to_date(F.substring("a.date", 1, 10)).alias("day"), F.col("a.hutStatus").alias("state"), F.col("a.freeBeds").alias("free_beds"))
    return rows.filter("day is not null and state is not null and (state = 'CLOSED' or free_beds is not null)")


OUTINGS = "struct<feature_slug:string,route_id:long,outings:array<struct<document_id:long,condition_rating:string,date_end:string,locales:array<struct<lang:string,title:string>>>>>"
RATINGS = {"excellent": 0, "good": 0, "average": 1, "poor": 2, "awful": 3}


def flatten_outings(envelopes: DataFrame, as_of, column: str = "json", days: int = 30) -> DataFrame:
    """Reports with a known rating and a date within the last `days` days."""
    o = envelopes.select(F.from_json(column, OUTINGS).alias("e")).select(F.col("e.feature_slug").alias("route"), F.explode("e.outings").alias("o"))
    rows = o.select("route", F.col("o.document_id").alias("report_id"), F.col("o.condition_rating").alias("rating"), F.try_to_date("o.date_end").alias("day"), F.get("o.locales", F.lit(0))["title"].alias("title"))
    known = F.create_map(*(F.lit(x) for pair in RATINGS.items() for x in pair))
    at = F.lit(as_of).cast("date")
    return rows.withColumn("severity", known[F.col("rating")]).filter(F.col("severity").isNotNull() & F.col("day").between(F.date_sub(at, days), at))


def explode_nested_rows(blocks: DataFrame, column: str = "json", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (season, title, subtitle, start, end) at any depth of JSON blocks, each season, title and subtitle once
    regardless of case; `carry` names columns of blocks that keep rows apart and stay.

    A row is an object with a title and a start day. What stands inside a hidden object is hidden, and a season holds for
    all inside it, up to the next one. Each step takes the parts of all objects and arrays of one depth, until none is left;
    what can't be parsed gives nothing.
    """
    level, rows = blocks.select(*carry, F.try_parse_json(column).alias("v"), F.lit(None).cast("string").alias("season")), None

    def told(name: str, kind: str = "string"):
        return F.try_variant_get("v", f"$.{name}", kind)

    def parts(v):
        return F.coalesce(v.try_cast("array<variant>"), F.map_values(v.try_cast("map<string,variant>")))

    while True:
        shown = level.filter(F.col("v").isNotNull() & ~F.coalesce(told("hidden", "boolean"), F.lit(False))).withColumn("season", F.coalesce(told("season"), "season"))
        shown = written(shown, "level")
        own = shown.select(*carry, "season", told("title").alias("title"), told("subtitle").alias("subtitle"), F.try_to_date(told("start")).alias("start"), F.try_to_date(told("end")).alias("end"))
        own = own.filter("title is not null and start is not null")
        rows = own if rows is None else rows.unionByName(own)
        level = shown.select(*carry, "season", F.explode(parts(F.col("v"))).alias("v")).filter(parts(F.col("v")).isNotNull())
        if level.isEmpty():
            break
    keys = [*carry, "season", F.lower("title").alias("title"), F.lower(F.coalesce("subtitle", F.lit(""))).alias("subtitle")]
    return rows.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def classify_osm_tags(elements: DataFrame) -> DataFrame:
    """Elements (id, tags map, lat, lon) with a feature kind by ordered rules; unnamed, unplaced and other ones left out."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    height = F.regexp_extract(F.coalesce(tag("ele"), F.lit("")), r"^(\d+)", 1).try_cast("int")
    kind = (
        F.when(tag("tourism").isin("alpine_hut", "wilderness_hut"), "hut")
        .when(tag("aerialway").isNotNull() & ~tag("aerialway").isin("pylon", "station", "goods"), "lift")
        .when(tag("aerialway") == "station", "station")
        .when((tag("natural") == "peak") & (height >= 3000), "peak")
        .when(tag("natural") == "glacier", "glacier")
    )
    names = F.map_filter("tags", lambda k, v: F.startswith(k, F.lit("name:")))
    out = elements.select("id", tag("name").alias("name"), kind.alias("kind"), "lat", "lon", height.alias("altitude_m"), names.alias("names"), F.split(F.coalesce(tag("alt_name"), F.lit("")), r"\s*;\s*").alias("aliases"))
    return out.filter("name is not null and kind is not null and lat is not null and lon is not null")


def calendar_cells(cells: DataFrame) -> DataFrame:
    """(entity, day) of bookable cells (month_title such as `Juin 2026`, day text, classes array)."""
    from ..functions.dates import _month
    from ..functions.text import fold

    flat = fold(F.col("month_title"))
    month, year = F.regexp_extract(flat, r"(\p{L}+)\s+(\d{4})", 1), F.regexp_extract(flat, r"(\p{L}+)\s+(\d{4})", 2)
    day = F.try_to_date(F.concat_ws("-", year, F.lpad(_month(month), 2, "0"), F.lpad("day", 2, "0")))
    return cells.filter(F.array_contains("classes", "available") | F.array_contains("classes", "few")).select("entity", day.alias("day")).filter("day is not null")
