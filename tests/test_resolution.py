"""The chain from a mention to a feature, on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waymark.operators import resolve as rs

FEATURES = [(1, "Refuge de Saleinaz", 2691, True), (2, "Cabane d'Orny", 2826, True), (3, "Refuge du Plan de l'Aiguille", 2207, True), (4, "Grands Mulets", 3051, True), (5, "Refuge Vallot Ancien", 4362, False), (6, "Petits Mulets", 3000, True), (7, "Refuge du Goûter", 3835, True), (8, "Gare du Gouter", 3800, True)]


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame([(*x, None) for x in FEATURES], "feature_id long, name string, altitude_m int, active boolean, parent_id long")


@pytest.fixture(scope="module")
def index(features):
    return rs.alias_index(rs.surface_forms(features.filter("active")))


CLAIMS = [
    # source, mention, site_of, altitude -> feature, resolved by, reason, attributed by
    (5, "voie de la Saleinaz", 1, None, None, "site", "names an approach", None),
    (5, "accès à la Cabane d'Orny", 1, None, None, "site", "names an approach", None),
    (5, "Refuge de Salenaz", 2, None, 1, "site", None, None),
    (5, "la cabane", 2, None, 2, "site", None, "site"),
    (5, "le refuge", None, None, None, "site", "no match", None),
    (9, "Refuge de Salenaz", None, None, 1, "general", None, None),
    (9, "voie de la Saleinaz", None, None, 1, "general", None, None),
    (9, "Goûter", None, None, 7, "general", None, None),
    (9, "Refuge du Goûter", None, None, 7, "general", None, None),
    (9, "Vallot Ancien", None, None, None, "general", "no match", None),
    (9, None, None, None, None, "general", "no match", None),
    (4, "Refuge Saleinaz", None, 2600, 1, "scoped", None, None),
    (4, "Salenaz", None, 2691, 1, "scoped", None, None),
    (4, "Salenaz", None, 2200, None, "scoped", "altitude differs", None),
    (4, "Salenaz", None, None, None, "scoped", "altitude unknown", None),
]


def test_approaches_come_first_and_similar_names_last(spark, features, index):
    rows = [(k, *x[:4], None, None) for k, x in enumerate(CLAIMS)]
    claims = spark.createDataFrame(rows, "id int, source_id long, mention string, site_of long, altitude_m int, slug string, external_ref string").withColumn("parent_id", F.lit(None).cast("long"))
    policy = spark.createDataFrame([(4, "scoped"), (5, "site")], "source_id long, resolution string")
    facts = spark.createDataFrame([], "source_id long, external_ref string, feature_id long")
    found, queue = rs.resolution_hooks(claims, policy, features, facts, index)
    got = {r["id"]: (r["feature_id"], r["resolved_by"], None, r["attributed_by"]) for r in found.collect()}
    got |= {r["id"]: (None, r["resolved_by"], r["reason"], r["attributed_by"]) for r in queue.collect()}
    assert got == {k: x[4:] for k, x in enumerate(CLAIMS)}


def test_a_tie_between_features_resolves_to_none_and_keeps_its_candidates(spark, features, index):
    asked = spark.createDataFrame([("Mulets",), ("Grand Mulets",)], "mention string")
    told = {r["mention"]: r for r in rs.resolve_chain(asked, index).collect()}
    assert told["Mulets"]["feature_id"] is None and [c["key"] for c in told["Mulets"]["candidates"]][:2] == ["grands mulets", "petits mulets"]
    assert told["Mulets"]["candidates"][0]["score"] == told["Mulets"]["candidates"][1]["score"] == 90.0
    assert told["Grand Mulets"]["feature_id"] == 4 and told["Grand Mulets"]["tier"] == "similar"


def test_rings_with_many_edges_and_exceptions(spark):
    import math

    from waymark.operators import places

    circle = [{"lat": 46 + 0.2 * math.sin(k / 50 * math.pi), "lon": 7 + 0.3 * math.cos(k / 50 * math.pi)} for k in range(100)]
    square = [{"lat": 45.9, "lon": 7.1}, {"lat": 46.1, "lon": 7.1}, {"lat": 46.1, "lon": 8.0}, {"lat": 45.9, "lon": 8.0}]
    rings = spark.createDataFrame([("circle", circle), ("square", square)], "ring_id string, ring array<struct<lat:double,lon:double>>")
    points = [(1, 46.0, 7.0), (2, 46.01, 7.2), (3, 46.05, 7.9), (4, 47.0, 7.0), (5, 46.0, 6.9), (6, 46.0, 7.05)]
    told = spark.createDataFrame([(5, None), (4, "square")], "id long, ring_id string")
    got = sorted(tuple(r) for r in places.rings_of_points(spark.createDataFrame(points, "id long, lat double, lon double"), rings, "id", told).collect())
    assert got == [(1, "circle"), (2, "circle"), (2, "square"), (3, "square"), (4, "square"), (6, "circle")]
    lines = spark.createDataFrame([(1, square[:3]), (2, [])], "id long, line array<struct<lat:double,lon:double>>")
    assert [(r["id"], r["lat"], r["lon"]) for r in places.line_midpoints(lines).collect()] == [(1, 46.1, 7.1)]
