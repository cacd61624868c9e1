"""Literal rows for what the given tables don't reach."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waymark.functions import dates, geo, text
from waymark.operators import lifecycle, review, season
from waymark.operators import status as st
from waymark.plans import jobs
from waymark.sources import json_sources as js
from waymark.sources import tables as tb
from waymark.streaming import incremental as inc

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("phrase", "start", "end", "rule"),
    [
        ("du 28 décembre 2026 au 3 janvier 2027", D(2026, 12, 28), D(2027, 1, 3), "full_range"),
        ("du 26 mai au 2 juin 2026", D(2026, 5, 26), D(2026, 6, 2), "split_month"),
        ("du 26–29 mai", None, None, None),
        ("du 26 au 29 mai 2026", D(2026, 5, 26), D(2026, 5, 29), "same_month"),
        ("du 1/6/26 au 30/9/2026", D(2026, 6, 1), D(2026, 9, 30), "numeric_range"),
        ("du 26 mai 2026 et jusqu’au 29 mai 2026", D(2026, 5, 26), D(2026, 5, 29), "from_until"),
        ("Gardé du Lundi 7 Juillet au matin, jusqu'au Jeudi 3 Septembre 2026", D(2026, 7, 7), D(2026, 9, 3), "from_until_split"),
        ("du 10 décembre jusqu'au 8 avril 2026", D(2025, 12, 10), D(2026, 4, 8), "from_until_split"),
        ("jusqu'au 30 août 2026", None, D(2026, 8, 30), "until"),
        ("gardé jusqu'au 30/08/2026", None, D(2026, 8, 30), "until_numeric"),
        ("à partir du 1er juin 2026", D(2026, 6, 1), None, "from"),
        ("à partir du 01/06/2026", D(2026, 6, 1), None, "from_numeric"),
        ("le 5 mai 2026", D(2026, 5, 5), D(2026, 5, 5), "single_named"),
        ("le 31 février 2026", None, None, None),
        ("dal 20 giugno al 20 settembre 2026", D(2026, 6, 20), D(2026, 9, 20), "split_month:it"),
        ("CHIUSURA 13 SETTEMBRE 2026", D(2026, 9, 13), D(2026, 9, 13), "single_named:it"),
        ("rien du tout", None, None, None),
    ],
)
def test_date_windows(spark, phrase, start, end, rule):
    got = one(spark, dates.extract_date_window(F.lit(phrase)))
    assert (got and (got["start"], got["end"], got["rule"])) == (rule and (start, end, rule))


def test_coarse_and_assumed_years(spark):
    got = one(spark, dates.extract_coarse_window(F.lit("mi juin à fin septembre"), F.lit(2026)))
    assert (got["start"], got["end"]) == (D(2026, 6, 20), D(2026, 9, 21))
    assert one(spark, dates.extract_coarse_window(F.lit("puis les WE début septembre"), F.lit(2026))) is None
    crossed = one(spark, dates.extract_coarse_window(F.lit("début décembre à fin mars"), F.lit(2026), True))
    assert crossed["end"] == D(2027, 3, 21)
    assumed = one(spark, dates.assume_year(F.lit("du 10 au 20 mai"), F.lit(2026)))
    assert (assumed["start"], assumed["rule"]) == (D(2026, 5, 10), "same_month+assumed_year")


def test_keys_keep_what_differs(spark):
    name = F.lit("Refuge du Plan de l’Aiguille")
    assert one(spark, text.key_tight(name)) == "plan aiguille"
    assert one(spark, text.key_loose(name)) == "plan"
    assert one(spark, text.key_exact(F.lit("Goûter  Straße"))) == "gouter strasse"
    assert one(spark, text.key_translated(F.lit("Rifugio Torino"))) == "refuge torino"
    assert one(spark, text.is_decoy(F.lit("Ancien refuge du Goûter"))) and not one(spark, text.is_decoy(F.lit("Examen")))
    assert one(spark, text.slugify(F.lit(" L'Été à 3000 m! "))) == "l-ete-a-3000-m"


def test_titles_decide_by_the_earlier_word(spark):
    assert one(spark, text.classify_title(F.lit("Réouverture après la fermeture"))) == "opening"
    assert one(spark, text.classify_title(F.lit("Fermeture puis réouverture"))) == "closure"
    assert one(spark, text.classify_title(F.lit("Situation ubuesque"))) is None


def test_small_parsers(spark):
    assert one(spark, text.posted_date(F.lit("Travaux posté le 03/06/2026")))["day"] == D(2026, 6, 3)
    assert tuple(one(spark, text.header_numbers(F.lit("40 pers .. alt. 2602 m")))) == (40, 2602)
    assert tuple(one(spark, text.clean_title(F.lit("Refuge X (CAF)")))) == ("Refuge X", False)
    assert one(spark, text.clean_title(F.lit("Ligne *")))["caveat"]
    counts = one(spark, text.lift_counts(F.lit("Remontées ( 0 / 4 ) Pistes (2/9)")))
    assert tuple(counts["remontees"]) == (0, 4) and tuple(counts["pistes"]) == (2, 9)
    assert one(spark, text.phone_from_text(F.lit("tél. 04.50.12.34.56, merci"))) == "04 50 12 34 56"
    read = one(spark, text.parse_json_array(F.lit('hm [{"a": 1}, 3, "x"] ok'), "a int"))
    assert [i["a"] for i in read["items"]] == [1] and read["error"] is None
    assert tuple(one(spark, text.parse_json_array(F.lit("none"), "a int"))) == (None, "no array")
    assert tuple(one(spark, text.parse_json_array(F.lit("[1, {"), "a int")))[1] == "no array" and tuple(one(spark, text.parse_json_array(F.lit("[{]"), "a int")))[1] == "not JSON"
    assert one(spark, text.similarity(F.lit("plan aiguille"), F.lit("aiguille plan"))) == pytest.approx(95.0)
    assert one(spark, text.page_published_at(F.lit('<script type="application/ld+json">{"datePublished": "2026-07-01T10:00:00"}</script>'))) == dt.datetime(2026, 7, 1, 8)
    pages = '<script type="application/ld+json">{"datePublished": "soon"}</script> "datePublished": "2020-01-01" <script type=\'application/ld+json\'>{"@graph": [{"a": 1}, {"datePublished": "2026-01-01T10:00:00Z"}]}</script>'
    assert one(spark, text.page_published_at(F.lit(pages))) == dt.datetime(2026, 1, 1, 10)
    assert [one(spark, season.since_label(F.lit(m).cast("double"))) for m in (None, 1.0, 5.0, 90.0, 1500.0, 5000.0)] == ["never checked", "just now", "5 min ago", "2h ago", "yesterday", "3 days ago"]
    assert one(spark, text.website_from_tags(F.create_map(F.lit("website"), F.lit("no link"), F.lit("contact:website"), F.lit("https://a.example")))) == "https://a.example"
    assert one(spark, text.names_an_approach(F.lit("Sentier du lac"))) and one(spark, text.named_elsewhere(F.lit("en Vanoise"))) and not one(spark, text.names_an_approach(F.lit("Cabane")))
    assert one(spark, geo.wkt_line(F.expr("array(array(named_struct('lon', 1D, 'lat', 2D), named_struct('lon', 3D, 'lat', 4D)))"))) == "LINESTRING (1.0 2.0, 3.0 4.0)"
    assert len(one(spark, geo.longest_part(F.expr("array(array(1), array(1, 2, 3), array(4, 5, 6))")))) == 3


def test_summaries_and_vocabulary(spark):
    window = F.struct(F.lit(D(2026, 5, 1)).alias("start"), F.lit(D(2026, 5, 3)).alias("end"))
    assert one(spark, jobs.english_summary(F.lit("closure"), window, F.lit("Fermé, travaux et éboulement"))) == "Closed 1-3 May 2026 (rockfall, works)"
    assert one(spark, jobs.english_summary(F.lit("opening"), window, F.lit("travaux finis"))) == "Reopened 1-3 May 2026"
    known, unseen = jobs.status_vocabulary(spark.createDataFrame([("SERVICED",), ("ODD",), ("ODD",)], "word string"), "word", jobs.HUT_STATES)
    assert [(r["type"], r["severity"]) for r in known.collect()] == [("opening", 0)] and [tuple(r) for r in unseen.collect()] == [("ODD", 2)]


def test_tables_are_scanned_under_their_schemas(spark, tmp_path):
    for name, schema in tb.SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    claims(spark, [claim(1)]).write.mode("overwrite").parquet(f"{tmp_path}/claims")
    assert {k: v.count() for k, v in tb.scan_tables(spark, str(tmp_path)).items()} == {k: int(k == "claims") for k in tb.SCHEMAS}


def claims(spark, rows):
    names = [c.split(" ")[0] for c in tb.SCHEMAS["claims"].split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], tb.SCHEMAS["claims"])


def claim(i, **more):
    return {"id": str(i), "feature_id": 1, "source_id": 1, "document_id": 1, "seq": i, "type": "closure", "status": "closed", "severity": 2, "observed_at": D(2026, 5, 1)} | more


def test_null_windows_and_bounds(spark):
    at = "2026-05-10"
    df = claims(spark, [claim(1), claim(2, valid_from=D(2026, 5, 10)), claim(3, valid_to=D(2026, 5, 10)), claim(4, valid_to=D(2026, 5, 9)), claim(5, superseded_at=D(2026, 5, 2)), claim(6, needs_review=True)])
    assert {r["id"] for r in st.live_claims(df, at).collect()} == {"1", "2", "3", "6"}
    assert {r["id"] for r in st.eligible_claims(df, at).collect()} == {"1", "2", "3"}


def test_late_claims_retire_nothing_newer(spark):
    df = claims(spark, [claim(1, observed_at=D(2026, 5, 5)), claim(2, observed_at=D(2026, 5, 1)), claim(3, observed_at=D(2026, 5, 5))])
    assert {r["id"]: r["replaced_by_seq"] for r in lifecycle.supersede_replaced(df).collect()} == {"1": 3, "2": 3}


@pytest.mark.parametrize(("misses", "retired"), [(1, False), (2, True), (3, True)])
def test_retirement_needs_enough_successful_runs(spark, misses, retired):
    source = spark.createDataFrame([(1, "s", 0.5, 60, 2)], tb.SCHEMAS["sources"])
    ok = [(k, 1, D(2026, 5, 2) + dt.timedelta(days=k), True) for k in range(misses)] + [(90, 1, D(2026, 6, 1), False)]
    runs = spark.createDataFrame(ok, tb.SCHEMAS["runs"])
    df = claims(spark, [claim(1, last_seen_at=D(2026, 5, 1))])
    assert bool(lifecycle.retire_unmentioned(df, runs, source).count()) == retired


def test_only_approvals_are_inherited(spark):
    stored = claims(spark, [claim(1, evidence="e", reviewed_at=D(2026, 5, 2)), claim(2, evidence="r", superseded_at=D(2026, 5, 2), reviewed_at=D(2026, 5, 2)), claim(3, evidence=" ", reviewed_at=D(2026, 5, 2))])
    new = claims(spark, [claim(11, evidence="e", needs_review=True), claim(12, evidence="r", needs_review=True), claim(13, evidence=" ", needs_review=True), claim(14, evidence="e", status="restricted", needs_review=True)])
    got = {r["id"]: r["reviewed_at"] for r in lifecycle.inherit_review(new, stored).collect()}
    assert got == {"11": D(2026, 5, 2), "12": None, "13": None, "14": None}


def test_season_branches(spark):
    at = "2026-07-01"
    rows = [
        claim(1, feature_id=1),
        claim(2, feature_id=2, type="opening", status="unknown", schedule=True, valid_from=D(2026, 6, 1), valid_to=D(2026, 9, 1), last_seen_at=D(2026, 6, 2)),
        claim(3, feature_id=3, type="opening", status="unstaffed"),
        claim(4, feature_id=4, type="opening", status="unstaffed"),
        claim(5, feature_id=4, type="opening", status="open"),
        claim(6, feature_id=5, type="opening", status="unknown", schedule=True, valid_to=D(2026, 6, 1), last_seen_at=D(2026, 5, 2)),
        claim(7, feature_id=6, status="unknown"),
    ]
    got = {r["feature_id"]: (r["branch"], r["season"], r["reason"]) for r in season.season_status(claims(spark, rows), at).collect()}
    assert got == {1: (1, "closed", None), 2: (2, "open", "in_season"), 3: (3, "unstaffed", None), 4: (4, "open", None), 5: (5, "closed", "out_of_season"), 6: (6, "unknown", None)}


def test_undated_transient_says_unknown(spark):
    got = review.demote_undated(claims(spark, [claim(1), claim(2, status="unstaffed")])).orderBy("id").collect()
    assert [(r["status"], r["undated_status"]) for r in got] == [("unknown", "closed"), ("unstaffed", None)]


def test_json_sources(spark):
    geo_json = '{"features":[{"geometry":{"coordinates":[6.8,45.9]},"properties":{"id":7,"nom":" Refuge ","coord":{"alt":2602},"places":{"valeur":0},"info_comp":{"eau":{"valeur":"oui"},"latrines":{"valeur":"?"}},"date":{"derniere_modif":"2026-05-01"}}},{"properties":{"nom":"no id"}}]}'
    row = js.flatten_geojson(spark.createDataFrame([(geo_json,)], "json string")).collect()
    assert [(r["cand_id"], r["name"], r["capacity"], r["water"], r["latrines"]) for r in row] == [(7, "Refuge", None, True, None)]
    days = '{"feature_slug":"h","availability":[{"date":"2026-06-01T00:00","hutStatus":"SERVICED","freeBeds":3},{"date":"2026-06-02","hutStatus":"SERVICED"},{"date":"bad","hutStatus":"CLOSED"},{"date":"2026-06-03","hutStatus":"CLOSED"}]}'
    assert [r["state"] for r in js.flatten_availability(spark.createDataFrame([(days,)], "json string")).orderBy("day").collect()] == ["SERVICED", "CLOSED"]
    tags = spark.createDataFrame([(1, {"tourism": "alpine_hut", "name": "A", "name:it": "B"}, 1.0, 2.0), (2, {"natural": "peak", "name": "P", "ele": "2900"}, 1.0, 2.0), (3, {"aerialway": "gondola"}, 1.0, 2.0)], "id long, tags map<string,string>, lat double, lon double")
    assert [(r["id"], r["kind"], r["names"]) for r in js.classify_osm_tags(tags).collect()] == [(1, "hut", {"name:it": "B"})]
    cells = spark.createDataFrame([("h", "Août 2026", "31", ["available"]), ("h", "Février 2026", "31", ["few"]), ("h", "Juin 2026", "2", ["full"])], "entity string, month_title string, day string, classes array<string>")
    assert [r["day"] for r in js.calendar_cells(cells).collect()] == [D(2026, 8, 31)]
    blocks = '[{"season":"S","rows":[{"title":"A","subtitle":"x","start":"2026-06-01","end":"2026-06-02"},{"title":"a","subtitle":"X","start":"2026-06-03","end":"2026-06-05"},{"hidden":true,"title":"B","subtitle":"","start":"2026-06-01"},{"title":"C","subtitle":""}]},{"hidden":true,"season":"T","rows":[]}]'
    assert [(r["title"], r["start"], r["end"]) for r in js.explode_nested_rows(spark.createDataFrame([(blocks,)], "json string")).collect()] == [("a", D(2026, 6, 1), D(2026, 6, 5))]
    outings = '{"feature_slug":"r","outings":[{"document_id":1,"condition_rating":"good","date_end":"2026-06-20"},{"document_id":2,"condition_rating":"good","date_end":"2026-01-20"},{"document_id":3,"condition_rating":"odd","date_end":"2026-06-20"}]}'
    assert [r["report_id"] for r in js.flatten_outings(spark.createDataFrame([(outings,)], "json string"), "2026-07-01").collect()] == [1]


def run_stream(spark, folder, parts, schema, function):
    """One micro-batch for each part, in order."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/part{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    stream.writeStream.foreachBatch(function).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch(spark, tmp_path):
    rows = [claim(i, feature_id=1 + i % 3, type="closure" if i % 2 else "opening", status="closed" if i % 2 else "open", observed_at=D(2026, 5, 1) + dt.timedelta(days=i * 7 % 11)) for i in range(1, 31)]
    whole = claims(spark, rows)
    sources = spark.createDataFrame([(1, "s", 0.5, 60, None), (2, "t", 0.4, 60, None)], tb.SCHEMAS["sources"])
    live, told = (inc.Buckets(spark, f"{tmp_path}/{n}", x, "feature_id", 8) for n, x in (("claims", tb.SCHEMAS["claims"]), ("status", "feature_id long, status string, claim_id string")))
    parts = [whole.filter(F.col("seq").between(k * 5 + 1, k * 5 + 5)) for k in range(6)]
    run_stream(spark, tmp_path, parts, tb.SCHEMAS["claims"], inc.run_claims(live, told, sources, "2026-05-20"))
    batch = lifecycle.settle(whole)
    assert {r["id"] for r in live.all().collect()} == {r["id"] for r in batch.collect()}
    expected = {(r["feature_id"], r["status"], r["claim_id"]) for r in st.current_status(batch, sources, "2026-05-20").collect()}
    assert {(r["feature_id"], r["status"], r["claim_id"]) for r in told.all().collect()} == expected
    assert len(live._batches("maps")) == 2 and len(live._batches("data")) <= 3  # what no map needs is gone


def test_stream_of_sightings(spark, tmp_path):
    df = claims(spark, [claim(k, document_id=k, last_seen_at=D(2026, 5, k)) for k in range(1, 5)])
    met = [(1, D(2026, 6, 1)), (1, D(2026, 6, 3)), (2, D(2026, 4, 1))]
    store = inc.Store(spark, f"{tmp_path}/met", "document_id long, seen_at date")
    run_stream(spark, f"{tmp_path}/a", [spark.createDataFrame([x], store.schema) for x in met], store.schema, inc.run_sightings(store))
    seen = {r["id"]: r["last_seen_at"] for r in inc.confirm(df, store.all()).collect()}
    whole = {r["id"]: r["last_seen_at"] for r in inc.confirm(df, spark.createDataFrame(met, store.schema)).collect()}
    assert seen == whole and sorted(seen.values()) == [D(2026, 5, 2), D(2026, 5, 3), D(2026, 5, 4), D(2026, 6, 3)]


def test_stream_dedup_and_counts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, "b")], "source_id long, content_hash string")
    for k in range(2):
        docs.coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    store = inc.Store(spark, f"{tmp_path}/docs", "source_id long, content_hash string")
    stream = spark.readStream.schema("source_id long, content_hash string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.writeStream.foreachBatch(inc.new_documents(store)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert store.all().count() == 3
    spark.createDataFrame([(1, "Hut", D(2026, 5, 1)), (1, "hut", D(2026, 5, 3))], "source_id long, mention string, seen_at date").write.parquet(f"{tmp_path}/m")
    m = spark.readStream.schema("source_id long, mention string, seen_at date").parquet(f"{tmp_path}/m")
    q = inc.count_mentions_stream(m).writeStream.outputMode("complete").format("memory").queryName("mentions_seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["seen_count"], r["last_seen"]) for r in spark.table("mentions_seen").collect()] == [(2, D(2026, 5, 3))]


def test_absence_counter_agrees_with_retirement(spark):
    source = spark.createDataFrame([(1, "s", 0.5, 60, 2)], tb.SCHEMAS["sources"])
    runs = spark.createDataFrame([(k, 1, D(2026, 5, 1) + dt.timedelta(days=k), k != 3) for k in range(6)], tb.SCHEMAS["runs"])
    df = claims(spark, [claim(k, last_seen_at=D(2026, 5, k)) for k in range(1, 7)])
    counted = {r["id"] for r in inc.absence_counts(df, runs).filter("missed >= 2").collect()}
    assert counted == {r["id"] for r in lifecycle.retire_unmentioned(df, runs, source).collect()}
