"""Every registered job on a document of its kind, all in one pass."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from waymark.plans import extraction as ex
from waymark.plans import jobs

D = dt.date
DOCS = [
    (1, "notices", "Fermeture du sentier du 1 au 3 mai 2026", "Le refuge Vallot est fermé du 1 au 3 mai 2026."),
    (2, "digests", "", "Le refuge Vallot est de nouveau ouvert cette semaine. Rien d'autre."),
    (3, "live_board", "", json.dumps([{"sector": "Midi", "lift": "TPH", "kind": "lift", "is_pending": False, "is_open": True}, {"sector": "Midi", "lift": "TS", "kind": "lift", "is_pending": False, "is_open": False}])),
    (4, "calendar", "", json.dumps([{"season": "hiver", "title": "Flégère", "start": "2026-01-02", "end": "2026-04-05"}, {"season": "hiver", "title": "Sans date"}])),
    (5, "timetable", "Tramway", "Ouvert du 13 juin 2026 au 20 septembre 2026."),
    (6, "wiki", "", json.dumps([{"ref": "w1", "name": "Refuge A", "state": "Fermé"}, {"ref": "w2", "name": "Ancien refuge", "state": "Fermé"}, {"ref": "w3", "name": "Refuge B", "guarded": False}, {"ref": "w4", "name": "Silence"}])),
    (7, "availability", "", json.dumps([{"entity": "Hut", "day": f"2026-06-0{k}", "state": "SERVICED"} for k in (1, 2, 3)])),
    (8, "booking", "", json.dumps([{"entity": "Hut", "day": f"2026-06-0{k}", "state": "available"} for k in (2, 4)])),
    (9, "wardens", "Refuge C", "Période de gardiennage\nPrintemps : 14 mars au 3 mai 2026\n\nOuverture le 30 mai 2026\nFermeture le 4 octobre 2026"),
    (10, "reports", "", json.dumps([{"route": "Arête", "report_id": 1, "day": "2026-05-01", "severity": 1}, {"route": "Arête", "report_id": 2, "day": "2026-05-20", "severity": 2}])),
    (11, "wiki", "", "not json"),
    (12, None, "", "nobody reads this"),
    (13, "unheard of", "", "nor this"),
]


def test_every_job_in_one_pass(spark):
    docs = spark.createDataFrame([(k, 100 + k, t, c, dt.datetime(2026, 6, 2)) for k, _, t, c in DOCS], "document_id long, source_id long, title string, content string, fetched_at timestamp")
    policy = spark.createDataFrame([(100 + k, j) for k, j, _, _ in DOCS if j], "source_id long, job string")
    claims, unserved = ex.extract(docs, policy, ex.Setting("2026-06-02", [(7, "vallot")]))
    got = sorted((r["document_id"], r["source_id"], r["feature_id"], r["mention"], r["ref"], r["type"], r["status"], r["valid_from"], r["valid_to"]) for r in claims.collect())
    assert sorted(r["document_id"] for r in unserved.collect()) == [12, 13]
    own = {k: [x[2:] for x in got if x[0] == k] for k in range(1, 12)}
    assert all(x[1] == 100 + x[0] for x in got)
    assert own[1] == [(7, None, None, "closure", "closed", D(2026, 5, 1), D(2026, 5, 3))]
    assert own[2] == [(7, None, None, "opening", "open", D(2026, 6, 2), D(2026, 6, 23))]
    assert sorted((x[1], x[4]) for x in own[3]) == [("Midi", "restricted"), ("TPH", "open"), ("TS", "closed")]
    assert own[4] == [(None, "Flégère", "hiver", "opening", "unknown", D(2026, 1, 2), D(2026, 4, 5))]
    assert own[5] == [(None, "Tramway", "", "opening", "unknown", D(2026, 6, 13), D(2026, 9, 20))]
    assert sorted((x[1], x[2], x[3], x[4]) for x in own[6]) == [("Refuge A", "w1", "closure", "closed"), ("Refuge B", "w3", "opening", "unstaffed")]
    assert own[7] == [(None, "Hut", "", "opening", "open", D(2026, 6, 1), D(2026, 6, 3))]
    assert own[8] == [(None, "Hut", "", "opening", "open", D(2026, 6, 2), D(2026, 6, 4))]
    assert sorted(x[5:] for x in own[9]) == [(D(2026, 3, 14), D(2026, 5, 3)), (D(2026, 5, 30), D(2026, 10, 4))]
    assert own[10] == [(None, "Arête", "", "condition", "unknown", D(2026, 5, 20), D(2026, 6, 19))] and own[11] == []


def test_the_plan_does_not_grow_with_the_sources(spark):
    docs = spark.range(400).selectExpr("id AS document_id", "id AS source_id", "'' AS title", "'[]' AS content", "timestamp'2026-06-02 00:00:00' AS fetched_at")
    sizes = []
    for n in (2, 200):
        policy = spark.range(n).select(F.col("id").alias("source_id"), F.lit("wiki").alias("job"))
        plan = ex.extract(docs, policy, ex.Setting("2026-06-02"))[0]._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Relation"))
    assert sizes[0] == sizes[1]


def test_labelled_seasons_of_one_block_stay_apart(spark):
    lines = ["Période de gardiennage :", "Printemps :", "Ouverture le 14 mars 2026", "Fermeture le 3 mai 2026", "Été:", "Ouverture le 30 mai 2026", "Ouverture le 6 juin 2026", "Fermeture le 4 octobre 2026 à 7h", "Automne : 5 octobre au 9 octobre 2026"]
    df = spark.createDataFrame([("a", 1, k, x, 2026) for k, x in enumerate(lines)] + [("b", 1, 0, "Fermeture le 3 mai 2026", 2026), ("b", 1, 1, "Ouverture le 9 mai 2026", 2026)], "doc_id string, block int, place int, line string, year int")
    got = {(r["doc_id"], r["label"], r["valid_from"], r["valid_to"]) for r in jobs.warden_seasons_to_claims(df).collect()}
    assert got == {("a", "Printemps", D(2026, 3, 14), D(2026, 5, 3)), ("a", "Été", D(2026, 6, 6), D(2026, 10, 4)), ("a", "Automne", D(2026, 10, 5), D(2026, 10, 9))}


def test_counters_belong_to_the_run_before(spark):
    runs = spark.createDataFrame([(1, 5, D(2026, 1, 1)), (2, 5, D(2026, 1, 3)), (3, 5, D(2026, 1, 3)), (4, 6, D(2026, 1, 2))], "run_id long, source_id long, started_at date")
    docs = spark.createDataFrame([(5, dt.datetime(2026, 1, 2)), (5, dt.datetime(2026, 1, 3)), (6, dt.datetime(2026, 1, 1))], "source_id long, fetched_at timestamp")
    claims = spark.createDataFrame([(5, D(2026, 1, 1), D(2026, 1, 4), None), (5, D(2026, 1, 3), D(2026, 1, 3), D(2026, 1, 9))], "source_id long, observed_at date, last_seen_at date, superseded_at date")
    seen = spark.createDataFrame([(5, D(2026, 1, 2))], "source_id long, seen_at date")
    got = {(r["source_id"], r["run_id"]): (r["documents"], r["claims"], r["unresolved"], r["confirmed"], r["retired"]) for r in jobs.run_counters(runs, docs, claims, seen).collect()}
    assert got == {(5, 1): (1, 1, 1, 0, 0), (5, 2): (0, 0, 0, 0, 0), (5, 3): (1, 1, 0, 1, 1), (6, 4): (0, 0, 0, 0, 0), (6, None): (1, 0, 0, 0, 0)}


def test_rows_at_any_depth(spark):
    from waymark.sources.json_sources import explode_nested_rows

    row = lambda t, **more: {"title": t, "start": "2026-06-01", "end": "2026-06-05", **more}
    deep = [{"season": "ete", "a": {"b": [{"c": {"rows": [row("Deep"), row("DEEP", start="2026-05-30")]}}]}}, row("Top"), {"hidden": True, "rows": [row("Gone")]}, [[[[row("Lists", season="printemps", subtitle="S")]]]]]
    blocks = [json.dumps(deep), json.dumps({"rows": [row("Alone"), row("No day", start=None), row("Odd", start="soon"), {"title": "Holder", "rows": [row("Inside", hidden=True)]}]}), "no json", None, "[]", "3"]
    got = sorted((r["season"] or "", r["title"], r["subtitle"], r["start"], r["end"]) for r in explode_nested_rows(spark.createDataFrame([(b,) for b in blocks], "json string")).collect())
    a, b = D(2026, 6, 1), D(2026, 6, 5)
    assert got == [("", "alone", "", a, b), ("", "top", "", a, b), ("ete", "deep", "", D(2026, 5, 30), b), ("printemps", "lists", "s", a, b)]
