"""Queries and operators on rows that only larger tables have: ids that collide, copies of names and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import facts as fa


def test_a_source_is_new_by_its_slug(spark):
    now = spark.createDataFrame([(0, "a", 360), (100, "b", 180)], "source_id long, slug string, interval_min int")
    new = spark.createDataFrame([(100, "c", 5), (0, "a", 7), (7, "b", 7)], now.schema)
    patches = now.select("source_id", F.lit(360).alias("old_interval"), F.lit(60).alias("new_interval"))
    assert sorted(tuple(r) for r in fa.patch_config(now, patches, new).collect()) == [(0, "a", 60), (100, "b", 180), (100, "c", 5)]


def test_best_name_of_a_fitting_height(spark):
    from waymark.operators import places as pl

    own = [(1, "Refuge Customer 000000123", 1000), (2, "Refuge Customer 000000123", 2000), (3, "Refuge Customer 000000124", None), (4, "Nothing like it", 1000), (5, "Refuge Customer 000000123", 5000)]
    features = spark.createDataFrame([(*x, 46.0 + x[0], 6.6, None) for x in own], "feature_id long, name string, altitude_m int, lat double, lon double, curated_id long")
    offered = [(11, "Refuge Customer 000000123", 1120), (10, "Refuge Customer 000000123", 1090), (12, "Refuge Customer 000000129", 1999), (13, "Refuge Customer 000000199", 2000), (14, "refuge customer 000000124", 9), (15, "Refuge Customer 000009124", None)]
    candidates = spark.createDataFrame([(*x, 0.0, 0.0) for x in offered], "cand_id long, name string, altitude_m int, lat double, lon double")
    got = sorted(tuple(r) for r in pl.match_directory(features, candidates).collect())
    assert got == [(1, 10, "name"), (2, 12, "name"), (3, 14, "name"), (5, 15, "name")]


def test_floors_that_a_plain_ratio_reaches_with_a_letter_more_missing(spark):
    from waymark.operators.similar import similar_pairs

    sides = [spark.createDataFrame([(x,)], "key string") for x in ("customer 000012345", "customer 000012945")]
    assert [r["score"] for r in similar_pairs(*sides, 94.0).collect()] == [200 * 17 / 36]


def test_equal_positions_meet_once(spark):
    from waymark.operators import places as pl

    f = spark.range(1, 5001).select(F.col("id").alias("feature_id"), F.lit("a").alias("name"), (F.col("id") % 4 * 100).cast("int").alias("altitude_m"), F.lit(46.0).alias("lat"), F.lit(6.6).alias("lon"))
    c = f.select((F.col("feature_id") + 10000).alias("cand_id"), "name", (F.col("altitude_m") + 50).alias("altitude_m"), F.col("lat") + 0.001, "lon").withColumnRenamed("(lat + 0.001)", "lat")
    one = c.filter("cand_id % 4 = 3 and cand_id > 14998").withColumn("altitude_m", F.lit(1000))
    for found in (pl.radius_dedupe(c, f).count(), pl.match_by_position(f, c).count()):
        assert found == 0
    near = pl.nearest_within(f, c)
    assert [tuple(r) for r in near.select("cand_id").distinct().collect()] == [(10001,)] and near.count() == 5000
    assert {r["cand_id"] for r in pl.match_by_position(f.filter("feature_id < 9").withColumn("altitude_m", F.lit(1100)), c.unionByName(one)).collect()} == {14999}
    plan = pl._near(f.select("lat", "lon"), c.select("lat", "lon"), 150.0)
    assert plan.count() == 1
    pairs = pl.pairs_within(f.limit(50), c.limit(40), 150.0)
    assert pairs.count() == 2000 and pairs.columns == [*f.columns, *(f"r_{x}" for x in c.columns), "metres"]


def test_ways_are_listed_once_for_a_key(spark):
    from waymark.operators import places as pl

    f = spark.range(3).select(F.col("id").alias("feature_id"), F.lit("TC Bochard").alias("name"))
    ways = spark.createDataFrame([(9, "telecabine du Bochard 2"), (4, "Bochard"), (5, "Index")], "way_id long, name string")
    assert sorted(tuple(r) for r in pl.match_machines(f, ways).collect()) == [(k, [4, 9], 2) for k in range(3)]
    counted = pl.match_machines(f, ways).select("feature_id", "n_ways")
    assert "collect_list" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_a_written_step_leaves_no_shuffle_files(spark, tmp_path):
    from waymark.sources.shared import written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, tracker = spark.conf.get(key, None), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    n = tracker.shuffleStatuses().size()
    assert written(spark.range(1000).repartition(7, "id"), "dealt").count() == 1000
    assert tracker.shuffleStatuses().size() <= n + 1 and spark.conf.get(key, None) == before  # that of the count alone


def test_dry_run_and_counters_write_no_claims(spark, monkeypatch):
    from waymark.operators import lifecycle
    from waymark.plans import catalog

    def refuse(*_):
        raise AssertionError("stored claims are settled for a report")

    monkeypatch.setattr(lifecycle, "settle", refuse)
    assert catalog.QUERIES["re_extract_report"](spark, "/root/testdata/sf0.001").count() == 1500
    assert catalog.QUERIES["ingest_counters"](spark, "/root/testdata/sf0.001").count() == 8
