"""Keyed state and bucketed tables against the batch operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import lifecycle
from waymark.sources import tables as tb
from waymark.streaming import absences
from waymark.streaming import incremental as inc

EVENTS = "source_id long, started_at date, ok boolean, id string"
DAY = dt.date(2026, 5, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_of(spark, folder, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_unmentioned_claims_equal_the_batch_form(rocks, tmp_path):
    spark, rng = rocks, random.Random(2)
    sources = spark.createDataFrame([(1, "s", 0.5, 60, 3), (2, "t", 0.5, 60, None), (3, "u", 0.5, 60, 1)], tb.SCHEMAS["sources"])
    events = [(rng.choice([1, 2, 3]), DAY + dt.timedelta(days=rng.randrange(30)), rng.random() < 0.8, None) for _ in range(40)]
    events += [(s := rng.choice([1, 2, 3]), DAY + dt.timedelta(days=rng.randrange(30)), True, f"c{s}-{rng.randrange(25)}") for _ in range(120)]
    rng.shuffle(events)
    parts = [events[k : k + 32] for k in range(0, len(events), 32)]
    found = absences.unmentioned(stream_of(spark, tmp_path, parts, EVENTS), sources, buckets=3)
    out = []

    def keep(df, batch):
        out.extend((batch, *r) for r in df.collect())

    found.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame(events, EVENTS)
    claims = whole.filter("id is not null").groupBy("id", "source_id").agg(F.max("started_at").alias("last_seen_at"))
    runs = whole.filter("id is null").select(F.monotonically_increasing_id().alias("run_id"), "source_id", "started_at", "ok")
    expected = {(r["id"], r["last_seen_at"]) for r in lifecycle.retire_unmentioned(claims, runs, sources).collect()}
    latest = {r["id"]: r["last_seen_at"] for r in claims.collect()}
    got = {(x[2], x[3]) for x in out if latest[x[2]] == x[3]}  # earlier retirements ended with a later mention
    assert got == expected and expected
    assert len(out) == len({(x[2], x[3]) for x in out})


def test_first_of_each_key_ever(rocks, tmp_path):
    parts = [[(1, "a"), (1, "a")], [(1, "a"), (2, "a")], [(2, "a"), (1, "b"), (1, "a")]]
    stream = inc.dedup_all(stream_of(rocks, tmp_path, parts, "source_id long, content_hash string"), ["source_id", "content_hash"])
    q = stream.writeStream.outputMode("append").format("memory").queryName("first_ever").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in rocks.table("first_ever").collect()) == [(1, "a"), (1, "b"), (2, "a")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 3


def test_buckets_read_what_they_touch_and_can_run_again(spark, tmp_path):
    table = inc.Buckets(spark, str(tmp_path), "k long, v long", "k", 8)
    rows = lambda *x: spark.createDataFrame(list(x), table.schema)
    assert table.all().count() == 0
    for batch in range(12):
        fresh = rows((batch % 3, batch))
        mine = table.touched(fresh)
        assert len(mine) == 1
        table.put(table.read(batch, mine).unionByName(fresh), batch, mine)
    expected = sorted((b % 3, b) for b in range(12))
    assert sorted(tuple(r) for r in table.all().collect()) == expected
    mine = table.touched(rows((2, 0)))
    table.put(table.read(11, mine).unionByName(rows((2, 11))), 11, mine)  # the last batch once more
    assert sorted(tuple(r) for r in table.all().collect()) == expected
    assert len(table.read(12, mine).inputFiles()) <= 4 and len(table._batches("maps")) == 2
    table.put(spark.createDataFrame([], table.schema), 12, mine)
    assert sorted(tuple(r) for r in table.all().collect()) == [x for x in expected if x[0] not in {k for k in (0, 1, 2) if table.touched(rows((k, 0))) == mine}]
