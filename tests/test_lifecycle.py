"""Replacement of claims against brute force, also for hot keys."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from waymark.operators import lifecycle as li

SCHEMA = "id string, seq long, feature_id long, source_id long, type string, observed_at date, valid_from date, valid_to date"
FIRST = dt.date(2020, 1, 1)


def days(n):
    return None if n is None else FIRST + dt.timedelta(days=n)


def random_claims(seed, n, keys, wide):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(3000)
        low, high = (None if r.random() < 0.1 else a), (None if r.random() < 0.1 else a + r.choice(wide))
        out.append((f"c{i}", r.randrange(n // 2), r.randrange(keys), 1, "closure", r.randrange(60) if r.random() < 0.5 else i, low, high))
    return out


def overlap(a, b):
    return (a[6] is None or b[7] is None or a[6] <= b[7]) and (b[6] is None or a[7] is None or b[6] <= a[7])


@pytest.mark.parametrize("wide", [(0, 1, 5), (0, 30, 900, 5000)])
def test_replacement_equals_brute_force(spark, wide):
    rows = random_claims(len(wide), 500, 3, wide)
    df = spark.createDataFrame([(*x[:5], days(x[5]), days(x[6]), days(x[7])) for x in rows], SCHEMA)
    replaced, backfilled = {}, {}
    for a in rows:
        for b in rows:
            if a[2] == b[2] and overlap(a, b):
                if (b[1], b[0]) > (a[1], a[0]) and a[5] <= b[5]:
                    replaced[a[0]] = min(replaced.get(a[0], b[1]), b[1])
                if a[5] < b[5]:
                    backfilled[a[0]] = min(backfilled.get(a[0], b[5]), b[5])
    assert {r["id"]: r["replaced_by_seq"] for r in li.supersede_replaced(df).collect()} == replaced
    assert {r["id"]: r["superseded_at"] for r in li.supersede_backfill(df).collect()} == {k: days(v) for k, v in backfilled.items()}


def test_one_key_of_fifty_thousand_claims(spark):
    """Windows of one day each, apart from one another: nothing is replaced, and no two claims need to meet."""
    df = spark.range(50_000).selectExpr(
        "concat('c', id) AS id", "id AS seq", "1L AS feature_id", "1L AS source_id", "'closure' AS type",
        "date_add(DATE'1900-01-01', CAST(id AS INT)) AS observed_at", "date_add(DATE'1900-01-01', CAST(id AS INT)) AS valid_from", "date_add(DATE'1900-01-01', CAST(id AS INT)) AS valid_to",
    )
    assert li.supersede_replaced(df).count() == 0
    open_ended = df.selectExpr("* EXCEPT (valid_to)", "CAST(NULL AS DATE) AS valid_to")
    assert li.supersede_replaced(open_ended).count() == 49_999
