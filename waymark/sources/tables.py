"""Schemas of the claims engine and the given star-schema tables seen as its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base tables and their columns, for scans of Parquet or JSON files.
SCHEMAS = {
    "features": "feature_id long, name string, kind string, parent_id long, altitude_m int, active boolean, lat double, lon double",
    "sources": "source_id long, name string, trust double, interval_min int, retire_after int",
    "documents": "document_id long, source_id long, fetched_at timestamp, extracted_at timestamp, content string, content_hash string",
    "claims": "id string, feature_id long, source_id long, document_id long, seq long, type string, status string, severity int, observed_at date, last_seen_at date, valid_from date, valid_to date, needs_review boolean, reviewed_at date, schedule boolean, superseded_at date, superseded_by string, retired_reason string, evidence string",
    "status": "feature_id long, status string, severity int, claim_id string, observed_at date, stale_after date",
    "mentions": "source_id long, mention string, first_seen date, last_seen date, seen_count long, resolved_to long, dismissed boolean",
    "runs": "run_id long, source_id long, started_at date, ok boolean",
    "facts": "feature_id long, source_id long, key string, value string, fetched_at date",
}


def scan_tables(spark: SparkSession, folder: str, form: str = "parquet") -> dict[str, DataFrame]:
    """Every base table under its fixed schema, read from folder/name."""
    return {name: spark.read.schema(schema).format(form).load(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "part").selectExpr(
        "p_partkey AS feature_id", "p_name AS name", "lower(p_type) AS kind",
        "CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 10 END AS parent_id", "CAST(p_size * 100 AS INT) AS altitude_m",
        "p_partkey % 50 <> 7 AS active", "45.72D + CAST((p_partkey * 37) % 330 AS DOUBLE) / 1000 AS lat", "6.60D + CAST((p_partkey * 53) % 50 AS DOUBLE) / 1000 AS lon",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        base(spark, sf_dir, "supplier")
        .selectExpr(
            "s_suppkey AS source_id", "s_name AS name", "CAST(1 + s_nationkey % 9 AS DOUBLE) / 10 AS trust",
            "CAST(180 * (1 + s_nationkey % 4) AS INT) AS interval_min", "CASE WHEN s_suppkey % 2 = 0 THEN 40 END AS retire_after",
        )
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each line item; superseded_at is filled for a few, as history."""
    return (
        base(spark, sf_dir, "lineitem")
        .withColumn("d", F.to_date("l_shipdate"))
        .selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_quantity AS INT)) AS id", "l_partkey AS feature_id", "l_suppkey AS source_id", "l_orderkey AS document_id",
            "l_orderkey * 8 + l_linenumber AS seq",
            "CASE l_returnflag WHEN 'A' THEN 'closure' WHEN 'R' THEN 'opening' WHEN 'N' THEN 'restriction' END AS type",
            "CASE WHEN l_linestatus = 'F' THEN 'unknown' WHEN l_returnflag = 'A' THEN 'closed' WHEN l_returnflag = 'N' THEN 'restricted' WHEN l_linenumber = 7 THEN 'unstaffed' ELSE 'open' END AS status",
            "l_linenumber % 4 AS severity", "d AS observed_at", "date_add(d, CAST(l_quantity * 10 AS INT)) AS last_seen_at",
            "CASE WHEN l_linenumber NOT IN (3, 6) THEN d END AS valid_from", "CASE WHEN l_linenumber NOT IN (2, 3) THEN date_add(d, CAST(l_quantity * 10 AS INT)) END AS valid_to",
            "l_discount >= 0.08D AS needs_review", "CASE WHEN l_tax < 0.03D THEN d END AS reviewed_at", "l_returnflag = 'R' AND l_linestatus = 'F' AS schedule",
            "CASE WHEN l_tax >= 0.07D THEN date_add(d, CAST(l_quantity * 10 AS INT) + 1) END AS superseded_at", "CAST(NULL AS STRING) AS superseded_by",
            "CASE WHEN l_tax >= 0.08D THEN 'unmentioned' END AS retired_reason", "CASE WHEN l_linenumber <> 4 THEN concat(l_returnflag, l_linestatus) END AS evidence",
        )
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        base(spark, sf_dir, "orders")
        .crossJoin(F.broadcast(base(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("suppliers"))))
        .selectExpr("o_orderkey AS run_id", "1 + o_custkey % suppliers AS source_id", "to_date(o_orderdate) AS started_at", "o_orderstatus <> 'F' AS ok")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS cand_id", "c_name AS name", "CAST(100 * (1 + c_custkey % 50) AS INT) AS altitude_m",
        "45.72D + CAST((c_custkey * 37) % 330 AS DOUBLE) / 1000 + 0.0003D AS lat", "6.60D + CAST((c_custkey * 41) % 50 AS DOUBLE) / 1000 AS lon",
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity, state and day of the event table."""
    return base(spark, sf_dir, "events").selectExpr("user_id AS entity", "event_type AS state", "CAST(ts AS DATE) AS day").distinct()


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of features by source: a key from each supplier's view of a part."""
    return base(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS feature_id", "l_suppkey AS source_id", "CASE l_linenumber % 3 WHEN 1 THEN 'beds' WHEN 2 THEN 'phone' ELSE 'site' END AS key",
        "CASE WHEN l_tax > 0.01D THEN CAST(CAST(l_quantity AS INT) AS STRING) END AS value", "to_date(l_shipdate) AS fetched_at",
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names met in orders' text: one row for each sighting."""
    return base(spark, sf_dir, "orders").join(base(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "o_custkey % 8 AS source_id", "CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS mention", "to_date(o_orderdate) AS seen_at"
    )


#: The same tables for the SQL that the results are held against.
SQL_TABLES = """
feat AS (SELECT p_partkey AS feature_id, p_name AS name, lower(p_type) AS kind,
  CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 10 END AS parent_id, CAST(p_size * 100 AS INT) AS altitude_m,
  p_partkey % 50 <> 7 AS active, CAST(45.72 AS DOUBLE) + CAST((p_partkey * 37) % 330 AS DOUBLE) / 1000 AS lat,
  CAST(6.60 AS DOUBLE) + CAST((p_partkey * 53) % 50 AS DOUBLE) / 1000 AS lon FROM part),
src AS (SELECT s_suppkey AS source_id, s_name AS name, CAST(1 + s_nationkey % 9 AS DOUBLE) / 10 AS trust,
  CAST(180 * (1 + s_nationkey % 4) AS INT) AS interval_min, CASE WHEN s_suppkey % 2 = 0 THEN 40 END AS retire_after FROM supplier),
stmt AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_quantity AS INT)) AS id, l_partkey AS feature_id, l_suppkey AS source_id, l_orderkey AS document_id,
  l_orderkey * 8 + l_linenumber AS seq,
  CASE l_returnflag WHEN 'A' THEN 'closure' WHEN 'R' THEN 'opening' WHEN 'N' THEN 'restriction' END AS type,
  CASE WHEN l_linestatus = 'F' THEN 'unknown' WHEN l_returnflag = 'A' THEN 'closed' WHEN l_returnflag = 'N' THEN 'restricted' WHEN l_linenumber = 7 THEN 'unstaffed' ELSE 'open' END AS status,
  l_linenumber % 4 AS severity, CAST(l_shipdate AS DATE) AS observed_at, CAST(l_shipdate AS DATE) + CAST(l_quantity * 10 AS INT) AS last_seen_at,
  CASE WHEN l_linenumber NOT IN (3, 6) THEN CAST(l_shipdate AS DATE) END AS valid_from,
  CASE WHEN l_linenumber NOT IN (2, 3) THEN CAST(l_shipdate AS DATE) + CAST(l_quantity * 10 AS INT) END AS valid_to,
  l_discount >= 0.08 AS needs_review, CASE WHEN l_tax < 0.03 THEN CAST(l_shipdate AS DATE) END AS reviewed_at, l_returnflag = 'R' AND l_linestatus = 'F' AS schedule,
  CASE WHEN l_tax >= 0.07 THEN CAST(l_shipdate AS DATE) + (CAST(l_quantity * 10 AS INT) + 1) END AS superseded_at, CAST(NULL AS VARCHAR) AS superseded_by,
  CASE WHEN l_tax >= 0.08 THEN 'unmentioned' END AS retired_reason, CASE WHEN l_linenumber <> 4 THEN l_returnflag || l_linestatus END AS evidence FROM lineitem),
run AS (SELECT o_orderkey AS run_id, 1 + o_custkey % (SELECT count(*) FROM supplier) AS source_id, CAST(o_orderdate AS DATE) AS started_at, o_orderstatus <> 'F' AS ok FROM orders),
cand AS (SELECT c_custkey AS cand_id, c_name AS name, CAST(100 * (1 + c_custkey % 50) AS INT) AS altitude_m,
  CAST(45.72 AS DOUBLE) + CAST((c_custkey * 37) % 330 AS DOUBLE) / 1000 + CAST(0.0003 AS DOUBLE) AS lat, CAST(6.60 AS DOUBLE) + CAST((c_custkey * 41) % 50 AS DOUBLE) / 1000 AS lon FROM customer),
cal AS (SELECT DISTINCT user_id AS entity, event_type AS state, CAST(ts AS DATE) AS day FROM events),
fact AS (SELECT l_partkey AS feature_id, l_suppkey AS source_id, CASE l_linenumber % 3 WHEN 1 THEN 'beds' WHEN 2 THEN 'phone' ELSE 'site' END AS key,
  CASE WHEN l_tax > 0.01 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS value, CAST(l_shipdate AS DATE) AS fetched_at FROM lineitem),
ment AS (SELECT o_custkey % 8 AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS mention, CAST(o_orderdate AS DATE) AS seen_at FROM orders JOIN customer ON o_custkey = c_custkey)
"""
