"""Small helpers of the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types that describe a notice, and statuses that state something about a moment.
NOTICE_TYPES = ("closure", "restriction", "hazard_observation")
TRANSIENT = ("open", "closed", "restricted")
TYPES = ("operational_status", "closure", "restriction", "opening", "condition", "hazard_observation")
STATUSES = ("open", "closed", "restricted", "unstaffed", "unknown")


def day(as_of: dt.date | str) -> Column:
    return F.lit(as_of).cast("date")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under a total order."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rank_ = 1").drop("rank_")


def overlaps(a: str, b: str) -> Column:
    """Whether the windows a and b (column prefixes) meet; a null end is unbounded."""
    return (F.col(f"{a}valid_from").isNull() | F.col(f"{b}valid_to").isNull() | (F.col(f"{a}valid_from") <= F.col(f"{b}valid_to"))) & (
        F.col(f"{b}valid_from").isNull() | F.col(f"{a}valid_to").isNull() | (F.col(f"{b}valid_from") <= F.col(f"{a}valid_to"))
    )


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))
