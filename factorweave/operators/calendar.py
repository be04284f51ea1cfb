"""Rebalance calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"M": "month", "W": "week"}
PERIODS = {"M": 12, "W": 52}


def rebalance_dates(prices: DataFrame, frequency: str = "M") -> DataFrame:
    """``date``: the last one with prices in each calendar month or ISO week."""
    if frequency not in UNITS:
        raise ValueError(f"unknown frequency: {frequency}")
    return prices.groupBy(F.date_trunc(UNITS[frequency], "date").alias("unit")).agg(F.max("date").alias("date")).select("date")


def signal_periods(schedule: DataFrame) -> DataFrame:
    """``period, period_start, period_end``: neighbouring rebalance dates, numbered. A calendar is a handful of rows."""
    order = Window.orderBy("date")
    pairs = schedule.select((F.row_number().over(order) - 1).alias("period"), F.col("date").alias("period_start"), F.lead("date").over(order).alias("period_end"))
    return pairs.where("period_end is not null")
