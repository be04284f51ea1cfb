"""Comparison of factors and a benchmark as a dashboard shows them: series with a start point, slices, ratios, lookups."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .calendar import PERIODS
from .metrics import CAP

#: Slices by the periods they span; a year has 12 of them here whatever the calendar. None: all.
SLICES = {"all": None, "1y": 12, "3y": 36, "ytd": 0}
LISTED = 20


def points(returns: DataFrame) -> DataFrame:
    """``factor, date, equity, drawdown``: 1 at the start of the first period, then the value after each period.

    Of several periods that end on a date the last, by its start, gives the point. Rows without a return are left out.
    """
    rows = returns.where(F.col("return").isNotNull() & ~F.isnan("return") & F.col("period_end").isNotNull())
    order = Window.partitionBy("factor").orderBy("period_end", "period_start").rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.withColumn("equity", F.product(1 + F.col("return")).over(order))
    peak = F.greatest(F.lit(1.0), F.max("equity").over(order))
    curve = curve.withColumn("drawdown", F.when(peak > 0, F.col("equity") / peak - 1).otherwise(0.0))
    ends = curve.groupBy("factor", F.col("period_end").alias("date")).agg(F.max_by(F.struct("equity", "drawdown"), "period_start").alias("p")).select("factor", "date", "p.equity", "p.drawdown")
    begin = rows.groupBy("factor").agg(F.min_by("period_start", F.struct("period_end", "period_start")).alias("date")).where("date is not null")
    begin = begin.join(ends.select("factor", "date"), ["factor", "date"], "left_anti")
    return ends.unionByName(begin.select("factor", "date", F.lit(1.0).alias("equity"), F.lit(0.0).alias("drawdown")))


def slices(series: DataFrame) -> DataFrame:
    """``series`` with ``slice``, a row for each slice that a point is in; the year to date begins with the point before it."""
    own = Window.partitionBy("factor")
    this_year = F.year("date") == F.year(F.max("date").over(own))
    rows = series.withColumn("back", F.row_number().over(own.orderBy(F.desc("date")))).withColumn("ytd", F.greatest(F.lit(2), F.sum(this_year.cast("int")).over(own) + 1))
    inside = [F.when(F.lit(True) if n is None else F.col("back") <= (F.col("ytd") if name == "ytd" else n + 1), F.lit(name)) for name, n in SLICES.items()]
    return rows.withColumn("slice", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull()))).drop("back", "ytd")


def comparison(returns: DataFrame, frequency: str = "M") -> DataFrame:
    """Metrics of each factor and slice with two points or more: uncapped, 999 or null where a ratio has no base."""
    p = PERIODS[frequency]
    own = Window.partitionBy("factor", "slice").orderBy("date")
    rows = slices(points(returns)).withColumn("before", F.lag("equity").over(own))
    peak = F.max("equity").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("step", F.when(F.col("before") > 0, F.col("equity") / F.col("before") - 1)).withColumn("down", F.when(peak > 0, F.col("equity") / peak - 1))
    sums = rows.groupBy("factor", "slice").agg(
        F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"), F.count("step").alias("n"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("spread"),
        F.avg(F.when(F.col("step").isNotNull(), F.pow(F.least("step", F.lit(0.0)), F.lit(2.0)))).alias("below"), F.least(F.lit(0.0), F.min("down")).alias("max_drawdown"),
    ).where("n > 0")
    out = sums.withColumn("cumulative", F.when(F.col("first") > 0, F.col("last") / F.nullif("first", F.lit(0.0)) - 1))
    out = out.withColumn("cagr", F.when(F.col("cumulative") > -1, F.pow(1 + F.col("cumulative"), F.lit(float(p)) / F.col("n")) - 1).otherwise(-1.0))
    out = out.withColumns({"volatility": F.col("spread") * math.sqrt(p), "downside": F.sqrt("below") * math.sqrt(p), "annual": F.col("mean") * p})
    return out.select(
        "factor", "slice", "n", "cumulative", "cagr", "volatility", F.when(F.col("volatility") > 0, F.col("annual") / F.nullif("volatility", F.lit(0.0))).alias("sharpe"),
        F.when(F.col("downside") > 0, F.col("annual") / F.nullif("downside", F.lit(0.0))).when(F.col("annual") > 0, CAP).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.nullif(F.abs("max_drawdown"), F.lit(0.0))).when(F.col("cagr") > 0, CAP).alias("calmar"), "max_drawdown",
    )


def benchmark_series(benchmark: DataFrame) -> DataFrame:
    """The returns of one benchmark: of the ticker whose first period ends earliest, by name among several."""
    rows = benchmark.where(F.col("return").isNotNull() & ~F.isnan("return") & F.col("period_end").isNotNull())
    first = rows.agg(F.min(F.struct("period_end", "ticker"))["ticker"].alias("ticker"))
    return rows.join(F.broadcast(first), "ticker", "left_semi")  # one row


def default_factor(selected: Iterable[str], ranks: DataFrame, returns: DataFrame) -> str:
    """The factor to compare the best one with: the first selected other than it that has returns, else the next ranked with returns, else the best."""
    having = {r.factor for r in returns.where(F.col("return").isNotNull() & ~F.isnan("return")).select("factor").distinct().collect()}
    order = [r.factor for r in ranks.orderBy("rank").select("factor").collect()]
    best = order[0] if order else ""
    return next((f for f in [*selected, *order] if f != best and f in having), best)


def nearest_date(series: DataFrame, asked: dt.date | None = None) -> DataFrame:
    """One row: the observed date nearest to the one asked for, the earlier of two; the last one if none is asked for."""
    apart = F.abs(F.datediff("date", F.lit(asked))) if asked else F.lit(0)
    return series.agg(F.min(F.struct(apart.alias("apart"), F.col("date")))["date"].alias("date") if asked else F.max("date").alias("date"))


def at_date(series: DataFrame, date: dt.date) -> DataFrame:
    """The points of exactly that date: nothing is carried forward."""
    return series.where(F.col("date") == F.lit(date))


def sorted_by(ranks: DataFrame, metric: str = "composite_score", contains: str = "", selected: Iterable[str] = (), limit: int = LISTED) -> DataFrame:
    """``place`` and the columns of ``ranks``: the best by a metric, missing last, ties by name, among names that contain a text; selected factors are added."""
    value = F.coalesce(F.when(~F.isnan(metric) & (F.abs(metric) < float("inf")), F.col(metric)), F.lit(-math.inf))
    order = Window.orderBy(F.desc(value), "factor")  # a row for each factor
    rows = ranks.withColumn("fits", F.lower("factor").contains(contains.lower())).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("shown", F.sum(F.col("fits").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("fits") & (F.col("shown") <= limit)) | F.col("factor").isin(list(selected))).drop("fits", "shown")
