"""Performance metrics, holdouts, rankings and comparison series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import PERIODS

CAP = 999.0
NAMES = ("cagr", "annual_return", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "turnover", "coverage")
# The weights of the composite score.
COMPOSITE = {"cagr": 0.20, "sharpe": 0.25, "sortino": 0.20, "calmar": 0.20, "max_drawdown": 0.10, "volatility": 0.05}


def equity_curve(returns: DataFrame) -> DataFrame:
    """``returns`` with ``equity`` after each period and ``drawdown`` against the peak so far, which starts at 1."""
    order = Window.partitionBy("factor").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    with_equity = returns.withColumn("equity", F.product(1 + F.col("return")).over(order))
    return with_equity.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(order)) - 1)


def _capped(value: Column) -> Column:
    return F.greatest(F.lit(-CAP), F.least(F.lit(CAP), value))


def _over(value: Column, by: Column) -> Column:
    return value / F.nullif(by, F.lit(0.0))


def metrics(returns: DataFrame, frequency: str = "M") -> DataFrame:
    p = PERIODS[frequency]
    last = F.max_by("equity", "period_end")
    sums = equity_curve(returns).groupBy("factor").agg(
        last.alias("total"), F.count("*").alias("n"), F.avg("return").alias("mean"), F.stddev_pop("return").alias("spread"), F.avg(F.pow(F.least("return", F.lit(0.0)), F.lit(2.0))).alias("down"),
        F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"), F.avg("turnover").alias("turnover"), F.avg((F.col("holdings_count") > 0).cast("double")).alias("coverage"),
    )
    years = F.greatest(F.col("n") / p, F.lit(1.0 / p))
    out = sums.withColumn("cagr", F.when(F.col("total") > 0, F.pow("total", 1 / years) - 1).otherwise(-1.0)).withColumn("annual_return", F.col("mean") * p)
    out = out.withColumn("volatility", F.col("spread") * math.sqrt(p)).withColumn("downside", F.sqrt("down") * math.sqrt(p))
    none = lambda x: F.when(F.col(x) <= 0, 0.0).otherwise(CAP)
    out = out.withColumns(
        {
            "sharpe": F.when(F.col("volatility") > 0, _over(F.col("annual_return"), F.col("volatility"))).otherwise(0.0),
            "sortino": F.when(F.col("downside") > 0, _capped(_over(F.col("annual_return"), F.col("downside")))).otherwise(none("annual_return")),
            "calmar": F.when(F.col("max_drawdown") < 0, _capped(_over(F.col("cagr"), F.abs("max_drawdown")))).otherwise(none("cagr")),
        }
    )
    return out.select("factor", *NAMES)


def holdout(returns: DataFrame, fraction: float = 0.25, min_periods: int = 6) -> DataFrame:
    """The most recent periods of each factor: so large a share, but ``min_periods`` of them at least."""
    if not 0 < fraction <= 1:
        raise ValueError("holdout fraction must be in (0, 1]")
    own = Window.partitionBy("factor")
    keep = F.greatest(F.lit(1), F.lit(min_periods), F.ceil(F.count("*").over(own) * fraction))
    return returns.withColumn("back", F.row_number().over(own.orderBy(F.desc("period_end")))).withColumn("keep", keep).where("back <= keep").drop("back", "keep")


def _normal(name: str) -> Column:
    every = Window.partitionBy()
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    value = F.abs(F.col(name)) if name == "max_drawdown" else F.col(name)
    finite = F.when(~bad(value), value)
    low, high = F.min(finite).over(every), F.max(finite).over(every)
    return F.when(finite.isNull(), 0.0).when(high > low, (finite - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)


def ranking(table: DataFrame) -> DataFrame:
    """``rank`` and ``composite_score`` of each factor: min-max normalised metrics by weight, risks inverted."""
    part = lambda n: 1 - _normal(n) if n in ("max_drawdown", "volatility") else _normal(n)
    scored = table.withColumn("composite_score", sum((w * part(n) for n, w in COMPOSITE.items()), F.lit(0.0)))
    key = [F.desc(F.coalesce(F.nanvl(c, F.lit(-math.inf)), F.lit(-math.inf))) for c in ("composite_score", "sharpe", "cagr", "max_drawdown")]
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*key, "factor"))).select("rank", "factor", *NAMES, "composite_score")


def with_scores(table: DataFrame, ranks: DataFrame) -> DataFrame:
    """Metrics with the composite score of ranked factors, 0 for the others, in ranking order."""
    return table.join(ranks.select("factor", "composite_score", "rank"), "factor", "left").select("factor", *NAMES, F.coalesce("composite_score", F.lit(0.0)).alias("composite_score"), "rank").orderBy(F.asc_nulls_last("rank"), "factor").drop("rank")


def winner_holdout(ranks: DataFrame, late: DataFrame) -> DataFrame:
    """The factor that ranks first with its rank and ratios in the holdout, null if it isn't ranked there."""
    there = late.select("factor", *(F.col(c).alias(f"holdout_{c}") for c in ("rank", "cagr", "sharpe")))
    return ranks.where("rank = 1").select("factor", "composite_score").join(there, "factor", "left")
