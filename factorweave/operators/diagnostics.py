"""Coverage, eligibility and portfolio diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import by_ticker
from .portfolio import average_dollar_volume, is_stock
from .scoring import signal_rows


def price_coverage(prices: DataFrame, min_ratio: float = 0.0) -> DataFrame:
    """One row: the newest date with enough tickers, how many it has, and the newest date of all."""
    by_date = prices.groupBy("date").agg(F.countDistinct("ticker").alias("n"))
    total = prices.agg(F.countDistinct("ticker").alias("tickers"))
    joined = by_date.crossJoin(F.broadcast(total))  # one row
    ok = F.col("n") >= F.ceil(F.col("tickers") * min(1.0, max(0.0, min_ratio)))
    found = joined.agg(F.max(F.when(ok, F.struct("date", "n"))).alias("ok"), F.max(F.struct("date", "n")).alias("last"), F.max("tickers").alias("tickers"))
    best = F.coalesce("ok", "last")
    return found.select(best["date"].alias("reference_date"), best["n"].alias("ticker_count"), (best["n"] / F.col("tickers")).alias("coverage_ratio"), F.col("last.date").alias("max_date"), F.col("last.n").alias("max_date_count"))


def eligibility(prices: DataFrame, universe: DataFrame, dates: list, min_history: int, min_dollar_volume: float, adv_window: int) -> DataFrame:
    """By signal date: active tickers with enough history, enough volume, and both."""
    active = universe.where(is_stock()).select("ticker").distinct()
    rows = signal_rows(prices.select("ticker", "date", F.row_number().over(by_ticker()).alias("n")), dates).join(active, "ticker", "left_semi")
    rows = rows.join(average_dollar_volume(prices, dates, adv_window), ["ticker", "signal_date"])
    old, liquid = F.col("n") >= min_history, (F.col("adv") >= min_dollar_volume) | F.lit(min_dollar_volume <= 0)
    return rows.groupBy("signal_date").agg(F.count_if(old).alias("history"), F.count_if(liquid).alias("liquid"), F.count_if(old & liquid).alias("eligible"))


def eligibility_summary(by_date: DataFrame) -> DataFrame:
    """One row from ``eligibility``: the least and the median number of eligible tickers, and the counts of the newest date."""
    last = lambda c: F.max_by(c, "signal_date").alias(f"latest_{c}")
    return by_date.agg(F.min("eligible").alias("min_eligible"), F.median("eligible").alias("median_eligible"), last("history"), last("liquid"), last("eligible"), F.max("signal_date").alias("signal_date"))


def factor_counts(returns: DataFrame) -> DataFrame:
    """One row: factors tested, and those that held anything in some period."""
    return returns.agg(F.countDistinct("factor").alias("tested"), F.countDistinct(F.when(F.col("holdings_count") > 0, F.col("factor"))).alias("effective"))


def universe_facts(universe: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: rows, rows of active stocks with prices, the newest date said, and the first three sources by name."""
    priced = prices.select("ticker").distinct().withColumn("priced", F.lit(True))
    rows = universe.join(priced, "ticker", "left").withColumn("stock", is_stock())
    said = F.coalesce(F.nullif(F.col("as_of_date").cast("string"), F.lit("")), F.lit("unknown")) if "as_of_date" in universe.columns else F.lit("unknown")
    source = F.nullif(F.col("source"), F.lit("")) if "source" in universe.columns else F.lit(None).cast("string")
    named = F.array_join(F.slice(F.array_sort(F.collect_set(source)), 1, 3), ",")
    return rows.agg(F.count("*").alias("tickers"), F.count_if(F.col("stock") & F.coalesce("priced", F.lit(False))).alias("rankable"), F.coalesce(F.max(said), F.lit("unknown")).alias("as_of"), F.coalesce(F.nullif(named, F.lit("")), F.lit("inferred_from_prices")).alias("name"))


def market_cap_filter(universe: DataFrame, minimum: float, attempted: bool = False) -> dict[str, str]:
    """What a filter by market value stands on, and whether it was applied."""
    if minimum > 0:
        known = "source" in universe.columns and not universe.where(F.lower("source").contains("yfinance")).isEmpty()
        return {"basis": "current_yfinance_metadata_screen_not_point_in_time" if known else "supplied_universe_metadata_screen_not_verified_point_in_time", "status": "applied_current_metadata_not_point_in_time"}
    if attempted:
        return {"basis": "not_applied", "status": "not_applied_metadata_insufficient; dashboard scope is current common-stock plus liquidity, not a large-cap screen"}
    finite = universe.agg(F.count_if(F.col("market_cap").isNotNull() & ~F.isnan("market_cap") & (F.abs("market_cap") < float("inf")))).first()[0]
    return {"basis": "not_applied", "status": f"not_requested; finite_market_cap_rows={finite}"}


def zero_coverage(table: DataFrame) -> DataFrame:
    """``skip_reason, count`` of the factors of a metrics table that never held anything."""
    return table.where("coverage <= 0").select(F.concat(F.lit("zero_coverage:"), "factor").alias("skip_reason"), F.lit(1).cast("bigint").alias("count"))


def concentration(holdings: DataFrame, adv: DataFrame, rates: tuple[float, float] = (0.05, 0.10)) -> DataFrame:
    """One row for each factor and date: weights, effective names, volume and capacity at two shares of volume.

    Weights count where they are positive, volumes where they are; the weighted volume takes others as 0.
    """
    rows = holdings.withColumn("signal_date", F.col("rebalance_date")).join(adv, ["ticker", "signal_date"], "left")
    weight, traded = F.when(F.col("weight") > 0, F.col("weight")), F.when(F.col("adv") > 0, F.col("adv"))
    room = lambda rate: rate * traded / weight
    place = F.row_number().over(Window.partitionBy("factor", "rebalance_date").orderBy(F.desc_nulls_last(weight), "ticker"))
    return rows.withColumn("place", place).groupBy("factor", "rebalance_date").agg(
        F.count("*").alias("names"), F.sum(weight).alias("weight_sum"), F.min(weight).alias("weight_min"), F.max(weight).alias("weight_max"), F.sum(F.when(F.col("place") <= 5, weight)).alias("weight_top5"),
        (1 / F.sum(weight * weight)).alias("effective_names"), F.min(traded).alias("adv_min"), F.min(F.when(traded.isNotNull(), F.struct(traded, "ticker")))["ticker"].alias("adv_min_ticker"), F.median(traded).alias("adv_median"),
        F.sum(F.coalesce("weight", F.lit(0.0)) * F.coalesce("adv", F.lit(0.0))).alias("adv_weighted"), F.min(room(rates[0])).alias("capacity_low"), F.min(room(rates[1])).alias("capacity"),
        F.min(F.when(room(rates[1]).isNotNull(), F.struct(room(rates[1]), "ticker")))["ticker"].alias("tightest"),
    )


def turnover_stats(returns: DataFrame) -> DataFrame:
    return returns.groupBy("factor").agg(F.count("*").alias("periods"), F.count_if(F.col("holdings_count") > 0).alias("invested"), F.avg("turnover").alias("mean_turnover"), F.max_by("turnover", "period_end").alias("latest_turnover"))


def gate(ok: bool, message: str) -> None:
    """Fail closed."""
    if not ok or isinstance(ok, float) and math.isnan(ok):
        raise ValueError(message)
