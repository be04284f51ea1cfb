"""Portfolio construction and backtests, one plan for all factors and periods.

Holdings of a period follow from its scores alone, so the only state, the previous target weights, is a
full outer join of the holdings with themselves one period on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.loaders import last_of
from . import kernels
from .scoring import signal_rows

# The asset types that count as stocks and the words that activity is read from.
STOCK_TYPES = ("stock", "equity", "common_stock", "common stock")
YES, NO = ("", "1", "true", "t", "yes", "y", "active"), ("0", "false", "f", "no", "n", "inactive")


@dataclass(frozen=True)
class Rules:
    top_n: int = 20
    weighting: str = "equal"
    min_market_cap: float = 0.0
    min_dollar_volume: float = 0.0
    adv_window: int = 63
    cost_bps: float = 0.0
    cost_model: str = "one_way_notional"

    def __post_init__(self) -> None:
        if self.weighting not in ("equal", "score"):
            raise ValueError("weighting must be 'equal' or 'score'")
        if self.cost_model not in ("one_way_notional", "portfolio_turnover"):
            raise ValueError("cost model must be 'one_way_notional' or 'portfolio_turnover'")


def parsed_active(column: str) -> Column:
    """Whether a universe row is active; unknown words count as yes."""
    said = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(said.isNull() | said.isin(*YES), True).when(said.isin(*NO), False).otherwise(True)


def is_stock() -> Column:
    return parsed_active("active") & F.coalesce(F.nullif(F.lower(F.trim("asset_type")), F.lit("")), F.lit("stock")).isin(*STOCK_TYPES)


def average_dollar_volume(prices: DataFrame, dates: list, window: int) -> DataFrame:
    """``ticker, signal_date, adv``: 0 where the history is shorter than the window."""
    w = max(1, window)
    adv = F.when(F.row_number().over(kernels.by_ticker()) >= w, F.avg(F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) * F.col("adj_close")).over(kernels.trailing(w))).otherwise(F.lit(0.0))
    return signal_rows(prices.select("ticker", "date", adv.alias("adv")), dates).select("ticker", "signal_date", "adv")


def judged(scores: DataFrame, universe: DataFrame, prices: DataFrame, dates: list, rules: Rules) -> DataFrame:
    """``scores`` with ``reject_reason``, '' for candidates: the first test that a row fails."""
    dim = universe.select("*", is_stock().alias("stock")).withColumn("market_cap", F.when(~F.isnan("market_cap"), F.col("market_cap")))
    dim = last_of(dim, ["ticker"], ["stock", "market_cap"])
    rows = scores.join(dim, "ticker", "left")
    why = F.when(~F.col("eligible"), F.col("skip_reason")).when(~F.coalesce("stock", F.lit(False)), "inactive_or_non_stock")
    if rules.min_market_cap > 0:
        why = why.when(F.col("market_cap").isNull(), "market_cap_unavailable").when(F.col("market_cap") < rules.min_market_cap, "market_cap_below_min")
    if rules.min_dollar_volume > 0:
        rows = rows.join(average_dollar_volume(prices, dates, rules.adv_window), ["ticker", "signal_date"], "left")
        why = why.when(F.coalesce("adv", F.lit(0.0)) < rules.min_dollar_volume, "insufficient_volume")
    return rows.withColumn("reject_reason", why.otherwise(""))


def selected(candidates: DataFrame, rules: Rules) -> DataFrame:
    """``factor, signal_date, ticker, score, weight`` of the top rows of each factor and date."""
    day = Window.partitionBy("factor", "signal_date")
    top = candidates.where("reject_reason = ''").withColumn("place", F.row_number().over(day.orderBy(F.desc("score"), "ticker"))).where(F.col("place") <= rules.top_n)
    k = F.count("*").over(day)
    weight = 1.0 / k
    if rules.weighting == "score":
        low, span = F.min("score").over(day), F.max("score").over(day) - F.min("score").over(day)
        top = top.withColumn("lifted", F.col("score") - low + span * 0.01).withColumn("span", span)
        weight = F.when(F.col("span") > 0, F.col("lifted") / F.nullif(F.sum("lifted").over(day), F.lit(0.0))).otherwise(1.0 / k)
    return top.select("factor", "signal_date", "ticker", "score", weight.alias("weight"))


def forward_returns(holdings: DataFrame, periods: DataFrame, prices: DataFrame) -> DataFrame:
    """Holdings with ``period``, their return over it, and why there is none: exact dates only."""
    at = last_of(prices, ["ticker", "date"], ["adj_close"]).withColumnRenamed("adj_close", "price")
    rows = holdings.join(periods, F.col("signal_date") == F.col("period_start"))
    rows = rows.join(at.select("ticker", F.col("date").alias("period_start"), F.col("price").alias("p0")), ["ticker", "period_start"], "left")
    rows = rows.join(at.select("ticker", F.col("date").alias("period_end"), F.col("price").alias("p1")), ["ticker", "period_end"], "left")
    ret = F.when(F.col("p0") > 0, F.col("p1") / F.col("p0") - 1)
    return rows.withColumn("ret", ret).withColumn("missing", F.when(ret.isNotNull(), "").when(F.col("p0").isNull(), "missing_rebalance_price").otherwise("missing_exit_price"))


def valid_holdings(returns: DataFrame) -> DataFrame:
    """Holdings of periods in which every name has a return."""
    period = Window.partitionBy("factor", "period")
    return returns.withColumn("bad", F.max((F.col("missing") != "").cast("int")).over(period)).where("bad = 0").drop("bad")


def turnover(holdings: DataFrame) -> DataFrame:
    """``factor, period, turnover, traded``: against the holdings of the period before, if it had any."""
    now = holdings.select("factor", "period", "ticker", F.col("weight").alias("w1"))
    old = holdings.select("factor", (F.col("period") + 1).alias("period"), "ticker", F.col("weight").alias("w0"))
    moved = now.join(old, ["factor", "period", "ticker"], "full_outer")
    traded = F.sum(F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0))))
    return moved.groupBy("factor", "period").agg(traded.alias("traded")).withColumn("turnover", 0.5 * F.col("traded"))


def backtest(scores: DataFrame, universe: DataFrame, prices: DataFrame, periods: DataFrame, dates: list, rules: Rules) -> dict[str, DataFrame]:
    """``holdings``, ``returns`` and ``skipped`` (skip_reason, count) of all factors over all periods."""
    rows = judged(scores, universe, prices, dates, rules)
    chosen = selected(rows, rules)
    priced = forward_returns(chosen, periods, prices)
    held = valid_holdings(priced)
    gross = held.groupBy("factor", "period").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), F.count("*").alias("holdings_count"))
    chosen_any = priced.groupBy("factor", "period").agg(F.count("*").alias("chosen"))
    grid = scores.select("factor").distinct().crossJoin(F.broadcast(periods))  # factors x calendar: the size of the result
    out = grid.join(gross, ["factor", "period"], "left").join(chosen_any, ["factor", "period"], "left").join(turnover(held), ["factor", "period"], "left")
    basis = F.coalesce("traded", F.lit(0.0)) if rules.cost_model == "one_way_notional" else F.coalesce("turnover", F.lit(0.0))
    reason = F.when(F.col("holdings_count") > 0, "").when(F.col("chosen") > 0, "invalid_period_missing_price").otherwise("empty_after_filters")
    returns = out.select(
        "factor", "period_start", "period_end", (F.coalesce("gross", F.lit(0.0)) - basis * (rules.cost_bps / 10000.0)).alias("return"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("holdings_count", F.lit(0)).cast("int").alias("holdings_count"), reason.alias("skip_reason")
    )
    short = rows.where("reject_reason = ''").groupBy("factor", "signal_date").count().where(F.col("count") < rules.top_n)
    inside = rows.join(F.broadcast(periods.select(F.col("period_start").alias("signal_date"))), "signal_date", "left_semi")
    events = inside.where("reject_reason <> ''").select(F.col("reject_reason").alias("skip_reason")).unionAll(priced.where("missing <> ''").select("missing")).unionAll(returns.where("skip_reason <> ''").select("skip_reason")).unionAll(short.select(F.lit("not_enough_assets")))
    holdings = held.select(F.col("signal_date").alias("rebalance_date"), "factor", "ticker", "weight", "score", F.col("signal_date").alias("price_date_used"))
    return {"holdings": holdings, "returns": returns, "skipped": events.groupBy("skip_reason").agg(F.count("*").alias("count"))}


def latest_holdings(holdings: DataFrame, factor: str) -> DataFrame:
    own = holdings.where(F.col("factor") == factor)
    return own.join(own.agg(F.max("rebalance_date").alias("rebalance_date")), "rebalance_date", "left_semi").orderBy(F.desc("weight"), "ticker")


def benchmark_returns(prices: DataFrame, ticker: str, label: str, periods: DataFrame, dates: list) -> DataFrame:
    """Close-to-close returns of the last benchmark prices on or before the ends of each period."""
    at = signal_rows(prices.where(F.col("ticker") == ticker).select("ticker", "date", "adj_close"), dates)
    start = at.select(F.col("signal_date").alias("period_start"), F.col("adj_close").alias("p0"), F.col("date").alias("price_date_start"))
    end = at.select(F.col("signal_date").alias("period_end"), F.col("adj_close").alias("p1"), F.col("date").alias("price_date_end"))
    rows = periods.join(start, "period_start").join(end, "period_end").where("p0 > 0 and p1 is not null and price_date_end > price_date_start")
    return rows.select(F.lit(label).alias("benchmark"), F.lit(ticker).alias("ticker"), "period_start", "period_end", (F.col("p1") / F.col("p0") - 1).alias("return"), "price_date_start", "price_date_end", F.lit("").alias("skip_reason"))
