"""A whole run: prices to ranked factors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import calendar, diagnostics, metrics, portfolio, scoring
from ..sources import loaders, sinks
from . import gates
from .config import RunConfig, tickers
from .store import kept

__all__ = ["RunConfig", "metadata", "run", "write_run"]

# How benchmarks are called.
LABELS = {"^IXIC": "Nasdaq Composite", "ONEQ": "Nasdaq Composite ETF proxy", "^NDX": "Nasdaq-100", "QQQ": "Nasdaq-100 ETF proxy"}


def benchmark_label(ticker: str) -> str:
    return LABELS.get(ticker.upper(), ticker.upper())


def run(spark: SparkSession, config: RunConfig, prices: DataFrame, universe: DataFrame | None = None, fundamentals: DataFrame | None = None, benchmark_prices: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables of a run, by name. Gates fail closed.

    Benchmarks come from ``benchmark_prices`` or out of ``prices``; they are never scored. Panel, scores, holdings
    and period returns are computed once and kept in the shared folder; all further tables are read from those.
    """
    names, benchmarks = config.names(), tickers(config.benchmarks)
    stocks, inside = gates.parted(prices, benchmarks)
    reference = inside if benchmark_prices is None else benchmark_prices
    if config.expected_end:
        stocks, reference = (df.where(F.col("date") <= F.lit(config.expected_end)) for df in (stocks, reference))
    reference, stale = gates.current_benchmarks(reference, benchmarks, config.expected_end)
    stocks = kept(stocks, "prices")
    found = stocks.select("ticker").distinct().count()
    diagnostics.gate(found > 0, "no prices")
    share = gates.enough_prices(found, max(config.requested, found), config.min_tickers, config.min_price_coverage)
    coverage = diagnostics.price_coverage(stocks, config.min_latest_coverage).first()
    gates.fresh(coverage, config.min_latest_coverage, config.expected_end)
    last = F.lit(coverage.reference_date)
    stocks, reference = stocks.where(F.col("date") <= last), reference.where(F.col("date") <= last)
    universe = loaders.inferred_universe(stocks) if universe is None else universe

    schedule = calendar.rebalance_dates(stocks, config.frequency)
    dates = sorted(r.date for r in schedule.collect())
    diagnostics.gate(len(dates) >= 2, "insufficient_history: fewer than two rebalance dates")
    schedule = spark.createDataFrame([(d,) for d in dates], "date date")
    periods = calendar.signal_periods(schedule)
    by_date = diagnostics.eligibility(stocks, universe, dates[:-1], config.min_history, config.rules.min_dollar_volume, config.rules.adv_window)
    by_date = kept(by_date, "eligibility")
    summary = diagnostics.eligibility_summary(by_date)
    gates.enough_eligible(int(summary.first().latest_eligible or 0), config.min_eligible)

    scores = kept(scoring.factor_scores(stocks, dates[:-1], names, fundamentals, lambda df: kept(df, "base_scores")), "scores")
    tested = portfolio.backtest(scores, universe, stocks, periods, dates, config.rules)
    returns, holdings = kept(tested["returns"], "returns"), kept(tested["holdings"], "holdings")
    table = kept(metrics.metrics(returns, config.frequency), "metrics")
    ranks = kept(metrics.ranking(table.where("coverage > 0")), "ranking")
    best = ranks.where("rank = 1").first()
    diagnostics.gate(best is not None, "no factor held anything after the filters")
    late = metrics.metrics(metrics.holdout(returns, config.holdout_fraction, config.holdout_periods), config.frequency)
    late_ranks = metrics.ranking(late.where("coverage > 0"))
    skipped = tested["skipped"].unionByName(diagnostics.zero_coverage(table))
    latest = portfolio.latest_holdings(holdings, best.factor)
    adv = portfolio.average_dollar_volume(stocks, dates, config.rules.adv_window)
    bench = None
    for ticker in benchmarks:
        own = portfolio.benchmark_returns(reference, ticker, benchmark_label(ticker), periods, dates)
        bench = own if bench is None else bench.unionByName(own)
    out = {
        "prices": stocks, "universe": universe, "scores": scores, "returns": returns, "holdings": holdings, "latest_holdings": latest, "skipped": skipped, "metrics": metrics.with_scores(table, ranks), "ranking": ranks,
        "holdout_metrics": metrics.with_scores(late, late_ranks), "holdout_ranking": late_ranks, "eligibility": by_date, "eligibility_summary": summary, "concentration": diagnostics.concentration(latest, adv),
        "turnover": diagnostics.turnover_stats(returns).where(F.col("factor") == best.factor), "factor_counts": diagnostics.factor_counts(returns), "universe_facts": diagnostics.universe_facts(universe, stocks),
        "coverage": spark.createDataFrame([(found, max(config.requested, found), share, ",".join(stale))], "priced int, requested int, ratio double, stale_benchmarks string").crossJoin(spark.createDataFrame([coverage])),
    }
    return out | ({"benchmark_returns": bench} if bench is not None else {})


def metadata(tables: dict[str, DataFrame], config: RunConfig, provider: dict | None = None, at: dt.datetime | None = None) -> dict:
    """What a run says of itself: provider, coverage, universe, gates, factors and the newest portfolio."""
    one = lambda name: row.asDict() if (row := tables[name].first()) else {}
    covered, facts, counts, eligible = one("coverage"), one("universe_facts"), one("factor_counts"), one("eligibility_summary")
    narrow, moved, best = one("concentration"), one("turnover"), one("ranking")
    late = tables["holdout_ranking"].where(F.col("factor") == best.get("factor")).first()
    span = tables["prices"].agg(F.min("date"), F.max("date")).first()
    names, benchmarks = config.names(), tickers(config.benchmarks)
    catalog = [r.asDict(True) for r in registry.catalog(tables["prices"].sparkSession).where(F.col("factor").isin(names)).collect()]
    now = (at or dt.datetime.now(dt.UTC)).isoformat(timespec="seconds")
    named = lambda prefix, row, keys: {f"{prefix}{k}": row.get(k) for k in keys}
    return {
        "provider": "csv", "fetched_at": now,
        "universe_as_of_date": facts.get("as_of"), "universe_name": facts.get("name"), "universe_ticker_count": facts.get("tickers"), "rankable_stock_universe_count": facts.get("rankable"),
        "price_ticker_count": covered.get("priced"), "requested_ticker_count": covered.get("requested"), "price_coverage_ratio": covered.get("ratio"),
        "latest_data_reference_date": covered.get("reference_date"), "latest_data_ticker_count": covered.get("ticker_count"), "latest_data_coverage_ratio": covered.get("coverage_ratio"),
        "latest_data_max_date": covered.get("max_date"), "latest_data_max_date_ticker_count": covered.get("max_date_count"), "data_start_date": span[0], "data_end_date": span[1], "expected_data_end_date": config.expected_end,
        "latest_factor_eligible_ticker_count": eligible.get("latest_eligible"), "history_qualified_ticker_count": eligible.get("latest_history"), "liquidity_qualified_ticker_count": eligible.get("latest_liquid"),
        "factor_eligibility_signal_date": eligible.get("signal_date"), "rebalance_eligible_min_count": eligible.get("min_eligible"), "rebalance_eligible_median_count": eligible.get("median_eligible"),
        "min_price_tickers": config.min_tickers, "min_price_coverage_ratio": config.min_price_coverage, "min_latest_data_coverage_ratio": config.min_latest_coverage, "min_factor_eligible_tickers": config.min_eligible,
        **{f"market_cap_filter_{k}": v for k, v in diagnostics.market_cap_filter(tables["universe"], config.rules.min_market_cap, config.market_cap_attempted).items()},
        "market_cap_filter_attempted": config.market_cap_attempted or config.rules.min_market_cap > 0, "market_cap_filter_effective": config.rules.min_market_cap > 0, "filter_fallback_reason": config.fallback_reason or "none",
        "transaction_cost_bps": config.rules.cost_bps, "transaction_cost_model": config.rules.cost_model, "rebalance_frequency": config.frequency,
        "tested_factor_count": counts.get("tested"), "effective_factor_count": counts.get("effective"), "selected_factor_count": len(names), "factor_library_size": len(registry.REGISTRY), "factor_preset": "explicit" if config.factors else config.preset,
        "factor_catalog": catalog, "factor_family_summary": [r.asDict(True) for r in registry.family_summary(registry.catalog(tables["prices"].sparkSession).where(F.col("factor").isin(names))).collect()],
        **named("latest_portfolio_", narrow, ("names", "weight_sum", "weight_min", "weight_max", "weight_top5", "effective_names", "adv_min", "adv_min_ticker", "adv_median", "adv_weighted", "capacity_low", "capacity", "tightest")),
        **named("latest_portfolio_", moved, ("periods", "invested", "mean_turnover", "latest_turnover")),
        "benchmark_tickers": benchmarks, "benchmark_label": benchmark_label(benchmarks[0]) if benchmarks else None, "benchmark_stale_tickers": [t for t in (covered.get("stale_benchmarks") or "").split(",") if t],
        "benchmark_return_count": tables["benchmark_returns"].count() if "benchmark_returns" in tables else 0,
        "holdout_validation": {"method": "recent_tail_by_factor", "holdout_fraction": config.holdout_fraction, "min_periods": config.holdout_periods} | {f"best_factor_holdout_{k}": late[k] if late else None for k in ("rank", "cagr", "sharpe")},
        **(provider or {}),
    }


#: Tables whose rows are bounded by factors and periods: single files. Others grow with the input: folders of parts.
SMALL = ("returns", "latest_holdings", "benchmark_returns", "skipped", "metrics", "ranking", "holdout_metrics", "holdout_ranking", "eligibility", "coverage")


def write_run(tables: dict[str, DataFrame], folder: str) -> None:
    """Small tables as single CSV files, written by the driver; prices, scores and holdings as folders, written by the executors."""
    for name, df in tables.items():
        if name in SMALL:
            sinks.write_csv(df, f"{folder}/{name}.csv")
        else:
            sinks.write_parts(df, f"{folder}/{name}")
