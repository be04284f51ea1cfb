"""Gates of a run: each fails closed, with what was found and what was asked."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnostics


def no_overlap(stocks: list[str], benchmarks: list[str]) -> None:
    """Benchmarks are never stocks as well."""
    both = sorted(set(stocks) & set(benchmarks))
    diagnostics.gate(not both, f"benchmarks must not be stocks as well: {', '.join(both)}")


def parted(prices: DataFrame, benchmarks: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of stocks and those of benchmarks."""
    own = F.col("ticker").isin(benchmarks)
    return prices.where(~own), prices.where(own)


def current_benchmarks(prices: DataFrame, benchmarks: list[str], expected: dt.date | None) -> tuple[DataFrame, list[str]]:
    """The rows of benchmarks that reach the expected session, if one is expected, and the tickers of those that don't."""
    if expected is None or not benchmarks:
        return prices, []
    reach = prices.where(F.col("date") == F.lit(expected)).select("ticker").distinct()
    current = {r.ticker for r in reach.collect()}  # a few benchmarks
    diagnostics.gate(bool(current), f"no benchmark reaches {expected}")
    return prices.join(F.broadcast(reach), "ticker", "left_semi"), sorted(set(benchmarks) - current)


def enough_prices(found: int, requested: int, least: int, ratio: float) -> float:
    """The share of requested tickers that have prices."""
    share = found / requested if requested else 0.0
    diagnostics.gate(found >= least, f"{found} tickers have prices, fewer than {least} of {requested} requested")
    diagnostics.gate(share >= ratio, f"price coverage {share:.4f} is below {ratio:.4f}: {found} of {requested}")
    return share


def fresh(coverage, least: float, expected: dt.date | None) -> None:
    """Enough tickers share the newest date, and that is the expected session."""
    diagnostics.gate(coverage is not None and coverage.reference_date is not None, "no prices")
    diagnostics.gate(coverage.coverage_ratio >= least, f"coverage {coverage.coverage_ratio:.4f} of the newest date is below {least:.4f}")
    diagnostics.gate(expected is None or coverage.reference_date == expected, f"stale prices: {coverage.reference_date} instead of {expected}")


def enough_eligible(found: int, least: int) -> None:
    diagnostics.gate(found >= least, f"{found} stocks are eligible at the newest signal date, fewer than {least}")
