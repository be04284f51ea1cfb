"""``python -m factorweave run|site``: exit code 0 for success, 2 and a message on stderr for an error, 1 without a command."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.registry import preset
from .operators.portfolio import Rules
from .plans import config, gates, pipeline, publish
from .sources import connectors, loaders, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factorweave", description="Rank factors and write their newest holdings.")
    commands = top.add_subparsers(dest="command")
    run = commands.add_parser("run", help="a backtest of factors")
    run.add_argument("--provider", choices=["csv", "yfinance", "yahoo_chart", "yfinance_yahoo_chart"], default="csv")
    for name in ("prices-file", "universe-file", "fundamentals-file", "universe-metadata-file", "transport", "bulk-transport"):
        run.add_argument(f"--{name}")
    run.add_argument("--output-dir", required=True)
    run.add_argument("--expected-data-end-date", type=dt.date.fromisoformat)
    run.add_argument("--rebalance", choices=["M", "W"], default="M")
    run.add_argument("--weighting", choices=["equal", "score"], default="equal")
    run.add_argument("--transaction-cost-model", choices=["one_way_notional", "portfolio_turnover"], default="one_way_notional")
    for name, value in (("top-n", 10), ("price-chunk-size", 100), ("min-price-tickers", 0), ("min-history-observations", 0), ("eligibility-adv-window", 63), ("min-factor-eligible-tickers", 0)):
        run.add_argument(f"--{name}", type=int, default=value)
    for name in ("min-market-cap", "min-dollar-volume", "transaction-cost-bps", "min-price-coverage-ratio", "min-latest-data-coverage-ratio"):
        run.add_argument(f"--{name}", type=float, default=0.0)
    run.add_argument("--market-cap-filter-attempted", action="store_true")
    run.add_argument("--filter-fallback-reason", default="")
    run.add_argument("--tickers", nargs="*", default=[])
    run.add_argument("--benchmark-tickers", nargs="*", default=[])
    run.add_argument("--period", default="5y")
    run.add_argument("--cache-dir")
    run.add_argument("--skip-factor-scores-csv", action="store_true")
    run.add_argument("--factor-preset", choices=["core", "zoo"], default="zoo")
    run.add_argument("--factors", nargs="+")
    site = commands.add_parser("site", help="the JSON of a dashboard from a run's folder")
    site.add_argument("--run-dir", required=True)
    site.add_argument("--output-file", required=True)
    site.add_argument("--data-scope", default="csv_run")
    return top


def _settings(args: argparse.Namespace, requested: int) -> config.RunConfig:
    if args.top_n <= 0:
        raise ValueError("--top-n must be positive")
    rules = Rules(args.top_n, args.weighting, args.min_market_cap, args.min_dollar_volume, args.eligibility_adv_window, args.transaction_cost_bps, args.transaction_cost_model)
    return config.RunConfig(
        frequency=args.rebalance, factors=tuple(args.factors or ()), preset=args.factor_preset, rules=rules, benchmarks=tuple(config.tickers(args.benchmark_tickers)), expected_end=args.expected_data_end_date, requested=requested,
        min_price_coverage=args.min_price_coverage_ratio, min_latest_coverage=args.min_latest_data_coverage_ratio, min_tickers=args.min_price_tickers, min_history=args.min_history_observations, min_eligible=args.min_factor_eligible_tickers,
        market_cap_attempted=args.market_cap_filter_attempted, fallback_reason=args.filter_fallback_reason,
    )


def _fetched(spark: SparkSession, args: argparse.Namespace, asked: list[str]) -> connectors.Fetched:
    until = args.expected_data_end_date
    chart = lambda names, period: connectors.chart_prices(spark, names, period, args.cache_dir, until, args.transport)

    def bulk(names: list[str], period: str) -> connectors.Fetched:
        if not args.bulk_transport:
            raise ValueError("--bulk-transport names no function (module:name) for bulk downloads")
        return connectors.bulk_prices(spark, names, connectors.named(args.bulk_transport), period, args.cache_dir, args.price_chunk_size, until)

    if args.provider == "yahoo_chart":
        return chart(asked, args.period)
    return bulk(asked, args.period) if args.provider == "yfinance" else connectors.resilient_prices(asked, bulk, chart, args.period, until)


def _run(args: argparse.Namespace) -> None:
    asked, benchmarks = config.tickers(args.tickers), config.tickers(args.benchmark_tickers)
    settings = _settings(args, len(asked))
    settings.names()  # unknown factors stop before anything is read
    if args.provider == "csv" and not args.prices_file:
        raise ValueError("--prices-file is required for csv")
    if args.provider != "csv":
        gates.no_overlap(asked, benchmarks)
        if not asked:
            raise ValueError(f"--tickers are required for {args.provider}")
    builder = SparkSession.builder.appName("factorweave").config("spark.sql.session.timeZone", "UTC")
    spark = builder.getOrCreate()
    bench, told = None, {"provider": args.provider, "cache_dir": args.cache_dir or ""}
    if args.provider == "csv":
        if not Path(args.prices_file).exists() and "://" not in args.prices_file:
            raise FileNotFoundError(f"no prices at {args.prices_file}")
        prices = loaders.adjusted(loaders.prices_csv(spark, args.prices_file))
        told |= {"source": f"csv:{args.prices_file}"}
    else:
        got = _fetched(spark, args, asked)
        prices = got.prices
        told |= got.metadata()
        if benchmarks:
            try:
                bench = _fetched(spark, args, benchmarks).prices
            except Exception as e:
                told |= {"benchmark_error": f"{type(e).__name__}: {e}"}
                bench = prices.limit(0)
    universe = loaders.universe_csv(spark, args.universe_file) if args.universe_file else None
    facts = loaders.fundamentals_csv(spark, args.fundamentals_file) if args.fundamentals_file else None
    tables = pipeline.run(spark, settings, prices, universe, facts, bench)
    files = [p for p in (args.prices_file, args.universe_file, args.fundamentals_file) if p and Path(p).is_file()]
    if files:
        told["source_hash"] = sinks.source_hash(files)
    if args.universe_file:
        told["universe_name"] = Path(args.universe_file).stem
    if args.universe_metadata_file:
        told |= {f"universe_build_{k}": v for k, v in json.loads(Path(args.universe_metadata_file).read_text()).items()}
    said = pipeline.metadata(tables, settings, told)
    chosen = {"factors": settings.names(), "factor_preset": "explicit" if args.factors else args.factor_preset, "requested_factor_preset": args.factor_preset, "factor_library": len(preset("zoo"))}
    publish.write_artifacts(tables, args.output_dir, said, {**vars(args), **chosen, "rules": asdict(settings.rules)}, scores=not args.skip_factor_scores_csv)


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    try:
        if args.command == "run":
            _run(args)
            return 0
        if args.command == "site":
            publish.write_site(args.run_dir, args.output_file, args.data_scope)
            return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    top.print_help()
    return 1


if __name__ == "__main__":
    sys.exit(main())
