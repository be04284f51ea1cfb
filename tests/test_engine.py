import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from factorweave.functions import registry
from factorweave.operators import calendar, diagnostics, kernels, metrics, portfolio, scoring
from factorweave.plans import pipeline, publish
from factorweave.sources import loaders, sinks, symbols


def day(text):
    return dt.date.fromisoformat(text)


def prices(spark, rows):
    """(ticker, date, price) rows with flat bars."""
    return spark.createDataFrame([(t, day(d), p, p, p, p, p, 1000) for t, d, p in rows], "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint")


def scores(spark, rows):
    return spark.createDataFrame([(f, t, day(d), s, s is not None, "" if s is not None else "insufficient_history") for f, t, d, s in rows], "factor string, ticker string, signal_date date, score double, eligible boolean, skip_reason string")


def universe(spark, tickers, active="true", cap=1e9):
    return spark.createDataFrame([(t, "stock", active, cap) for t in tickers], "ticker string, asset_type string, active string, market_cap double")


def run(spark, price_rows, score_rows, dates, **rules):
    table = prices(spark, price_rows)
    schedule = spark.createDataFrame([(day(d),) for d in dates], "date date")
    uni = universe(spark, {r[0] for r in price_rows})
    return portfolio.backtest(scores(spark, score_rows), uni, table, calendar.signal_periods(schedule), [day(d) for d in dates], portfolio.Rules(**rules))


def test_registry():
    names = registry.preset("zoo")
    assert len(names) == len(set(names)) == 318 and len(registry.preset("core")) == 9
    assert registry.category_counts(names) == {"accumulation": 5, "composite": 11, "distribution": 10, "growth": 1, "intraday": 10, "liquidity": 23, "momentum": 90, "quality": 3, "reversal": 7, "risk": 38, "risk_adjusted_momentum": 64, "tail": 5, "trend": 37, "trend_quality": 10, "value": 4}
    assert registry.with_parts(["composite_defensive"]) == ["momentum_6m", "low_volatility", "liquidity", "composite_defensive"]
    with pytest.raises(ValueError):
        registry.validated(["nope"])


def test_calendar(spark):
    table = prices(spark, [("A", d, 1.0) for d in ("2024-01-30", "2024-01-31", "2024-02-28", "2024-02-29", "2024-03-01")])
    assert sorted(r.date for r in calendar.rebalance_dates(table).collect()) == [day("2024-01-31"), day("2024-02-29"), day("2024-03-01")]


def test_forward_return_and_missing_exit(spark):
    found = run(spark, [("AAA", "2024-01-31", 100.0), ("AAA", "2024-02-29", 110.0), ("BBB", "2024-01-31", 100.0), ("BBB", "2024-02-29", 90.0)], [("f", "AAA", "2024-01-31", 2.0), ("f", "BBB", "2024-01-31", 1.0)], ["2024-01-31", "2024-02-29"], top_n=1)
    assert math.isclose(found["returns"].first()["return"], 0.10)
    found = run(spark, [("AAA", "2024-01-31", 100.0), ("AAA", "2024-02-29", 110.0), ("BBB", "2024-01-31", 100.0)], [("f", "AAA", "2024-01-31", 2.0), ("f", "BBB", "2024-01-31", 1.0)], ["2024-01-31", "2024-02-29"], top_n=2)
    row = found["returns"].first()
    assert row.skip_reason == "invalid_period_missing_price" and row.holdings_count == 0 and found["holdings"].count() == 0
    assert {r.skip_reason: r["count"] for r in found["skipped"].collect()} == {"missing_exit_price": 1, "invalid_period_missing_price": 1}


def test_cost_models(spark):
    rows = [("AAA", "2024-01-31", 100.0), ("AAA", "2024-02-29", 110.0), ("AAA", "2024-03-29", 110.0), ("BBB", "2024-01-31", 100.0), ("BBB", "2024-02-29", 100.0), ("BBB", "2024-03-29", 110.0)]
    chosen = [("f", "AAA", "2024-01-31", 2.0), ("f", "BBB", "2024-01-31", 1.0), ("f", "AAA", "2024-02-29", 1.0), ("f", "BBB", "2024-02-29", 2.0)]
    out = run(spark, rows, chosen, ["2024-01-31", "2024-02-29", "2024-03-29"], top_n=1, cost_bps=100.0)["returns"].orderBy("period_start").collect()
    assert [round(r["return"], 10) for r in out] == [0.09, 0.08] and [r.turnover for r in out] == [0.5, 1.0]
    out = run(spark, rows[:2] + rows[3:5], chosen[:2], ["2024-01-31", "2024-02-29"], top_n=1, cost_bps=100.0, cost_model="portfolio_turnover")["returns"].first()
    assert round(out["return"], 10) == 0.095


def test_score_weights_and_filters(spark):
    rows = [(t, d, 100.0) for t in "ABC" for d in ("2024-01-31", "2024-02-29")]
    found = run(spark, rows, [("f", t, "2024-01-31", s) for t, s in zip("ABC", (3.0, 2.0, 1.0), strict=True)], ["2024-01-31", "2024-02-29"], top_n=5, weighting="score")
    weights = [r.weight for r in found["holdings"].collect()]
    assert all(w > 0 for w in weights) and math.isclose(sum(weights), 1)
    assert {r.skip_reason for r in found["skipped"].collect()} == {"not_enough_assets"}
    found = run(spark, rows, [("f", "A", "2024-01-31", 1.0)], ["2024-01-31", "2024-02-29"], min_dollar_volume=1.0, adv_window=5)
    assert {r.skip_reason for r in found["skipped"].collect()} == {"insufficient_volume", "empty_after_filters"}
    with pytest.raises(ValueError):
        portfolio.Rules(weighting="cap")


def test_zoo_scores_on_trend(spark):
    start = day("2020-01-01")
    bars = []
    for k in range(2):
        for i in range(800):
            c = 80 + 25 * k + (0.07 + 0.03 * k) * i + ((i % 17) - 8) * (0.08 + 0.03 * k)
            bars.append((f"T{k}", start + dt.timedelta(i), c * 0.995, c * 1.012, c * 0.988, c, c, 1_000_000 + 300_000 * k + (i % 13) * 10_000))
    table = spark.createDataFrame(bars, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint")
    names = ["mom_126d_skip_21d", "reversal_21d", "vol_total_63d", "vol_range_63d", "skew_63d", "kurtosis_low_63d", "tail_loss_63d", "trend_efficiency_63d", "return_consistency_63d", "ramom_126d_skip_21d_vol_63d", "dvol_avg_63d", "amihud_illiq_63d", "dvol_trend_21d_63d", "dvol_shock_21d_63d", "price_volume_corr_63d", "ma_gap_50d", "ma_cross_20d_100d", "range_pos_63d", "breakout_63d", "range_contraction_21d_63d", "overnight_return_21d", "intraday_return_21d", "accel_21d_126d_skip_0d", "blend_mom126_lowvol63_liq63"]
    out = scoring.factor_scores(table, [start + dt.timedelta(799)], names).collect()
    assert len(out) == 2 * len(names) and all(r.eligible and math.isfinite(r.score) and r["rank"] in (1, 2) for r in out)
    never = scoring.factor_scores(table, [start + dt.timedelta(799)], ["accel_21d_63d_skip_21d", "value_pe"]).collect()
    assert {(r.factor, r.skip_reason) for r in never} == {("accel_21d_63d_skip_21d", "insufficient_history"), ("value_pe", "missing_fundamentals")}


def test_constant_series_and_stale_ticker(spark):
    flat = prices(spark, [("A", f"2024-01-{d:02}", 5.0) for d in range(1, 31)])
    one = lambda kind, **p: scoring.base_scores(flat, [day("2024-06-01")], [registry.Factor("k", kind, "t", p)]).first()
    assert one("momentum", lookback=5, skip=0).score == 0.0  # rows before the signal stand until then
    assert one("return_skew", window=5).skip_reason == kernels.IH and one("price_volume_corr", window=5).skip_reason == kernels.IH
    assert one("range_position", window=5).skip_reason == kernels.IH and one("trend_efficiency", window=5).score == 0.0
    assert one("no such kind").skip_reason == kernels.ERROR


def test_fundamentals_are_point_in_time(spark):
    table = prices(spark, [("A", "2024-01-31", 1.0), ("A", "2024-02-29", 1.0)])
    facts = spark.createDataFrame([("A", day("2023-12-31"), day("2024-02-15"), 10.0), ("A", day("2024-12-31"), None, 99.0)], "ticker string, as_of_date date, available_at date, pe_ratio double")
    out = {r.signal_date: (r.eligible, r.score) for r in scoring.factor_scores(table, [day("2024-01-31"), day("2024-02-29")], ["value_pe"], facts).collect()}
    assert out == {day("2024-01-31"): (False, None), day("2024-02-29"): (True, -10.0)}


def returns(spark, values, factor="f", holdings=1):
    rows = [(factor, day("2024-01-01") + dt.timedelta(30 * i), day("2024-01-01") + dt.timedelta(30 * i + 30), r, 0.5, h) for i, (r, h) in enumerate(zip(values, holdings if isinstance(holdings, list) else [holdings] * len(values), strict=True))]
    return spark.createDataFrame(rows, "factor string, period_start date, period_end date, return double, turnover double, holdings_count int")


def test_metrics(spark):
    row = metrics.metrics(returns(spark, [0.5, -0.25], holdings=[1, 0])).first()
    assert math.isclose(row.max_drawdown, -0.25) and row.coverage == 0.5 and math.isclose(row.calmar, min(999, row.cagr / 0.25))
    assert math.isclose(metrics.metrics(returns(spark, [-0.1, 0.2])).first().max_drawdown, -0.1)
    up = metrics.metrics(returns(spark, [0.1, 0.1])).first()
    assert up.sortino == up.calmar == 999 and up.sharpe == 0
    assert metrics.metrics(returns(spark, [-1.5, 0.2])).first().cagr == -1
    late = metrics.metrics(metrics.holdout(returns(spark, [0.1, 0.1, -0.1, -0.1]), 0.5, 1)).first()
    assert late.annual_return < 0
    with pytest.raises(ValueError):
        metrics.holdout(returns(spark, [0.1]), 0)
    tied = metrics.metrics(returns(spark, [0.1], "z").union(returns(spark, [0.1], "a")))
    assert [r.factor for r in metrics.ranking(tied).orderBy("rank").collect()] == ["a", "z"]


def test_coverage(spark):
    table = prices(spark, [("A", "2024-06-12", 1.0), ("B", "2024-06-12", 1.0), ("C", "2024-06-12", 1.0), ("A", "2024-06-15", 1.0)])
    row = diagnostics.price_coverage(table, 0.9).first()
    assert (row.reference_date, row.ticker_count, row.max_date, row.max_date_count) == (day("2024-06-12"), 3, day("2024-06-15"), 1)


def test_loaders(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ticker,date,open,high,low,close,adj_close,volume\n aaa ,2024-01-02T00,102,110,90,100,50,10.9\nBBB,2024-01-02,x,,,7,,\n,2024-01-02,1,1,1,1,1,1\nCCC,2024-01-02,1,1,1,x,nan,1\n")
    rows = {r.ticker: r for r in loaders.prices_csv(spark, str(tmp_path / "p.csv")).collect()}
    assert set(rows) == {"AAA", "BBB"} and rows["AAA"].volume == 10 and rows["BBB"].adj_close == rows["BBB"].open == 7
    fixed = {r.ticker: r for r in loaders.adjusted(loaders.prices_csv(spark, str(tmp_path / "p.csv"))).collect()}["AAA"]
    assert (fixed.open, fixed.high, fixed.low, fixed.close) == (51, 55, 45, 50)
    (tmp_path / "u.csv").write_text("ticker,active,market_cap\naaa,,5e9\nbbb,no,\nccc,maybe,x\n")
    assert {r.ticker: (r.active, r.market_cap, r.exchange) for r in loaders.universe_csv(spark, str(tmp_path / "u.csv")).collect()} == {"AAA": (True, 5e9, "UNKNOWN"), "BBB": (False, None, "UNKNOWN"), "CCC": (False, None, "UNKNOWN")}
    payload = '{"chart":{"result":[{"timestamp":[1704153600,1704240000,null],"indicators":{"quote":[{"open":[1,null,1],"high":[2,3,1],"low":[1,1,1],"close":[1.5,2,1],"volume":[10,-4,1]}],"adjclose":[{"adjclose":[1.4,null,1]}]}}]}}'
    out = loaders.chart_json(spark.createDataFrame([("aa", payload), ("bb", "{}"), ("cc", None)], "ticker string, payload string")).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.open, r.adj_close, r.volume) for r in out] == [("AA", "2024-01-02", 1.0, 1.4, 10), ("AA", "2024-01-03", 2.0, 2.0, 0)]


def test_symbols(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Symbol|Security Name|Test Issue|Financial Status|ETF|NextShares\nAAPL|Apple Inc. - Common Stock|N|N|N|N\nQQQ|Trust Common Stock|N|N|Y|N\nBAD|Bad Common Stock|N|D|N|N\nADRX|Foo American Depositary|N|N|N|N\nFile Creation Time: 0101202400:00|||||\n")
    rows = symbols.read_directory(spark, str(tmp_path / "d.txt")).select("symbol", symbols.exclusion_reason(("SPY",)).alias("why")).collect()
    assert {r.symbol: r.why for r in rows} == {"AAPL": "", "QQQ": "etf", "BAD": "non_normal_financial_status", "ADRX": "adr_ads"}


def test_export_and_run(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("=1+1", 1 / 3, None, True)], "a string, b double, c int, d boolean"), tmp_path / "x.csv")
    assert (tmp_path / "x.csv").read_text().splitlines()[1] == "'=1+1,0.3333333333,,true"
    table = prices(spark, [(t, str(day("2023-01-31") + dt.timedelta(31 * i))[:10], 100.0 + (k + 1) * i) for k, t in enumerate("ABC") for i in range(40)])
    found = pipeline.run(spark, pipeline.RunConfig(factors=("reversal_3d", "reversal_5d"), rules=portfolio.Rules(top_n=2)), table, universe(spark, list("ABC")))
    assert found["ranking"].count() == 2 and found["returns"].count() == 2 * (found["returns"].select("period_start").distinct().count())
    with pytest.raises(ValueError):
        pipeline.run(spark, pipeline.RunConfig(min_tickers=10), table, universe(spark, list("ABC")))
    assert sinks.source_hash([tmp_path / "x.csv"]) and table.select(sinks.safe_text("ticker").alias("t")).where(F.col("t") == "A").count() == 40


def test_publish(spark, tmp_path):
    table = prices(spark, [(t, str(day("2023-01-31") + dt.timedelta(31 * i))[:10], 100.0 + (k + 1) * i) for k, t in enumerate("ABC") for i in range(40)])
    found = pipeline.run(spark, pipeline.RunConfig(factors=("reversal_3d", "reversal_5d"), rules=portfolio.Rules(top_n=2)), table, universe(spark, list("ABC")))
    meta = {"provider": "csv", "source": "csv:/secret/path", "price_coverage_ratio": 0.5, "caveats": ["<b>"]}
    publish.write_artifacts(found, tmp_path / "run", meta, {"top_n": 2}, table)
    payload = publish.write_site(tmp_path / "run", tmp_path / "site" / "latest.json", generated_at="now")
    assert payload["summary"]["ranking_count"] == 2 and payload["summary"]["best_factor"] == payload["rankings"][0]["factor"] and payload["rankings"][0]["rank"] == 1
    assert len(payload["latest_holdings"]) == 2 and payload["metadata"]["source_kind"] == "csv" and "source" not in payload["metadata"]
    assert payload["factor_period_returns"] and isinstance(payload["factor_period_returns"][0]["return"], float) and payload["benchmark_returns"] == []
    short = publish.public_summary(payload)
    assert short["status"] == {"state": "degraded", "degradedReasons": ["price coverage below 90%"]} and len(short["primaryEntities"]) == 2
    assert (tmp_path / "site" / "summary.json").exists() and "<meter" in (tmp_path / "run" / "report.html").read_text() and (tmp_path / "run" / "report.md").read_text()
    assert spark.read.option("header", True).csv(str(tmp_path / "run" / "prices_snapshot")).count() == table.count()
    (tmp_path / "run" / "factor_metrics.csv").unlink()
    with pytest.raises(FileNotFoundError):
        publish.site_payload(tmp_path / "run")
    assert publish.number("nan") is None and publish.number(" 3.9 ", True) == 3 and publish.source_kind({"source": "yahoo_chart:x"}) == "yahoo_chart"
