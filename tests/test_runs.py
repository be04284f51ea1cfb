import datetime as dt
import json
import math

import fake_provider
import pytest
from pyspark.sql import functions as F

from factorweave import __main__ as command
from factorweave.operators import comparison, diagnostics, portfolio
from factorweave.plans import config, gates, pipeline, store
from factorweave.sources import connectors, loaders, sinks, symbols

SESSION = fake_provider.SESSION
NOW = dt.datetime(2024, 6, 14, 23, 0, tzinfo=dt.UTC)


def day(text):
    return dt.date.fromisoformat(text)


def returns(spark, rows):
    return spark.createDataFrame([(f, day(a), day(b), r) for f, a, b, r in rows], "factor string, period_start date, period_end date, return double")


def test_adjusted_bars(spark):
    nan = float("nan")
    rows = [("scaled", 102.0, 110.0, 90.0, 100.0, 50.0), ("span", 100.0, 95.0, 90.0, 92.0, 92.0), ("zero", 10.0, 12.0, 9.0, 0.0, 11.0), ("holes", None, None, None, 10.0, 5.0), ("turned", 10.0, 8.0, 9.0, 10.0, 10.0), ("none", 1.0, 2.0, 0.5, 1.5, nan), ("low", 10.0, None, None, 8.0, 8.0), ("minus", 1.0, 2.0, 0.5, 1.0, -1.0)]
    got = {r.ticker: (r.open, r.high, r.low, r.close) for r in loaders.adjusted(spark.createDataFrame(rows, "ticker string, open double, high double, low double, close double, adj_close double")).collect()}
    assert got == {
        "scaled": (51, 55, 45, 50), "span": (100, 95, 90, 92), "zero": (10, 12, 9, 11), "holes": (5, 5, 5, 5), "turned": (10, 9, 8, 10), "none": (1, 2, 0.5, 1.5), "low": (10, 10, 8, 8), "minus": (1, 2, 0.5, -1),
    }


def test_last_duplicate_wins(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ticker,date,close\nA,2024-01-01,9\nA,2024-01-01,5\nA,2024-02-01,7\n")
    (tmp_path / "u.csv").write_text("ticker,asset_type,market_cap\nA,stock,9\nA,fund,1\n")
    prices = loaders.prices_csv(spark, str(tmp_path / "p.csv"))
    periods = spark.createDataFrame([(0, day("2024-01-01"), day("2024-02-01"))], "period int, period_start date, period_end date")
    held = spark.createDataFrame([("f", day("2024-01-01"), "A", 1.0, 1.0)], "factor string, signal_date date, ticker string, score double, weight double")
    assert math.isclose(portfolio.forward_returns(held, periods, prices).first().ret, 0.4)
    scores = spark.createDataFrame([("f", "A", day("2024-01-01"), 1.0, True, "")], "factor string, ticker string, signal_date date, score double, eligible boolean, skip_reason string")
    assert portfolio.judged(scores, loaders.universe_csv(spark, str(tmp_path / "u.csv")), prices, [day("2024-01-01")], portfolio.Rules()).first().reject_reason == "inactive_or_non_stock"


def test_comparison_points_slices_and_ratios(spark):
    months = [f"202{2 + i // 12}-{i % 12 + 1:02d}-28" for i in range(16)]
    table = returns(spark, [("up", a, b, 0.01) for a, b in zip(months, months[1:], strict=False)] + [("one", "2023-01-28", "2023-02-28", -0.1), ("twice", "2023-01-28", "2023-02-28", 0.1), ("twice", "2023-01-30", "2023-02-28", 0.1)])
    points = comparison.points(table)
    assert [(str(r.date), round(r.equity, 6)) for r in points.where("factor = 'twice'").orderBy("date").collect()] == [("2023-01-28", 1.0), ("2023-02-28", 1.21)]
    rows = {(r.factor, r.slice): r for r in comparison.comparison(table).collect()}
    assert (rows["up", "all"].n, rows["up", "1y"].n, rows["up", "3y"].n, rows["up", "ytd"].n) == (15, 12, 15, 4)
    up, one = rows["up", "all"], rows["one", "all"]
    assert up.calmar == 999 and up.sortino == 999 and math.isclose(up.cumulative, 1.01**15 - 1) and math.isclose(up.cagr, 1.01**12 - 1)
    assert one.sharpe is None and math.isclose(one.max_drawdown, -0.1) and math.isclose(one.calmar, one.cagr / 0.1) and math.isclose(one.sortino, -math.sqrt(12))
    assert comparison.nearest_date(points, day("2022-02-12")).first().date == day("2022-01-28")
    assert comparison.nearest_date(points).first().date == day("2023-04-28")
    assert comparison.at_date(points.where("factor = 'one'"), day("2023-02-27")).isEmpty()
    ranks = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "ab", 2.0), (4, "c", 2.0)], "rank int, factor string, sharpe double")
    assert [r.factor for r in comparison.sorted_by(ranks, "sharpe").orderBy("place").collect()] == ["ab", "c", "a", "b"]
    assert [r.factor for r in comparison.sorted_by(ranks, "sharpe", "B", ["a"], 1).orderBy("place").collect()] == ["ab", "a"]
    held = returns(spark, [("b", "2023-01-28", "2023-02-28", 0.1), ("c", "2023-01-28", "2023-02-28", 0.1)])
    assert comparison.default_factor(["c"], ranks, held) == "c" and comparison.default_factor([], ranks, held) == "b" and comparison.default_factor([], ranks, held.limit(0)) == "a"
    two = held.select(F.col("factor").alias("ticker"), "period_end", "return").union(spark.createDataFrame([("d", day("2023-01-01"), 0.2)], "ticker string, period_end date, return double"))
    assert [r.ticker for r in comparison.benchmark_series(two).collect()] == ["d"]


def test_inputs_are_checked():
    inputs = config.analysis({"top_n": "5", "factor_allowlist": " reversal_3d, reversal_3d ", "rebalance": "W", "min_market_cap": 0, "min_dollar_volume": ""})
    assert inputs["top_n"] == 5 and inputs["factor_allowlist"] == "reversal_3d" and inputs["min_dollar_volume"] == 50_000_000 and inputs["factor_preset"] == "zoo"
    run = config.run_config(inputs, min_tickers=3)
    assert run.names() == ["reversal_3d"] and run.rules.top_n == 5 and run.frequency == "W" and run.min_tickers == 3
    for bad in ({"top_n": 0}, {"top_n": 101}, {"top_n": 2.5}, {"weighting": "x"}, {"period": "3y"}, {"transaction_cost_bps": "nan"}, {"eligibility_adv_window": 4}, {"factor_allowlist": "a b"}, {"other": 1}):
        with pytest.raises(ValueError):
            config.analysis(bad)
    with pytest.raises(ValueError):
        config.analysis({}, fallback=False)
    assert config.tickers([" aa", "AA", None, "", "b"]) == ["AA", "B"]


def test_gates(spark):
    rows = spark.createDataFrame([("A", day("2024-06-12")), ("B", day("2024-06-13")), ("IX", day("2024-06-13"))], "ticker string, date date")
    stocks, bench = gates.parted(rows, ["IX", "IY"])
    assert {r.ticker for r in stocks.collect()} == {"A", "B"}
    assert gates.current_benchmarks(rows, ["A", "B"], day("2024-06-13"))[1] == ["A"]
    coverage = diagnostics.price_coverage(rows, 0.0).first()
    fine = [lambda: gates.no_overlap(["A"], ["B"]), lambda: gates.enough_prices(9, 10, 9, 0.9), lambda: gates.fresh(coverage, 0.5, day("2024-06-13")), lambda: gates.enough_eligible(3, 3)]
    closed = [
        lambda: gates.no_overlap(["A"], ["A"]), lambda: gates.enough_prices(9, 10, 10, 0), lambda: gates.enough_prices(8, 10, 0, 0.9), lambda: gates.fresh(coverage, 0.9, None), lambda: gates.fresh(coverage, 0, day("2024-06-14")),
        lambda: gates.fresh(None, 0, None), lambda: gates.enough_eligible(2, 3), lambda: gates.current_benchmarks(bench, ["IX"], day("2024-06-14")),
    ]
    for f in fine:
        f()
    for f in closed:
        with pytest.raises(ValueError):
            f()


def test_request_bounds():
    end = day("2024-02-28")
    assert connectors.request_bounds("5y", None) == {"period": "5y"}
    assert connectors.request_bounds("1y", day("2024-02-28")) == {"start": "2023-02-28", "end": "2024-02-29"}
    assert connectors.request_bounds("2mo", end)["start"] == "2023-12-29" and connectors.request_bounds("1wk", end)["start"] == "2024-02-22" and connectors.request_bounds("ytd", end)["start"] == "2024-01-01" and connectors.request_bounds("max", end)["start"] == "1970-01-01"
    assert connectors.chart_symbol(" brk.b ") == "BRK-B" and "range=1mo" in connectors.chart_url("A", "1MO") and "period1=" in connectors.chart_url("A", "1y", end)
    for bad in ("", "5", "1h"):
        with pytest.raises(ValueError):
            connectors.chart_period(bad)


def test_chart_source_and_session(spark):
    got = connectors.chart_prices(spark, ["aa", "stale", "gone", "AA"], expected_end=SESSION, transport="tests.fake_provider:chart", fetched_at=NOW, attempts=1, delay=0)
    rows = {(r.ticker, r.date): r for r in got.prices.collect()}
    assert len([k for k in rows if k[0] == "AA"]) == 4 and rows["STALE", SESSION].source == "yahoo_chart_completed_session_1d" and len([k for k in rows if k[0] == "STALE"]) == 4
    said = got.metadata()
    assert said["failed_tickers"] == ["GONE"] and said["succeeded_tickers"] == ["AA", "STALE"] and said["price_download_chunk_errors"][0]["ticker"] == "GONE"
    daily = spark.createDataFrame([("A", fake_provider.chart(connectors.chart_url("A", "1d"))), ("B", fake_provider.chart(connectors.chart_url("A", "1d")))], "ticker string, daily string")
    assert [r.ticker for r in connectors.completed_session(daily, SESSION, NOW).collect()] == ["A"]  # B got another symbol's payload
    assert connectors.completed_session(daily, SESSION, NOW.replace(hour=19)).isEmpty()  # not closed yet
    assert connectors.completed_session(daily, SESSION - dt.timedelta(1), NOW).isEmpty()
    torn = daily.withColumn("daily", F.regexp_replace("daily", '"low": \\[[^]]*\\]', '"low": [50.0]'))
    assert connectors.completed_session(torn, SESSION, NOW).isEmpty()


def test_bulk_and_recovery(spark, tmp_path):
    bulk = lambda names, period: connectors.bulk_prices(spark, names, fake_provider.bulk, period, str(tmp_path), 2, SESSION, NOW, attempts=1)
    chart = lambda names, period: connectors.chart_prices(spark, names, period, None, SESSION, "tests.fake_provider:chart", NOW, attempts=1, delay=0)
    got = bulk(["AA", "BROKEN", "BB", "GONE"], "5y")
    assert got.succeeded() == ["BB"] and got.metadata()["failed_tickers"] == ["AA", "BROKEN", "GONE"] and got.errors[0]["tickers"] == ["AA", "BROKEN"]
    assert spark.read.parquet(sinks.cache_path(str(tmp_path), "yfinance", got.requested)).count() == 4
    whole = connectors.resilient_prices(["AA", "STALE", "CHART", "GONE"], bulk, chart, "5y", SESSION)
    said = whole.metadata()
    assert said["bounded_session_recovered_tickers"] == ["STALE"] and said["failed_tickers"] == ["GONE"] and said["provider_fill_counts"] == {"yfinance": 2, "yahoo_chart": 1}
    assert {r.ticker: r.n for r in whole.prices.groupBy("ticker").agg(F.count("*").alias("n")).collect()} == {"AA": 4, "STALE": 4, "CHART": 4}
    calls = []
    assert connectors.retried(lambda: calls.append(1) or (len(calls) > 2 and "done") or 1 / 0 if len(calls) < 2 else "done", 3, 1.0, lambda s: None) == "done"


def test_stale_history_is_replaced_as_a_whole(spark):
    row = lambda t, d, p, s: (t, day(d), p, p, p, p, p, 1, s, "x")
    rows = spark.createDataFrame([row("A", "2024-06-13", 1.0, "old"), row("B", "2024-06-14", 1.0, "old"), row("C", "2024-06-13", 1.0, "old")], connectors.PRICES)
    fresh = spark.createDataFrame([row("A", "2024-06-13", 2.0, "new"), row("A", "2024-06-14", 2.0, "new"), row("C", "2024-06-13", 9.0, "new")], connectors.PRICES)
    nothing = rows.limit(0)
    first = lambda names, period: connectors.Fetched(nothing if period == "1d" else rows, "yfinance", names)
    got = connectors.resilient_prices(["A", "B", "C"], first, lambda names, period: connectors.Fetched(fresh, "yahoo_chart", names), "5y", SESSION)
    assert sorted((r.ticker, r.source, r.close) for r in got.prices.collect()) == [("A", "new", 2.0), ("A", "new", 2.0), ("B", "old", 1.0), ("C", "old", 1.0)]
    assert got.metadata()["stale_primary_tickers"] == ["A", "C"] and got.metadata()["stale_recovered_tickers"] == ["A"]


def test_market_caps():
    quote = lambda s, c=5.0, **more: {"symbol": s, "marketCap": c, "quoteType": "EQUITY", "currency": "USD", "regularMarketTime": 7} | more
    listed = [quote("A"), quote("B", None), quote("C", 3.0, currency="EUR"), quote("D", 4.0)]
    page = lambda offset, size: {"start": offset, "count": len(listed[offset : offset + size]), "total": len(listed), "quotes": listed[offset : offset + size]}
    caps, said = connectors.market_caps(["a", "b", "c", "d"], page, lambda t: {"B": [None, "x", 2]}[t], size=2, wait=lambda s: None)
    assert caps == {"A": 5.0, "D": 4.0, "B": 2.0} and said["missing_tickers"] == ["C"] and said["screener_page_count"] == 2 and said["targeted_fallback_count"] == 1
    totals = iter([4, 5, 4, 4])
    drifting = lambda offset, size: page(offset, size) | {"total": next(totals)}
    assert connectors.market_caps(["A"], drifting, None, size=2, wait=lambda s: None)[1]["screener_snapshot_attempt_count"] == 2
    for broken in (lambda o, size: page(o, size) | {"start": 9}, lambda o, size: page(o, size) | {"quotes": listed[::-1][:size], "count": 2}, lambda o, size: {"quotes": None}, lambda o, size: page(o, size) | {"total": 99_999}):
        with pytest.raises(ValueError):
            connectors.market_caps(["A"], lambda offset, size, f=broken: f(offset, size), None, size=2, wait=lambda s: None)
    assert connectors.market_caps([], page, None)[0] == {}
    with pytest.raises(ValueError):
        connectors.market_caps(["A"], page, None, size=0)


def test_directory(spark, tmp_path):
    path = connectors.download_directory("https://www.nasdaqtrader.com/dynamic/symdir/nasdaqlisted.txt", tmp_path / "d.txt", lambda url: "Symbol|Security Name|Market Category|Test Issue|Financial Status|ETF|NextShares\nAAPL|Apple Inc. - Common Stock|Q|N|N|N|N\nSPY|Trust Common Stock|G|N|N|N|N\nFile Creation Time: 0612202418:00||||||\n")
    rows = symbols.read_directory(spark, str(path))
    got = symbols.accepted(rows, ("SPY",), symbols.creation_time(spark, str(path)), "u").collect()
    assert [(r.ticker, r.name, r.exchange, r.as_of_date, r.symbol_directory_url) for r in got] == [("AAPL", "Apple Inc. - Common Stock", "Q", "0612202418:00", "u")]
    assert [tuple(r) for r in symbols.exclusion_counts(rows, ("SPY",)).collect()] == [("benchmark_or_blank", 1)]
    with_caps = connectors.with_market_caps(symbols.accepted(rows), {"AAPL": 7.0})
    assert {r.ticker: r.market_cap for r in with_caps.collect()}["AAPL"] == 7.0
    for url in ("http://www.nasdaqtrader.com/x", "https://example.com/x"):
        with pytest.raises(ValueError):
            connectors.download_directory(url, tmp_path / "e.txt", lambda u: "")


def test_report_text():
    assert sinks.cell_text("a|b`c\nd") == "a\\|b\\`c d" and sinks.code_text("a``b") == "``` a``b ```" and sinks.code_text("x") == "`x`"
    assert sinks.shown_value("source", "csv:/a/b/c.csv") == "csv:c.csv" and sinks.shown_value("cache_dir", "C:\\x\\y") == "y" and sinks.shown_value("n", [1]) == "[1]"


def prices_file(path, extra=""):
    lines = ["ticker,date,close,volume"]
    for k, t in enumerate(("AAA", "BBB", "CCC", "IDX")):
        for i in range(200):
            lines.append(f"{t},{day('2023-01-02') + dt.timedelta(i)},{100 + (k + 1) * i * 0.1 + (i * (k + 3)) % 7},{1000 + k}")
    path.write_text("\n".join([*lines, extra]) + "\n")
    return str(path)


def test_command(spark, tmp_path, capsys):
    prices = prices_file(tmp_path / "prices.csv")
    base = ["run", "--prices-file", prices, "--output-dir", str(tmp_path / "run"), "--factors", "reversal_3d", "reversal_5d", "--top-n", "2", "--benchmark-tickers", "idx"]
    assert command.main([*base, "--min-price-tickers", "3", "--min-latest-data-coverage-ratio", "0.9", "--expected-data-end-date", "2023-07-20", "--min-factor-eligible-tickers", "3", "--min-history-observations", "50"]) == 0
    said = json.loads((tmp_path / "run" / "run_metadata.json").read_text())
    assert said["price_ticker_count"] == 3 and said["benchmark_return_count"] > 3 and said["tested_factor_count"] == 2 and said["data_end_date"] == "2023-07-20" and said["latest_factor_eligible_ticker_count"] == 3 and said["source_hash"]
    assert (tmp_path / "run" / "benchmark_returns.csv").exists() and "IDX" not in (tmp_path / "run" / "latest_holdings.csv").read_text()
    report = (tmp_path / "run" / "report.md").read_text()
    assert str(tmp_path) not in report and "csv:prices.csv" in report and "## Caveats" in report
    assert command.main(["site", "--run-dir", str(tmp_path / "run"), "--output-file", str(tmp_path / "site" / "latest.json")]) == 0
    payload = json.loads((tmp_path / "site" / "latest.json").read_text())
    assert payload["summary"]["tested_factor_count"] == 2 and payload["caveats"] and payload["automation"] and payload["benchmark_returns"]
    assert command.main([]) == 1
    capsys.readouterr()
    for more in (["--min-price-tickers", "4"], ["--expected-data-end-date", "2023-07-19", "--min-price-coverage-ratio", "1.1"], ["--expected-data-end-date", "2024-01-01"], ["--top-n", "0"], ["--factors", "no_such"], ["--min-factor-eligible-tickers", "4"], ["--provider", "yahoo_chart"], ["--provider", "yahoo_chart", "--tickers", "IDX"]):
        assert command.main([*base, *more]) == 2
        assert capsys.readouterr().err.startswith("error: ")


def test_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda k, d: None)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        store.shared_folder(Session)
    assert pipeline.benchmark_label("^ixic") == "Nasdaq Composite" and pipeline.benchmark_label("zz") == "ZZ"
