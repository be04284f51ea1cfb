"""Transports that answer from here instead of the network."""

import datetime as dt
import json
import re

SESSION = dt.date(2024, 6, 14)


def bars(ticker, period, start=None, end=None):
    days = [SESSION - dt.timedelta(i) for i in (3, 2, 1, 0)]
    if ticker == "STALE" and period != "1d":
        days = days[:-1]
    if period == "1d":
        days = days[-1:]
    return [(d, 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 11.0 + i, 1000.0) for i, d in enumerate(days)]


def chart(url):
    ticker = re.search(r"/chart/([^?]+)\?", url)[1]
    period = "1d" if "range=1d" in url else "5y"
    if ticker == "GONE":
        raise OSError("no such symbol")
    rows = bars(ticker, period)
    stamp = lambda d: int(dt.datetime.combine(d, dt.time(13, 30), dt.UTC).timestamp())
    meta = {"symbol": ticker, "currentTradingPeriod": {"regular": {"end": int(dt.datetime.combine(SESSION, dt.time(20), dt.UTC).timestamp())}}}
    quote = {k: [r[i] for r in rows] for k, i in (("open", 1), ("high", 2), ("low", 3), ("close", 4), ("volume", 6))}
    return json.dumps({"chart": {"result": [{"meta": meta, "timestamp": [stamp(r[0]) for r in rows], "indicators": {"quote": [quote], "adjclose": [{"adjclose": [r[5] for r in rows]}]}}]}})


def bulk(tickers, period="5y", start=None, end=None):
    if "BROKEN" in tickers:
        raise OSError("chunk failed")
    one_day = start is not None and (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days == 1
    return [(t, *r) for t in tickers if t not in ("GONE", "CHART") for r in bars(t, "1d" if one_day else period)]
