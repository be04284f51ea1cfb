"""Registered queries of the factor engine, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..functions.registry import Factor
from ..operators import calendar, comparison, diagnostics, metrics, portfolio, scoring
from ..sources import loaders, sinks, symbols
from . import gates, panel, scale
from .store import kept, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _dates(schedule: DataFrame) -> list:
    """A calendar on the driver: an entry for each rebalance."""
    return sorted(r.date for r in schedule.collect())


def _query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# --- kernels

_W = "over (partition by ticker order by date rows between {} preceding and {})"


def _o(n: int) -> str:
    return _W.format(n - 1, "current row")


def _lag(column: str, k: int) -> str:
    return f"lag({column}, {k}) over (partition by ticker order by date)"


_BASE = f"""with prices as ({panel.PRICES_SQL}),
b as (select *, adj_close as c, row_number() over (partition by ticker order by date) as n, {_lag("adj_close", 1)} as pc, {_lag("close", 1)} as pcl, lead(date) over (partition by ticker order by date) as nd from prices),
x as (select *, case when pc > 0 then c / pc - 1 end as r, volume * c as dv, case when pcl > 0 then open / pcl - 1 end as gap, case when open > 0 then close / open - 1 end as day,
             case when c > 0 and high >= low then (high - low) / c end as rng from b),
y as (select *, case when {_lag("dv", 1)} > 0 then dv / {_lag("dv", 1)} - 1 end as dvc from x),
sched as (select max(date) as d from prices group by date_trunc('month', date)),
sig as (select d from sched where d < (select max(d) from sched))"""


def _ok(condition: str) -> str:
    return f"case when {condition} then '' else 'insufficient_history' end"


def _mom(lookback: int, skip: int) -> tuple[str, str]:
    end = _lag("c", skip) if skip else "c"
    return f"{end} / {_lag('c', lookback)} - 1", f"coalesce({_lag('c', lookback)} > 0, false)"


def _full(column: str, w: int) -> str:
    return f"count({column}) {_o(w)} = {w}"


_SD = f"stddev_pop(r) {_o(26)}"
_m, _g = _mom(26, 4)
_m8, _g8 = _mom(8, 2)
_base = _W.format(25, "5 preceding")
_mean_base = f"avg(dv) {_base}"
_KERNELS: dict[str, tuple[str, dict, str, str, int]] = {
    "k_momentum": ("momentum", {"lookback": 26, "skip": 4}, _m, _ok(_g), 6),
    "k_reversal": ("reversal", {"lookback": 4}, f"-({_mom(4, 0)[0]})", _ok(_mom(4, 0)[1]), 6),
    "k_vol_total": ("volatility", {"window": 26, "measure": "total"}, f"-{_SD}", _ok(_full("r", 26)), 6),
    "k_vol_downside": ("volatility", {"window": 26, "measure": "downside"}, f"-stddev_pop(case when r < 0 then r when r >= 0 then 0 end) {_o(26)}", _ok(_full("r", 26)), 6),
    "k_vol_upside": ("volatility", {"window": 26, "measure": "upside"}, f"-stddev_pop(case when r > 0 then r when r <= 0 then 0 end) {_o(26)}", _ok(_full("r", 26)), 6),
    "k_vol_range": ("volatility", {"window": 26, "measure": "range"}, f"-avg(rng) {_o(26)}", _ok(_full("rng", 26)), 6),
    "k_skew": (
        "return_skew", {"window": 26}, f"(avg(r*r*r) {_o(26)} - 3 * avg(r) {_o(26)} * avg(r*r) {_o(26)} + 2 * pow(avg(r) {_o(26)}, 3)) / pow({_SD}, 3)", _ok(f"{_full('r', 26)} and {_SD} > 0"), 4,
    ),
    "k_kurtosis": ("return_kurtosis", {"window": 26}, f"-kurtosis_pop(r) {_o(26)}", _ok(f"{_full('r', 26)} and {_SD} > 0"), 4),
    "k_tail_loss": ("tail_loss", {"window": 26}, f"list_sum(list_sort(list(r) {_o(26)})[1:3]) / 3", _ok(_full("r", 26)), 6),
    "k_trend_efficiency": ("trend_efficiency", {"window": 26}, f"(c / {_lag('c', 26)} - 1) / (sum(abs(r)) {_o(26)})", _ok(f"coalesce({_lag('c', 26)} > 0, false)"), 6),
    "k_return_consistency": ("return_consistency", {"window": 26}, f"avg(case when r > 0 then 1.0::double when r <= 0 then 0.0::double end) {_o(26)}", _ok(_full("r", 26)), 6),
    "k_ramom": ("risk_adjusted_momentum", {"lookback": 26, "skip": 4, "vol_window": 26}, f"({_m}) / {_SD}", _ok(f"{_g} and {_full('r', 26)} and {_SD} > 0"), 6),
    "k_liquidity": ("liquidity", {"window": 13}, f"avg(dv) {_o(13)}", _ok("n >= 13"), 8),
    "k_amihud": ("illiquidity", {"window": 13}, f"-(avg(abs(r) / dv) {_o(13)}) * 1e6", f"case when not ({_full('r', 13)}) then 'insufficient_history' when count(case when dv > 0 then 1 end) {_o(13)} <> 13 then 'insufficient_volume' else '' end", 4),
    "k_volume_trend": ("volume_trend", {"short": 4, "long": 26}, f"(avg(dv) {_o(4)}) / (avg(dv) {_o(26)}) - 1", f"case when n < 26 then 'insufficient_history' when avg(dv) {_o(26)} > 0 then '' else 'insufficient_volume' end", 6),
    "k_volume_shock": ("volume_shock", {"short": 5, "long": 26}, f"((avg(dv) {_o(5)}) - {_mean_base}) / (stddev_pop(dv) {_base})", f"case when n < 26 then 'insufficient_history' when count(case when dv > 0 then 1 end) {_o(26)} <> 26 then 'insufficient_volume' else '' end", 6),
    "k_price_volume_corr": ("price_volume_corr", {"window": 26}, f"(covar_pop(r, dvc) {_o(26)}) / ({_SD} * stddev_pop(dvc) {_o(26)})", f"case when n <= 26 then 'insufficient_history' when count(dvc) {_o(26)} <> 26 then 'insufficient_volume' else '' end", 6),
    "k_ma_gap": ("moving_average_gap", {"window": 20}, f"c / (avg(c) {_o(20)}) - 1", _ok("n >= 20"), 6),
    "k_ma_cross": ("moving_average_cross", {"short": 5, "long": 20}, f"(avg(c) {_o(5)}) / (avg(c) {_o(20)}) - 1", _ok("n >= 20"), 6),
    "k_range_position": ("range_position", {"window": 21}, f"(c - min(low) {_o(21)}) / (max(high) {_o(21)} - min(low) {_o(21)})", _ok(f"n >= 21 and max(high) {_o(21)} > min(low) {_o(21)}"), 6),
    "k_drawdown_high": ("drawdown_high", {"window": 21}, f"c / (max(c) {_o(21)}) - 1", _ok("n >= 21"), 6),
    "k_breakout": ("breakout_strength", {"window": 21}, f"c / (max(high) {_W.format(21, '1 preceding')}) - 1", _ok("n > 21"), 6),
    "k_range_contraction": ("range_contraction", {"short": 5, "long": 21}, f"-((avg(rng) {_o(5)}) / (avg(rng) {_o(21)}) - 1)", _ok(f"n >= 21 and {_full('rng', 21)} and avg(rng) {_o(21)} > 0"), 6),
    "k_overnight": ("overnight_return", {"window": 21}, f"avg(gap) {_o(21)}", _ok(f"n > 21 and {_full('gap', 21)}"), 6),
    "k_intraday": ("intraday_return", {"window": 21}, f"avg(day) {_o(21)}", _ok(_full("day", 21)), 6),
    "k_acceleration": ("acceleration", {"short": 8, "long": 26, "skip": 2}, f"({_m8}) - ({_mom(26, 2)[0]})", _ok(f"{_g8} and {_mom(26, 2)[1]}"), 6),
}


def _kernel_query(kind: str, params: dict, digits: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prices = panel.prices(spark, sf_dir)
        dates = _dates(calendar.rebalance_dates(prices))[:-1]
        rows = scoring.base_scores(prices, dates, [Factor("k", kind, "test", params)])
        # money is a short decimal, whose ties engines round differently: its logarithm has none
        score = F.ln("score") if kind == "liquidity" else F.col("score")
        return rows.select("ticker", "signal_date", F.round(score, digits).alias("score"), "skip_reason")

    return run


for _name, (_kind, _params, _score, _why, _digits) in _KERNELS.items():
    QUERIES[_name] = _kernel_query(_kind, _params, _digits)
    ORACLE[_name] = f"""{_BASE}, k as (select ticker, date, nd, {_score} as s, {_why} as w from y)
select ticker, d as signal_date, case when w = '' then round({"ln(s)" if _kind == "liquidity" else "s"}, {_digits}) end as score, w as skip_reason from k join sig on d >= date and (nd is null or d < nd)"""

# --- panel and calendar


@_query("panel_prices", panel.PRICES_SQL)
def _panel(spark, sf_dir):
    return panel.prices(spark, sf_dir)


@_query("rebalance_monthly", f"select max(date) as date from ({panel.PRICES_SQL}) group by date_trunc('month', date)")
def _monthly(spark, sf_dir):
    return calendar.rebalance_dates(panel.prices(spark, sf_dir), "M")


@_query("rebalance_weekly", f"select max(date) as date from ({panel.BARS_SQL.format(ticker='p_brand', unit='day')}) group by date_trunc('week', date)")
def _weekly(spark, sf_dir):
    return calendar.rebalance_dates(panel.prices(spark, sf_dir, "day"), "W")


_PERIODS = "periods as (select * from (select row_number() over (order by d) - 1 as period, d as period_start, lead(d) over (order by d) as period_end from sched) where period_end is not null)"


@_query("signal_periods", f"{_BASE}, {_PERIODS} select cast(period as integer) as period, period_start, period_end from periods")
def _periods(spark, sf_dir):
    return calendar.signal_periods(calendar.rebalance_dates(panel.prices(spark, sf_dir))).withColumn("period", F.col("period").cast("int"))


_HOLES = """select ticker, date, case when day(date) % 5 = 0 then null else open end as open, case when day(date) % 4 = 0 then null else high * 0.97::double end as high, case when day(date) % 6 = 0 then null else low * 1.03::double end as low,
  case when day(date) % 7 = 0 then 0.0::double when day(date) % 11 = 0 then null else close end as close, case when day(date) % 13 = 0 then null else adj_close end as adj_close from p"""


@_query("adjust_ohlc", f"""with p as ({panel.PRICES_SQL}), h as ({_HOLES}),
q as (select *, case when close > 0 then close else adj_close end as used from h),
r as (select *, case when used > 0 and adj_close / used > 0 then adj_close / used else 1.0::double end as k, coalesce(open, used) as first from q),
t as (select *, coalesce(high, case when first > used then first else used end) * k as top, coalesce(low, case when first < used then first else used end) * k as bottom from r)
select ticker, date, case when adj_close is null then open else first * k end as open, case when adj_close is null then high when top < bottom then bottom else top end as high,
  case when adj_close is null then low when top < bottom then top else bottom end as low, case when adj_close is null then close else adj_close end as close from t""")
def _adjust(spark, sf_dir):
    """Bars with holes: missing opens, highs, lows and closes, closes of 0, highs below lows, no adjusted close."""
    hole = lambda n, value: F.when(F.dayofmonth("date") % n != 0, value)
    bars = panel.prices(spark, sf_dir).withColumns({
        "open": hole(5, F.col("open")), "high": hole(4, F.col("high") * 0.97), "low": hole(6, F.col("low") * 1.03), "close": F.when(F.dayofmonth("date") % 7 == 0, 0.0).otherwise(hole(11, F.col("close"))), "adj_close": hole(13, F.col("adj_close")),
    })
    return loaders.adjusted(bars).select("ticker", "date", "open", "high", "low", "close")


# --- scores

_FACTORS = [
    Factor("f_mom", "momentum", "momentum", {"lookback": 26, "skip": 4}),
    Factor("f_vol", "volatility", "risk", {"window": 26, "measure": "total"}),
    Factor("f_liq", "liquidity", "liquidity", {"window": 13}),
]
_BLEND = Factor("f_blend", "composite", "composite", parts=("f_mom", "f_vol", "f_liq"))


def _inputs(spark, sf_dir):
    """The panel and its scores, each computed once: later steps read them often."""
    prices = kept(panel.prices(spark, sf_dir), "panel")
    dates = _dates(calendar.rebalance_dates(prices))
    schedule = spark.createDataFrame([(d,) for d in dates], "date date")
    base = scoring.base_scores(prices, dates[:-1], _FACTORS)
    base = kept(base, "base")
    return prices, schedule, dates, scoring.ranked(base.unionByName(scoring.blended(base, [_BLEND])))


_SCORES = f"""{_BASE}, {_PERIODS},
k as (select 'f_mom' as factor, ticker, date, nd, {_KERNELS['k_momentum'][2]} as s, {_KERNELS['k_momentum'][3]} as w from y
      union all select 'f_vol', ticker, date, nd, {_KERNELS['k_vol_total'][2]}, {_KERNELS['k_vol_total'][3]} from y
      union all select 'f_liq', ticker, date, nd, {_KERNELS['k_liquidity'][2]}, {_KERNELS['k_liquidity'][3]} from y),
base as (select factor, ticker, d as signal_date, case when w = '' then s end as score, w as skip_reason from k join sig on d >= date and (nd is null or d < nd)),
mm as (select *, min(score) over (partition by factor, signal_date) as lo, max(score) over (partition by factor, signal_date) as hi from base),
blend as (select 'f_blend' as factor, ticker, signal_date, case when count(score) = 3 then avg(case when hi > lo then (score - lo) / (hi - lo) else 0.5 end) end as score,
          case when count(score) = 3 then '' else 'insufficient_history' end as skip_reason from mm group by ticker, signal_date),
scores as (select * from base union all select * from blend)"""


@_query("factor_scores_ranked", f"""{_SCORES} select factor, ticker, signal_date, round(score, 4) as score, case when skip_reason = '' then cast(row_number() over (partition by factor, signal_date, skip_reason = '' order by score desc, ticker) as integer) end as rank, skip_reason = '' as eligible, skip_reason from scores""")
def _ranked(spark, sf_dir):
    return _inputs(spark, sf_dir)[3].withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("int"))


@_query("skip_reason_counts", f"{_SCORES} select skip_reason, count(*) as n from scores where skip_reason <> '' group by 1")
def _skips(spark, sf_dir):
    return _inputs(spark, sf_dir)[3].where("skip_reason <> ''").groupBy("skip_reason").agg(F.count("*").alias("n"))


@_query("k_fundamental_asof", f"""{_BASE}, f as ({panel.FUNDAMENTALS_SQL}), t as (select distinct ticker from prices), g as (select ticker, d from t cross join sig where exists (select 1 from prices p where p.ticker = t.ticker and p.date <= d))
select g.ticker, d as signal_date, -(select pe_ratio from f where f.ticker = g.ticker and f.available_at <= d order by available_at desc limit 1) as score,
  case when (select count(*) from f where f.ticker = g.ticker and f.available_at <= d) > 0 then '' else 'missing_fundamentals' end as skip_reason from g""")
def _asof(spark, sf_dir):
    prices = panel.prices(spark, sf_dir)
    dates = _dates(calendar.rebalance_dates(prices))[:-1]
    factor = Factor("k", "fundamental", "value", {"field": "pe_ratio", "direction": "negative"})
    return scoring.base_scores(prices, dates, [factor], panel.fundamentals(spark, sf_dir)).select("ticker", "signal_date", "score", "skip_reason")


def _reason_sql(f: Factor) -> str:
    """SQL for why a factor has no score in a row of ``y``; fundamentals and blends are judged apart."""
    p = f.params
    w, short, long, skip = p.get("window", 0), p.get("short", 0), p.get("long", 0), p.get("skip", 0)
    sd = lambda n: f"stddev_pop(r) {_o(n)} > 0"
    start = lambda n: f"coalesce({_lag('c', n)} > 0, false)"
    traded = lambda n: f"count(case when dv > 0 then 1 end) {_o(n)} = {n}"
    simple = {
        "momentum": lambda: start(p["lookback"]),
        "reversal": lambda: start(p["lookback"]),
        "volatility": lambda: _full("rng" if p["measure"] == "range" else "r", w),
        "return_skew": lambda: f"{_full('r', w)} and {sd(w)}",
        "return_kurtosis": lambda: f"{_full('r', w)} and {sd(w)}",
        "tail_loss": lambda: _full("r", w),
        "trend_efficiency": lambda: start(w),
        "return_consistency": lambda: _full("r", w),
        "risk_adjusted_momentum": lambda: f"{start(p['lookback'])} and {_full('r', p['vol_window'])} and {sd(p['vol_window'])}",
        "liquidity": lambda: f"n >= {w}",
        "moving_average_gap": lambda: f"n >= {w} and avg(c) {_o(w)} > 0",
        "moving_average_cross": lambda: f"n >= {long} and avg(c) {_o(long)} > 0",
        "range_position": lambda: f"n >= {w} and max(high) {_o(w)} > min(low) {_o(w)}",
        "drawdown_high": lambda: f"n >= {w} and max(c) {_o(w)} > 0",
        "breakout_strength": lambda: f"n > {w} and max(high) {_W.format(w, '1 preceding')} > 0",
        "range_contraction": lambda: f"n >= {long} and {_full('rng', long)} and avg(rng) {_o(long)} > 0",
        "overnight_return": lambda: f"n > {w} and {_full('gap', w)}",
        "intraday_return": lambda: _full("day", w),
        "acceleration": lambda: f"{start(short)} and {start(long)} and {skip} < {short}",
    }
    if f.kind in simple:
        return _ok(simple[f.kind]())
    early, volume = {
        "illiquidity": (f"not ({_full('r', w)})", traded(w)),
        "volume_trend": (f"n < {long}", f"avg(dv) {_o(long)} > 0"),
        "volume_shock": (f"n < {long}", traded(long)),
        "price_volume_corr": (f"n <= {w}", _full("dvc", w)),
    }[f.kind]
    flat = f" when not ({_full('r', w)} and {sd(w)} and stddev_pop(dvc) {_o(w)} > 0) then 'insufficient_history'" if f.kind == "price_volume_corr" else ""
    return f"case when {early} then 'insufficient_history' when not ({volume}) then 'insufficient_volume'{flat} else '' end"


def _zoo_sql() -> str:
    every = registry.REGISTRY.values()
    wide = ", ".join(f'{_reason_sql(f)} as "{f.name}"' for f in every if f.kind not in ("fundamental", "composite"))
    facts = ", ".join(f"('{f.name}', '{f.params['field']}')" for f in every if f.kind == "fundamental")
    parts = ", ".join(f"('{f.name}', '{part}', {len(f.parts)})" for f in every for part in f.parts)
    return f"""{_BASE}, wide as (select ticker, date, nd, {wide} from y),
seen as (select d as signal_date, wide.* exclude (date, nd) from wide join sig on d >= date and (nd is null or d < nd)),
base as (unpivot seen on columns(* exclude (ticker, signal_date)) into name factor value skip_reason),
known as (select ticker, min(available_at) as first from ({panel.FUNDAMENTALS_SQL}) group by 1),
facts as (select f.factor, case when f.field in ('pe_ratio', 'return_on_equity') and k.first <= a.signal_date then '' else 'missing_fundamentals' end as skip_reason
  from seen a left join known k on a.ticker = k.ticker, (values {facts}) f(factor, field)),
blends as (select b.blend as factor, case when count_if(s.skip_reason = '') = max(b.parts) then '' else 'insufficient_history' end as skip_reason
  from base s join (values {parts}) b(blend, part, parts) on s.factor = b.part group by b.blend, s.ticker, s.signal_date)
select factor, skip_reason, count(*) as n from (select factor, skip_reason from base union all select * from facts union all select * from blends) group by 1, 2"""


@_query("zoo_scores", _zoo_sql())
def _zoo(spark, sf_dir):
    """All registered factors at once, counted by reason: the widest plan there is."""
    prices = kept(panel.prices(spark, sf_dir), "panel")
    dates = _dates(calendar.rebalance_dates(prices))[:-1]
    rows = scoring.factor_scores(prices, dates, registry.preset("zoo"), panel.fundamentals(spark, sf_dir), lambda df: kept(df, "base_scores"))
    return rows.groupBy("factor", "skip_reason").agg(F.count("*").alias("n"))


def _score_sql(f: Factor) -> str:
    """SQL for a factor's score in a row of ``y``; fundamentals and blends are worked out apart."""
    p = f.params
    w, short, long, skip = p.get("window", 0), p.get("short", 0), p.get("long", 0), p.get("skip", 0)
    sd, start = f"stddev_pop(r) {_o(w or p.get('vol_window', 1))}", lambda n, k=0: f"({_mom(n, k)[0]})"
    before = _W.format(max(long, 1) - 1, f"{short} preceding")
    worst = max(1, -(-w // 10))
    cube = f"(avg(r*r*r) {_o(w)} - 3 * avg(r) {_o(w)} * avg(r*r) {_o(w)} + 2 * pow(avg(r) {_o(w)}, 3))" if w else ""
    return {
        "momentum": lambda: start(p["lookback"], skip),
        "reversal": lambda: f"-{start(p['lookback'])}",
        "volatility": lambda: {
            "total": f"-{sd}", "downside": f"-stddev_pop(case when r < 0 then r when r >= 0 then 0 end) {_o(w)}", "upside": f"-stddev_pop(case when r > 0 then r when r <= 0 then 0 end) {_o(w)}", "range": f"-avg(rng) {_o(w)}",
        }[p["measure"]],
        "return_skew": lambda: f"{cube} / pow({sd}, 3)",
        "return_kurtosis": lambda: f"-kurtosis_pop(r) {_o(w)}",
        "tail_loss": lambda: f"list_sum(list_sort(list(r) {_o(w)})[1:{worst}]) / {worst}",
        "trend_efficiency": lambda: f"{start(w)} / (sum(abs(r)) {_o(w)})",
        "return_consistency": lambda: f"avg(case when r > 0 then 1.0::double when r <= 0 then 0.0::double end) {_o(w)}",
        "risk_adjusted_momentum": lambda: f"{start(p['lookback'], skip)} / {sd}",
        "liquidity": lambda: f"avg(dv) {_o(w)}",
        "illiquidity": lambda: f"-(avg(abs(r) / dv) {_o(w)}) * 1e6",
        "volume_trend": lambda: f"(avg(dv) {_o(short)}) / (avg(dv) {_o(long)}) - 1",
        "volume_shock": lambda: f"case when (stddev_pop(dv) {before}) > 0 then ((avg(dv) {_o(short)}) - (avg(dv) {before})) / (stddev_pop(dv) {before}) else (avg(dv) {_o(short)}) / (avg(dv) {before}) - 1 end",
        "price_volume_corr": lambda: f"(covar_pop(r, dvc) {_o(w)}) / ({sd} * stddev_pop(dvc) {_o(w)})",
        "moving_average_gap": lambda: f"c / (avg(c) {_o(w)}) - 1",
        "moving_average_cross": lambda: f"(avg(c) {_o(short)}) / (avg(c) {_o(long)}) - 1",
        "range_position": lambda: f"(c - min(low) {_o(w)}) / (max(high) {_o(w)} - min(low) {_o(w)})",
        "drawdown_high": lambda: f"c / (max(c) {_o(w)}) - 1",
        "breakout_strength": lambda: f"c / (max(high) {_W.format(w, '1 preceding')}) - 1",
        "range_contraction": lambda: f"-((avg(rng) {_o(short)}) / (avg(rng) {_o(long)}) - 1)",
        "overnight_return": lambda: f"avg(gap) {_o(w)}",
        "intraday_return": lambda: f"avg(day) {_o(w)}",
        "acceleration": lambda: f"{start(short, skip)} - {start(long, skip)}",
    }[f.kind]()


def _zoo_values_sql() -> str:
    every = registry.REGISTRY.values()
    wide = ", ".join(f"""case when ({_reason_sql(f)}) = '' then cast({_score_sql(f)} as double) end as "{f.name}\"""" for f in every if f.kind not in ("fundamental", "composite"))
    parts = ", ".join(f"('{f.name}', '{part}', {len(f.parts)})" for f in every for part in f.parts)
    return f"""{_BASE}, wide as (select ticker, date, nd, {wide} from y),
seen as (select d as signal_date, wide.* exclude (date, nd) from wide join sig on d >= date and (nd is null or d < nd)),
base as (unpivot seen on columns(* exclude (ticker, signal_date)) into name factor value score),
f as ({panel.FUNDAMENTALS_SQL}), known as (select s.ticker, s.signal_date, arg_max(pe_ratio, available_at) as pe, arg_max(return_on_equity, available_at) as roe from seen s join f on f.ticker = s.ticker and f.available_at <= s.signal_date group by 1, 2),
scaled as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0.5::double end as scaled from base window w as (partition by factor, signal_date)),
blends as (select b.blend as factor, s.ticker, s.signal_date, avg(scaled) as score from scaled s join (values {parts}) b(blend, part, parts) on s.factor = b.part group by b.blend, s.ticker, s.signal_date, b.parts having count(*) = b.parts),
rows as (select factor, ticker, signal_date, score from base union all select factor, ticker, signal_date, score from blends
  union all select 'value_pe', ticker, signal_date, -pe from known where pe > 0 union all select 'quality_roe', ticker, signal_date, cast(roe as double) from known where roe is not null)
select factor, count(*) as n, round(ln(max(abs(score)) + 1e-12::double), 4) as log_top, round(avg(score) / (max(abs(score)) + 1e-12::double), 4) as mean_share,
  round(sum(score * (1 + (day(signal_date) + ascii(right(ticker, 1))) % 7)) / (sum(abs(score)) + 1e-12::double), 4) as mix_share from rows group by 1"""


@_query("zoo_values", _zoo_values_sql())
def _zoo_values(spark, sf_dir):
    """The scores of all registered factors, by factor: how many, how large, and two sums that tell rows apart."""
    prices = kept(panel.prices(spark, sf_dir), "panel")
    dates = _dates(calendar.rebalance_dates(prices))[:-1]
    rows = scoring.factor_scores(prices, dates, registry.preset("zoo"), panel.fundamentals(spark, sf_dir), lambda df: kept(df, "base_scores")).where("eligible")
    top, tiny = F.max(F.abs("score")), F.lit(1e-12)
    place = 1 + (F.dayofmonth("signal_date") + F.ascii(F.right("ticker", F.lit(1)))) % 7
    return rows.groupBy("factor").agg(
        F.count("*").alias("n"), F.round(F.ln(top + tiny), 4).alias("log_top"), (F.round(F.avg("score") / (top + tiny), 4) + F.lit(0.0)).alias("mean_share"), (F.round(F.sum(F.col("score") * place) / (F.sum(F.abs("score")) + tiny), 4) + F.lit(0.0)).alias("mix_share")
    )


_CATALOG_SQL = ", ".join(f"('{f.name}', '{f.kind}', '{f.category}', {len(f.needs)})" for f in registry.REGISTRY.values())


@_query("family_summary", f"""with c(factor, kind, category, needs) as (values {_CATALOG_SQL}), k as (select category, kind, count(*) as n from c group by 1, 2),
m as (select category, string_agg(kind || ':' || n, ',' order by kind) as kinds from k group by 1)
select c.category, count(*) as factors, array_to_string(list_sort(list(factor))[1:6], ',') as examples, count(*) filter (where needs > 0) as fundamental, any_value(m.kinds) as kinds from c join m on c.category = m.category group by 1""")
def _families(spark, sf_dir):
    """The registry's families: it reads no table, nor does its SQL."""
    out = registry.family_summary(registry.catalog(spark))
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("category", "factors", F.array_join("examples", ",").alias("examples"), "fundamental", kinds.alias("kinds"))


# --- portfolios

_RULES = portfolio.Rules(top_n=5, weighting="score", min_market_cap=1000.0, min_dollar_volume=1.0, adv_window=13, cost_bps=10.0)


def _tested(spark, sf_dir, rules=_RULES):
    prices, schedule, dates, scores = _inputs(spark, sf_dir)
    scores = kept(scores, "scores")
    return portfolio.backtest(scores, panel.universe(spark, sf_dir), prices, calendar.signal_periods(schedule), dates, rules), prices, dates


def _backtest_sql(weight: str, cost: str) -> str:
    return f"""{_SCORES}, uni as ({panel.UNIVERSE_SQL}),
adv as (select ticker, d, case when n >= 13 then a else 0 end as adv from (select ticker, date, nd, n, avg(dv) {_o(13)} as a from y) join sched on d >= date and (nd is null or d < nd)),
judged as (select s.*, case when s.skip_reason <> '' then s.skip_reason when not coalesce(u.stock, false) then 'inactive_or_non_stock' when u.market_cap < 1000 then 'market_cap_below_min' when coalesce(a.adv, 0) < 1 then 'insufficient_volume' else '' end as why
  from scores s left join uni u on s.ticker = u.ticker left join adv a on a.ticker = s.ticker and a.d = s.signal_date),
top as (select * from (select *, row_number() over (partition by factor, signal_date order by score desc, ticker) as k from judged where why = '') where k <= 5),
lifted as (select *, count(*) over w as m, max(score) over w - min(score) over w as span, score - min(score) over w + 0.01 * (max(score) over w - min(score) over w) as up from top window w as (partition by factor, signal_date)),
chosen as (select factor, signal_date, ticker, score, {weight} as weight from lifted),
priced as (select c.*, p.period, p.period_end, b.adj_close as p0, e.adj_close as p1 from chosen c join periods p on c.signal_date = p.period_start
  left join prices b on b.ticker = c.ticker and b.date = p.period_start left join prices e on e.ticker = c.ticker and e.date = p.period_end),
held as (select * from (select *, bool_or(p0 is null or p1 is null or p0 <= 0) over (partition by factor, period) as bad from priced) where not bad),
moved as (select coalesce(a.factor, b.factor) as factor, coalesce(a.period, b.period + 1) as period, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) as traded
  from held a full outer join held b on a.factor = b.factor and a.ticker = b.ticker and a.period = b.period + 1 group by 1, 2),
gross as (select factor, period, sum(weight * (p1 / p0 - 1)) as gross, count(*) as n from held group by 1, 2),
returns as (select f.factor, p.period_start, p.period_end, coalesce(g.gross, 0) - 0.001 * {cost} as ret, 0.5 * coalesce(m.traded, 0) as turnover, cast(coalesce(g.n, 0) as integer) as holdings_count,
  case when g.n > 0 then '' when exists (select 1 from priced q where q.factor = f.factor and q.period = p.period) then 'invalid_period_missing_price' else 'empty_after_filters' end as skip_reason
  from (select distinct factor from scores) f cross join periods p left join gross g on g.factor = f.factor and g.period = p.period left join moved m on m.factor = f.factor and m.period = p.period)"""


_SCORED = _backtest_sql("case when m > 1 and span > 0 then up / sum(up) over (partition by factor, signal_date) else 1.0::double / m end", "coalesce(m.traded, 0)")
_EQUAL = _backtest_sql("1.0::double / m", "0.5 * coalesce(m.traded, 0)")
_HELD = "select factor, signal_date as rebalance_date, ticker, round(weight, 6) as weight from held"
_RET = "select factor, period_start, period_end, round(ret, 6) as ret, round(turnover, 6) as turnover, holdings_count, skip_reason from returns"


def _held(df):
    return df.select("factor", "rebalance_date", "ticker", F.round("weight", 6).alias("weight"))


def _ret(df):
    return df.select("factor", "period_start", "period_end", (F.round("return", 6) + F.lit(0.0)).alias("ret"), F.round("turnover", 6).alias("turnover"), "holdings_count", "skip_reason")


_EQUAL_RULES = portfolio.Rules(top_n=5, weighting="equal", min_market_cap=1000.0, min_dollar_volume=1.0, adv_window=13, cost_bps=10.0, cost_model="portfolio_turnover")
_query("select_score", f"{_SCORED} {_HELD}")(lambda s, d: _held(_tested(s, d)[0]["holdings"]))
_query("select_equal", f"{_EQUAL} {_HELD}")(lambda s, d: _held(_tested(s, d, _EQUAL_RULES)[0]["holdings"]))
_query("backtest_returns", f"{_SCORED} {_RET}")(lambda s, d: _ret(_tested(s, d)[0]["returns"]))
_query("cost_turnover", f"{_EQUAL} {_RET}")(lambda s, d: _ret(_tested(s, d, _EQUAL_RULES)[0]["returns"]))
_query("select_filters", f"{_SCORED} select why as skip_reason, count(*) as n from judged where why <> '' group by 1")(
    lambda s, d: _judged(s, d).where("reject_reason <> ''").groupBy(F.col("reject_reason").alias("skip_reason")).agg(F.count("*").alias("n"))
)


def _judged(spark, sf_dir):
    prices, _, dates, scores = _inputs(spark, sf_dir)
    return portfolio.judged(scores, panel.universe(spark, sf_dir), prices, dates, _RULES)


_METRICS = """, e as (select *, exp(sum(ln(1 + ret)) over (partition by factor order by period_end)) as equity from {rows}),
dd as (select *, equity / greatest(1.0, max(equity) over (partition by factor order by period_end)) - 1 as drawdown from e),
agg as (select factor, max_by(equity, period_end) as total, count(*) as n, avg(ret) as mean, stddev_pop(ret) as sd, avg(pow(least(ret, 0), 2)) as down, least(0, min(drawdown)) as mdd, avg(turnover) as turnover, avg(case when holdings_count > 0 then 1.0::double else 0.0::double end) as coverage from dd group by 1),
met as (select factor, pow(total, 12.0 / n) - 1 as cagr, mean * 12 as annual_return, sd * sqrt(12) as volatility, case when sd > 0 then mean * 12 / (sd * sqrt(12)) else 0 end as sharpe,
  case when down > 0 then least(999, greatest(-999, mean * 12 / (sqrt(down) * sqrt(12)))) when mean <= 0 then 0 else 999 end as sortino,
  case when mdd < 0 then least(999, greatest(-999, (pow(total, 12.0 / n) - 1) / abs(mdd))) when pow(total, 12.0 / n) <= 1 then 0 else 999 end as calmar, mdd as max_drawdown, turnover, coverage from agg)"""
_HOLD = ", tail as (select * from (select *, row_number() over (partition by factor order by period_end desc) as back, greatest(6, ceil(count(*) over (partition by factor) * 0.25)) as keep from returns) where back <= keep)"
_RNK = """, nrm as (select *, {parts} from met),
rnk as (select *, 0.20 * n_cagr + 0.25 * n_sharpe + 0.20 * n_sortino + 0.20 * n_calmar + 0.10 * (1 - n_max_drawdown) + 0.05 * (1 - n_volatility) as composite_score from nrm)
select cast(row_number() over (order by composite_score desc, sharpe desc, cagr desc, max_drawdown desc, factor) as integer) as rank, factor, round(composite_score, 5) as composite_score from rnk""".format(
    parts=", ".join(f"case when max({e}) over () > min({e}) over () then ({e} - min({e}) over ()) / (max({e}) over () - min({e}) over ()) else 0.5 end as n_{n}" for n, e in (("cagr", "cagr"), ("sharpe", "sharpe"), ("sortino", "sortino"), ("calmar", "calmar"), ("max_drawdown", "abs(max_drawdown)"), ("volatility", "volatility")))
)
_SHOWN = "select factor, " + ", ".join(f"round({n}, 4) as {n}" for n in metrics.NAMES) + " from met"


def _shown(df):
    return df.select("factor", *(F.round(n, 4).alias(n) for n in metrics.NAMES))


def _ranks(df):
    return df.select(F.col("rank").cast("int").alias("rank"), "factor", F.round("composite_score", 5).alias("composite_score"))


def _returns(spark, sf_dir):
    return kept(_tested(spark, sf_dir)[0]["returns"], "returns")


_query("metrics", _SCORED + _METRICS.format(rows="returns") + _SHOWN)(lambda s, d: _shown(metrics.metrics(_returns(s, d))))
_query("holdout_metrics", _SCORED + _HOLD + _METRICS.format(rows="tail") + _SHOWN)(lambda s, d: _shown(metrics.metrics(metrics.holdout(_returns(s, d)))))
_query("factor_ranking", _SCORED + _METRICS.format(rows="returns") + _RNK)(lambda s, d: _ranks(metrics.ranking(metrics.metrics(_returns(s, d)))))
_query("holdout_ranking", _SCORED + _HOLD + _METRICS.format(rows="tail") + _RNK)(lambda s, d: _ranks(metrics.ranking(metrics.metrics(metrics.holdout(_returns(s, d))))))
_query("equity_drawdown", _SCORED + _METRICS.format(rows="returns") + "select factor, period_end, round(ln(equity), 5) as log_equity, round(drawdown, 5) as drawdown from dd")(
    lambda s, d: metrics.equity_curve(_returns(s, d)).select("factor", "period_end", F.round(F.ln("equity"), 5).alias("log_equity"), F.round("drawdown", 5).alias("drawdown"))
)
_POINTS = """, curve as (select factor, period_end as date, exp(sum(ln(1 + ret)) over (partition by factor order by period_end)) as equity from returns
  union all select factor, min(period_start), 1.0::double from returns group by 1)"""
_SLICED = """, backs as (select *, row_number() over (partition by factor order by date desc) as back, year(date) = year(max(date) over (partition by factor)) as here from curve),
sl as (select b.*, s.slice from (select *, count(*) filter (where here) over (partition by factor) + 1 as ytd from backs) b, (values ('all'), ('1y'), ('3y'), ('ytd')) s(slice)
  where s.slice = 'all' or (s.slice = '1y' and back <= 13) or (s.slice = '3y' and back <= 37) or (s.slice = 'ytd' and back <= greatest(2, ytd))),
st as (select *, equity / lag(equity) over w - 1 as step, equity / max(equity) over (partition by factor, slice order by date rows unbounded preceding) - 1 as down from sl window w as (partition by factor, slice order by date)),
ag as (select factor, slice, count(step) as n, arg_max(equity, date) / arg_min(equity, date) - 1 as cumulative, avg(step) as mean, stddev_pop(step) as sd, sqrt(avg(pow(least(step, 0), 2)) filter (where step is not null)) as below, least(0, min(down)) as mdd from st group by 1, 2),
cm as (select *, pow(1 + cumulative, 12.0 / n) - 1 as cagr from ag)
select factor, slice, n, round(cumulative, 4) as cumulative, round(cagr, 4) as cagr, round(sd * sqrt(12), 4) as volatility, round(case when sd > 0 then mean * 12 / (sd * sqrt(12)) end, 4) as sharpe,
  round(case when below > 0 then mean * 12 / (below * sqrt(12)) when mean > 0 then 999 end, 4) as sortino, round(case when mdd < 0 then cagr / abs(mdd) when cagr > 0 then 999 end, 4) as calmar, round(mdd, 4) as max_drawdown from cm"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 4) + F.lit(0.0) for n in names})


_query("compare_slices", _SCORED + _POINTS + _SLICED)(lambda s, d: _rounded(comparison.comparison(_returns(s, d)), "cumulative", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown"))
_query("compare_points", _SCORED + _POINTS + " select factor, date, round(ln(equity), 5) as log_equity, round(equity / greatest(1.0::double, max(equity) over (partition by factor order by date)) - 1, 5) as drawdown from curve")(
    lambda s, d: comparison.points(_returns(s, d)).select("factor", "date", (F.round(F.ln("equity"), 5) + F.lit(0.0)).alias("log_equity"), (F.round("drawdown", 5) + F.lit(0.0)).alias("drawdown"))
)


@_query("ranking_view", _SCORED + _METRICS.format(rows="returns") + ", v as (select factor, sharpe, row_number() over (order by sharpe desc, factor) as place from met) select cast(place as integer) as place, factor, round(sharpe, 4) as sharpe from (select *, count(*) filter (where factor like '%f_l%' or factor like '%f_m%') over (order by place) as k from v) where (k <= 1 and (factor like '%f_l%' or factor like '%f_m%')) or factor = 'f_vol'")
def _view(spark, sf_dir):
    """The best factor by Sharpe ratio among two families, and one that was selected."""
    ranks = metrics.ranking(metrics.metrics(_returns(spark, sf_dir)))
    among = comparison.sorted_by(ranks.withColumn("factor", F.when(F.col("factor").rlike("f_[lm]"), F.concat(F.col("factor"), F.lit("|listed"))).otherwise(F.col("factor"))), "sharpe", "|LISTED", ("f_vol",), 1)
    return among.select(F.col("place").cast("int").alias("place"), F.regexp_replace("factor", r"\|listed", "").alias("factor"), F.round("sharpe", 4).alias("sharpe"))


@_query("compare_default", _SCORED + _METRICS.format(rows="returns") + _RNK.replace("select cast(row_number()", ", shown as (select cast(row_number()") + ") select factor from shown where rank = 2")
def _default(spark, sf_dir):
    """The factor that a comparison begins with: the next ranked one, as none is selected."""
    returns = _returns(spark, sf_dir)
    name = comparison.default_factor((), metrics.ranking(metrics.metrics(returns)), returns)
    return spark.createDataFrame([(name,)], "factor string")


@_query("compare_nearest", _SCORED + _POINTS + """, asked(day) as (values (date '1992-01-01'), (date '1995-03-20'), (date '1996-11-05'), (date '2030-01-01')), dates as (select distinct date from curve)
select day, arg_min(date, abs(date_diff('day', date, day)) * 100000 + date_diff('day', date '1970-01-01', date)) as nearest, max(case when date = day then 1 else 0 end) = 1 as exact from asked, dates group by 1""")
def _nearest(spark, sf_dir):
    """For some days the observed date that is nearest, and whether it is that day."""
    import datetime as dt

    series = kept(comparison.points(_returns(spark, sf_dir)), "points")
    out = None
    for day in (dt.date(1992, 1, 1), dt.date(1995, 3, 20), dt.date(1996, 11, 5), dt.date(2030, 1, 1)):
        row = comparison.nearest_date(series, day).select(F.lit(day).alias("day"), F.col("date").alias("nearest")).withColumn("exact", F.lit(not comparison.at_date(series, day).isEmpty()))
        out = row if out is None else out.unionByName(row)
    return out


_query("turnover_stats", _SCORED + " select factor, count(*) as periods, count(*) filter (where holdings_count > 0) as invested, round(avg(turnover), 6) as mean_turnover, round(max_by(turnover, period_end), 6) as latest_turnover from returns group by 1")(
    lambda s, d: diagnostics.turnover_stats(_returns(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_turnover", "latest_turnover")})
)
@_query("latest_holdings", _SCORED + _METRICS.format(rows="returns") + _RNK.replace("select cast(row_number()", ", shown as (select cast(row_number()") + "), first as (select factor from shown where rank = 1) select ticker, round(weight, 6) as weight from held where factor = (select factor from first) and signal_date = (select max(signal_date) from held where factor = (select factor from first))")
def _latest(spark, sf_dir):
    """The newest holdings of the factor that ranks first."""
    found = _tested(spark, sf_dir)[0]
    best = metrics.ranking(metrics.metrics(found["returns"])).where("rank = 1").first().factor
    return portfolio.latest_holdings(found["holdings"], best).select("ticker", F.round("weight", 6).alias("weight"))


@_query("portfolio_concentration", _SCORED + """ select h.factor, h.signal_date as rebalance_date, round(sum(weight), 6) as weight_sum, round(1 / sum(weight * weight), 5) as effective_names, round(min(0.1 * adv / weight), 2) as capacity
from held h join adv a on a.ticker = h.ticker and a.d = h.signal_date group by 1, 2""")
def _concentration(spark, sf_dir):
    found, prices, dates = _tested(spark, sf_dir)
    out = diagnostics.concentration(found["holdings"], portfolio.average_dollar_volume(prices, dates, 13))
    return out.select("factor", "rebalance_date", F.round("weight_sum", 6).alias("weight_sum"), F.round("effective_names", 5).alias("effective_names"), F.round("capacity", 2).alias("capacity"))


@_query("portfolio_diagnostics", _SCORED + """, h as (select h.factor, h.signal_date as rebalance_date, h.ticker, h.weight, a.adv, row_number() over (partition by h.factor, h.signal_date order by h.weight desc, h.ticker) as k from held h join adv a on a.ticker = h.ticker and a.d = h.signal_date)
select factor, rebalance_date, count(*) as names, round(min(weight), 6) as weight_min, round(max(weight), 6) as weight_max, round(sum(weight) filter (where k <= 5), 6) as weight_top5, round(ln(min(adv)), 6) as adv_min, arg_min(ticker, adv) as adv_min_ticker,
  round(ln(median(adv)), 6) as adv_median, round(ln(sum(weight * adv)), 6) as adv_weighted, round(ln(min(0.05 * adv / weight)), 6) as capacity_low, arg_min(ticker, adv / weight) as tightest from h group by 1, 2""")
def _portfolio_diagnostics(spark, sf_dir):
    found, prices, dates = _tested(spark, sf_dir)
    out = diagnostics.concentration(found["holdings"], portfolio.average_dollar_volume(prices, dates, 13))
    logs = [F.round(F.ln(c), 6).alias(c) for c in ("adv_min", "adv_median", "adv_weighted", "capacity_low")]
    return out.select("factor", "rebalance_date", "names", *(F.round(c, 6).alias(c) for c in ("weight_min", "weight_max", "weight_top5")), *logs, "adv_min_ticker", "tightest")


_query("factor_counts", _SCORED + " select count(distinct factor) as tested, count(distinct factor) filter (where holdings_count > 0) as effective from returns")(lambda s, d: diagnostics.factor_counts(_returns(s, d)))


@_query("zero_coverage_counts", _SCORED + """, strict as (select factor, period_start, case when month(period_start) = 13 then holdings_count else 0 end as held from returns where factor <> 'f_mom' union all select factor, period_start, holdings_count from returns where factor = 'f_mom')
select 'zero_coverage:' || factor as skip_reason, count(distinct factor) as count from strict group by factor having max(held) = 0""")
def _zero(spark, sf_dir):
    """Reasons of factors without holdings, with all of them but one emptied."""
    returns = _returns(spark, sf_dir).withColumn("holdings_count", F.when(F.col("factor") == "f_mom", F.col("holdings_count")).otherwise(F.lit(0)))
    return diagnostics.zero_coverage(metrics.metrics(returns))


@_query("universe_facts", f"""with uni as ({panel.UNIVERSE_SQL}), p as (select distinct ticker from ({panel.PRICES_SQL}) where ticker < 'Brand#4'),
u as (select *, case when ticker like '%1' then 'b list' when ticker like '%2' then 'a list' when ticker like '%3' then 'd list' else 'c list' end as source, cast(date '2024-01-01' + cast(ascii(right(ticker, 1)) as integer) as varchar) as as_of_date from uni)
select count(*) as tickers, count(*) filter (where stock and ticker in (select ticker from p)) as rankable, max(as_of_date) as as_of, 'a list,b list,c list' as name from u""")
def _universe_facts(spark, sf_dir):
    last = F.right("ticker", F.lit(1))
    listed = panel.universe(spark, sf_dir).withColumn("source", F.when(last == "1", "b list").when(last == "2", "a list").when(last == "3", "d list").otherwise("c list"))
    listed = listed.withColumn("as_of_date", F.date_add(F.lit("2024-01-01").cast("date"), F.ascii(last)).cast("string"))
    return diagnostics.universe_facts(listed, panel.prices(spark, sf_dir).where("ticker < 'Brand#4'"))


@_query("eligibility_by_date", f"""{_BASE}, uni as ({panel.UNIVERSE_SQL}), a as (select ticker, date, nd, n, case when n >= 13 then avg(dv) {_o(13)} else 0 end as adv from y)
select d as signal_date, count(*) filter (where n >= 26) as history, count(*) filter (where adv >= 1) as liquid, count(*) filter (where n >= 26 and adv >= 1) as eligible
from a join sig on d >= date and (nd is null or d < nd) where ticker in (select ticker from uni where stock) group by 1""")
def _eligibility(spark, sf_dir):
    prices = panel.prices(spark, sf_dir)
    return diagnostics.eligibility(prices, panel.universe(spark, sf_dir), _dates(calendar.rebalance_dates(prices))[:-1], 26, 1.0, 13)


@_query("eligibility_summary", f"""{_BASE}, uni as ({panel.UNIVERSE_SQL}), a as (select ticker, date, nd, n, case when n >= 13 then avg(dv) {_o(13)} else 0 end as adv from y),
e as (select d as signal_date, count(*) filter (where n >= 26) as history, count(*) filter (where adv >= 1) as liquid, count(*) filter (where n >= 26 and adv >= 1) as eligible
from a join sig on d >= date and (nd is null or d < nd) where ticker in (select ticker from uni where stock) group by 1)
select min(eligible) as min_eligible, median(eligible) as median_eligible, arg_max(history, signal_date) as latest_history, arg_max(liquid, signal_date) as latest_liquid, arg_max(eligible, signal_date) as latest_eligible, max(signal_date) as signal_date from e""")
def _eligibility_summary(spark, sf_dir):
    return diagnostics.eligibility_summary(_eligibility(spark, sf_dir))


@_query("benchmark_gates", f"""with p as ({panel.BARS_SQL.format(ticker="p_brand", unit="week")}), last as (select max(date) as d from p where ticker = 'Brand#11')
select ticker, count(*) as n, max(date) as last, ticker in ('Brand#11', 'Brand#12', 'Brand#13') as benchmark from p, last where date <= d and (ticker not in ('Brand#11', 'Brand#12', 'Brand#13') or ticker in (select ticker from p, last where date = d)) group by 1""")
def _benchmark_gates(spark, sf_dir):
    """Stocks and benchmarks set apart, cut at the session that the first benchmark reaches; benchmarks that don't reach it go."""
    names = ["Brand#11", "Brand#12", "Brand#13"]
    rows = kept(panel.prices(spark, sf_dir), "panel")
    end = rows.where("ticker = 'Brand#11'").agg(F.max("date")).first()[0]
    stocks, bench = gates.parted(rows.where(F.col("date") <= F.lit(end)), names)
    bench, _ = gates.current_benchmarks(bench, names, end)
    both = stocks.withColumn("benchmark", F.lit(False)).unionByName(bench.withColumn("benchmark", F.lit(True)))
    return both.groupBy("ticker", "benchmark").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@_query("benchmark_first", f"""{_BASE}, {_PERIODS}, bench as ({panel.BENCHMARK_SQL}), s as (select date, adj_close, lead(date) over (order by date) as nx from bench)
select 'ALL' as ticker, p.period_start, p.period_end, round(b.adj_close / a.adj_close - 1, 6) as ret from periods p
join s a on a.date <= p.period_start and (a.nx is null or p.period_start < a.nx) join s b on b.date <= p.period_end and (b.nx is null or p.period_end < b.nx) where b.date > a.date""")
def _benchmark_first(spark, sf_dir):
    """Of two benchmarks the one that a comparison shows."""
    prices = kept(panel.prices(spark, sf_dir), "panel")
    dates = _dates(calendar.rebalance_dates(prices))
    periods = calendar.signal_periods(spark.createDataFrame([(d,) for d in dates], "date date"))
    one = portfolio.benchmark_returns(panel.benchmark(spark, sf_dir), "ALL", "All brands", periods, dates)
    late = portfolio.benchmark_returns(prices, "Brand#11", "One brand", periods.where("period >= 3"), dates)
    return comparison.benchmark_series(one.unionByName(late)).select("ticker", "period_start", "period_end", F.round("return", 6).alias("ret"))


@_query("benchmark_asof", f"""{_BASE}, {_PERIODS}, bench as ({panel.BENCHMARK_SQL}), s as (select date, adj_close, lead(date) over (order by date) as nx from bench)
select p.period_start, p.period_end, round(b.adj_close / a.adj_close - 1, 6) as ret, a.date as price_date_start, b.date as price_date_end from periods p
join s a on a.date <= p.period_start and (a.nx is null or p.period_start < a.nx) join s b on b.date <= p.period_end and (b.nx is null or p.period_end < b.nx) where b.date > a.date""")
def _benchmark(spark, sf_dir):
    schedule = calendar.rebalance_dates(panel.prices(spark, sf_dir))
    out = portfolio.benchmark_returns(panel.benchmark(spark, sf_dir), "ALL", "All brands", calendar.signal_periods(schedule), _dates(schedule))
    return out.select("period_start", "period_end", F.round("return", 6).alias("ret"), "price_date_start", "price_date_end")


@_query("price_coverage", f"""with p as ({panel.BARS_SQL.format(ticker='p_brand', unit='day')}), c as (select date, count(distinct ticker) as n from p group by 1), t as (select count(distinct ticker) as k from p),
ok as (select date, n from c, t order by n >= ceil(k * 0.9) desc, date desc limit 1), top as (select date, n from c order by date desc limit 1)
select ok.date as reference_date, ok.n as ticker_count, ok.n / k as coverage_ratio, top.date as max_date, top.n as max_date_count from ok, top, t""")
def _coverage(spark, sf_dir):
    return diagnostics.price_coverage(panel.prices(spark, sf_dir, "day"), 0.9)


# --- sources and sets


@_query("merge_prefer_first", f"""with a as (select * from ({panel.PRICES_SQL}) where ticker < 'Brand#3'), b as (select * from ({panel.PRICES_SQL}) where ticker >= 'Brand#2')
select ticker, date, adj_close, 'first' as src from a union all select ticker, date, adj_close, 'second' from b where (ticker, date) not in (select (ticker, date) from a)""")
def _merge(spark, sf_dir):
    rows = panel.prices(spark, sf_dir)
    merged = loaders.merge_prefer_first(rows.where("ticker < 'Brand#3'").withColumn("src", F.lit("first")), rows.where("ticker >= 'Brand#2'").withColumn("src", F.lit("second")))
    return merged.select("ticker", "date", "adj_close", "src")


@_query("failed_tickers_anti", "select distinct p_brand as ticker from part where p_brand not in (select p_brand from lineitem join part on l_partkey = p_partkey where l_quantity >= 50 and p_size % 7 = 0 and p_brand like '%2')")
def _failed(spark, sf_dir):
    asked = panel.universe(spark, sf_dir).select("ticker")
    got = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 50").join(spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size % 7 = 0 and p_brand like '%2'"), F.expr("l_partkey = p_partkey")).select(F.col("p_brand").alias("ticker"))
    return loaders.failed(asked, got)


@_query("universe_active", f"select ticker, market_cap from ({panel.UNIVERSE_SQL}) where stock")
def _active(spark, sf_dir):
    return panel.universe(spark, sf_dir).where(portfolio.is_stock()).select("ticker", "market_cap")


def _file(df: DataFrame, label: str) -> str:
    """A table as CSV in the shared folder; all its columns are text."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return path


_DAYS_SQL = f"select *, day(date) as d from ({panel.PRICES_SQL})"


@_query("csv_prices", f"""select ticker, date, case when d % 5 = 0 then close else open end as open, case when d % 4 = 0 then close else high end as high, low, close, case when d % 3 = 0 then close else adj_close end as adj_close, case when d % 6 = 0 then 0 else cast(floor(volume) as bigint) end as volume, 'fixture' as fetched_at
from ({_DAYS_SQL}) where d % 13 <> 0 and not (d % 11 = 0 and ticker like '%1')""")
def _csv_prices(spark, sf_dir):
    """Prices through a file with untidy tickers, times behind dates, words for numbers, gaps, NaN and blank tickers."""
    day = F.dayofmonth("date")
    text = lambda c: F.col(c).cast("string")
    rows = panel.prices(spark, sf_dir).select(
        F.when((day % 11 == 0) & F.col("ticker").endswith("1"), F.lit("  ")).when(day % 2 == 0, F.concat(F.lit(" "), F.lower("ticker"))).otherwise(F.col("ticker")).alias("ticker"), F.concat(text("date"), F.lit("T16:00:00")).alias("date"),
        F.when(day % 5 == 0, "n/a").otherwise(text("open")).alias("open"), F.when(day % 4 != 0, text("high")).alias("high"), text("low").alias("low"), text("close").alias("close"),
        F.when(day % 13 == 0, "NaN").when(day % 3 != 0, text("adj_close")).alias("adj_close"), F.when(day % 6 == 0, "-").otherwise(text("volume")).alias("volume"),
    )
    out = loaders.prices_csv(spark, _file(rows, "prices"))
    return out.select(F.concat(F.lit("Brand#"), F.substring("ticker", 7, 9)).alias("ticker"), "date", "open", "high", "low", "close", "adj_close", "volume", "fetched_at")


@_query("csv_universe", f"""select upper(ticker) as ticker, upper(ticker) as name, 'UNKNOWN' as exchange, 'stock' as asset_type, ticker not like '%2' and ticker not like '%3' as active, case when ticker not like '%4' then market_cap end as market_cap, 'unknown' as as_of_date from ({panel.UNIVERSE_SQL})""")
def _csv_universe(spark, sf_dir):
    last = F.right("ticker", F.lit(1))
    active = F.when(last == "1", "YES").when(last == "2", "no").when(last == "3", "maybe")
    rows = panel.universe(spark, sf_dir).select(F.concat("ticker", F.lit(" ")).alias("ticker"), active.alias("active"), F.when(last == "4", "big").otherwise(F.col("market_cap").cast("string")).alias("market_cap"))
    return loaders.universe_csv(spark, _file(rows, "universe")).select("ticker", "name", "exchange", "asset_type", "active", "market_cap", "as_of_date")


@_query("csv_fundamentals", f"select upper(ticker) as ticker, cast(available_at as date) as available_at, case when month(available_at) <> 5 then pe_ratio end as pe_ratio, cast(return_on_equity as double) as return_on_equity from ({panel.FUNDAMENTALS_SQL})")
def _csv_fundamentals(spark, sf_dir):
    rows = panel.fundamentals(spark, sf_dir).select(
        F.lower("ticker").alias("ticker"), F.col("available_at").cast("string").alias("available_at"), F.when(F.month("available_at") == 5, "none").otherwise(F.col("pe_ratio").cast("string")).alias("pe_ratio"), F.col("return_on_equity").cast("string").alias("return_on_equity")
    )
    return loaders.fundamentals_csv(spark, _file(rows, "fundamentals")).select("ticker", "available_at", "pe_ratio", "return_on_equity")


@_query("inferred_universe", f"select distinct ticker, ticker as name, 'stock' as asset_type, true as active, 'inferred_from_prices' as source from ({panel.PRICES_SQL})")
def _inferred(spark, sf_dir):
    return loaders.inferred_universe(panel.prices(spark, sf_dir)).select("ticker", "name", "asset_type", "active", "source")


@_query("chart_payloads", f"""select ticker, date, open, case when day(date) % 4 = 0 then close else high end as high, low, close, case when day(date) % 3 = 0 then close else adj_close end as adj_close, case when day(date) % 5 = 0 then 0 else cast(floor(volume) as bigint) end as volume
from (select ticker, date, open, high, low, case when day(date) % 7 = 0 then adj_close else close end as close, adj_close, volume from ({panel.PRICES_SQL}) where not (day(date) % 7 = 0 and day(date) % 3 = 0))""")
def _chart(spark, sf_dir):
    """Prices through chart payloads, a document of arrays for each ticker, with nulls in them and volumes below 0."""
    day = F.dayofmonth("date")
    bar = F.struct(
        "date", F.unix_date("date").cast("bigint").alias("d"), "open", F.when(day % 4 != 0, F.col("high")).alias("high"), "low", F.when(day % 7 != 0, F.col("close")).alias("close"), F.when(day % 5 == 0, -1.0).otherwise(F.col("volume")).alias("volume"), F.when(day % 3 != 0, F.col("adj_close")).alias("adj")
    )
    held = panel.prices(spark, sf_dir).groupBy("ticker").agg(F.sort_array(F.collect_list(bar)).alias("b"))
    column = lambda c: F.transform("b", lambda x: x[c])
    quote = F.struct(*(column(c).alias(c) for c in ("open", "high", "low", "close", "volume")))
    result = F.struct(F.transform("b", lambda x: x["d"] * 86_400 + 50_000).alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(column("adj").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    payload = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    out = loaders.chart_json(held.select("ticker", payload.alias("payload")))
    return out.select(F.concat(F.lit("Brand#"), F.substring("ticker", 7, 9)).alias("ticker"), "date", "open", "high", "low", "close", "adj_close", "volume")


@_query("replaced_histories", f"""with p as ({panel.PRICES_SQL}) select ticker, date, case when ticker like '%1' then 2 * adj_close else adj_close end as adj_close from p where ticker not like '%1' or date >= date '1996-01-01'""")
def _replaced(spark, sf_dir):
    """Histories of recovered tickers are replaced as a whole, however much of them was there."""
    rows = panel.prices(spark, sf_dir).select("ticker", "date", "adj_close")
    return loaders.replace_histories(rows, rows.where(F.col("ticker").endswith("1") & (F.col("date") >= "1996-01-01")).withColumn("adj_close", 2 * F.col("adj_close")))


@_query("safe_export", "select p_partkey, case p_partkey % 6 when 0 then chr(39) || '=' when 1 then chr(39) || '+' when 2 then chr(39) || '-' when 3 then chr(39) || '@' when 4 then ' ' else '' end || p_name as name from part")
def _safe(spark, sf_dir):
    """Texts that a spreadsheet would take for formulas, as exported."""
    sign = F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", " ", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(sign, "p_name").alias("name"))
    return rows.select("p_partkey", sinks.safe_text("name").alias("name"))


@_query("metrics_in_order", _SCORED + _METRICS.format(rows="returns") + _RNK.replace("select cast(row_number()", ", shown as (select cast(row_number()").replace("round(composite_score, 5) as composite_score", "composite_score") + "), kept as (select * from shown where factor <> 'f_vol') select m.factor, round(coalesce(k.composite_score, 0), 5) as composite_score, cast(row_number() over (order by k.rank nulls last, m.factor) as integer) as place from met m left join kept k on m.factor = k.factor")
def _in_order(spark, sf_dir):
    """Metrics with scores: in ranking order, 0 and last where a factor isn't ranked."""
    table = kept(metrics.metrics(_returns(spark, sf_dir)), "metrics")
    rows = metrics.with_scores(table, metrics.ranking(table).where("factor <> 'f_vol'")).collect()  # a row for each factor
    return spark.createDataFrame([(r.factor, round(r.composite_score, 5), i + 1) for i, r in enumerate(rows)], "factor string, composite_score double, place int")


@_query("winner_holdout", _SCORED + _HOLD + ", winner as (select factor from (" + _SCORED.replace("with prices as", "with prices as", 1) + _METRICS.format(rows="returns") + _RNK + ") where rank = 1)" + _METRICS.format(rows="tail") + _RNK.replace("select cast(row_number()", ", late as (select cast(row_number()") + ") select w.factor, l.rank as holdout_rank, round(m.cagr, 4) as holdout_cagr, round(m.sharpe, 4) as holdout_sharpe from winner w left join late l on w.factor = l.factor left join met m on w.factor = m.factor")
def _winner(spark, sf_dir):
    """The factor that ranks first, and how it does in the holdout."""
    returns = _returns(spark, sf_dir)
    late = metrics.ranking(metrics.metrics(metrics.holdout(returns)))
    out = metrics.winner_holdout(metrics.ranking(metrics.metrics(returns)), late)
    return out.select("factor", F.col("holdout_rank").cast("int").alias("holdout_rank"), F.round("holdout_cagr", 4).alias("holdout_cagr"), F.round("holdout_sharpe", 4).alias("holdout_sharpe"))


_query("backtest_scale", scale.SQL)(lambda s, d: scale.returns(s).select("factor", "period_start", "period_end", (F.round("return", 9) + F.lit(0.0)).alias("ret"), F.round("turnover", 9).alias("turnover"), "holdings_count"))

# a directory of symbols made of parts: their numbers give every kind of row that the screen tells apart
_KINDS = ("Common Stock", "Warrant", "ETF Trust", "Growth Fund", "Notes due", "Preferred A", "Units", "Rights", "American Depositary", "Ordinary Shares", "Acquisition Corp", "Convertible", "Common Stock", "Class A", "Common Stock")
_DIRECTORY_SQL = f"""select *, case p_partkey % {len(_KINDS)} {' '.join(f"when {i} then p_name || ' {k}'" for i, k in enumerate(_KINDS))} end as name,
  case when p_partkey % 31 = 0 then 'ABCDEF' when p_partkey % 37 = 0 then ' ' else chr(cast(65 + p_partkey % 26 as integer)) || chr(cast(65 + (p_partkey // 26) % 26 as integer)) || 'x' end as symbol,
  case when p_partkey % 19 = 0 then 'y' else 'N' end as etf, case when p_partkey % 23 = 0 then 'Y' end as test_issue, case when p_partkey % 29 = 0 then 'D' when p_partkey % 2 = 0 then 'N' end as financial_status, case when p_partkey % 41 = 0 then 'Y' else 'N' end as nextshares from part"""
_SCREEN_SQL = f"""with d as ({_DIRECTORY_SQL}), u as (select *, upper(trim(symbol)) as s, ' ' || upper(name) || ' ' as n from d),
w as (select *, case when s = '' or s in ('SPY') then 'benchmark_or_blank' when not regexp_matches(s, '^[A-Z]{{1,5}}$') then 'unsupported_symbol_format' when upper(etf) = 'Y' then 'etf' when test_issue = 'Y' then 'test_issue'
  when coalesce(financial_status, '') not in ('', 'N') then 'non_normal_financial_status' when nextshares = 'Y' then 'nextshares'
  {' '.join(f"when {' or '.join(f"contains(n, '{x}')" for x in parts)} then '{reason}'" for reason, parts in symbols.NAME_PARTS.items())}
  when not contains(n, 'COMMON STOCK') then 'not_common_stock_name' else '' end as reason from u)"""


def _directory(spark, sf_dir):
    key = F.col("p_partkey")
    letter = lambda n: F.char((65 + n % 26).cast("int"))
    name = F.concat("p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, _KINDS)), (key % len(_KINDS) + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        name.alias("name"), F.when(key % 31 == 0, "ABCDEF").when(key % 37 == 0, " ").otherwise(F.concat(letter(key), letter(F.floor(key / 26)), F.lit("x"))).alias("symbol"), F.when(key % 19 == 0, "y").otherwise("N").alias("etf"),
        F.when(key % 23 == 0, "Y").alias("test_issue"), F.when(key % 29 == 0, "D").when(key % 2 == 0, "N").alias("financial_status"), F.when(key % 41 == 0, "Y").otherwise("N").alias("nextshares"), F.lit(None).cast("string").alias("exchange"), F.lit("Q ").alias("category"),
    )


@_query("symbol_screen", f"{_SCREEN_SQL} select s as ticker, name, reason from w")
def _screen(spark, sf_dir):
    return _directory(spark, sf_dir).select(F.upper(F.trim("symbol")).alias("ticker"), "name", symbols.exclusion_reason(("SPY",)).alias("reason"))


@_query("symbol_exclusions", f"{_SCREEN_SQL} select reason, count(*) as n from w where reason <> '' group by 1")
def _exclusions(spark, sf_dir):
    return symbols.exclusion_counts(_directory(spark, sf_dir), ("SPY",))


@_query("symbol_universe", f"{_SCREEN_SQL} select s as ticker, trim(name) as name, 'Q' as exchange, 'stock' as asset_type, true as active, '2024-05-01' as as_of_date from w where reason = ''")
def _symbol_universe(spark, sf_dir):
    return symbols.accepted(_directory(spark, sf_dir), ("SPY",), "2024-05-01").select("ticker", "name", "exchange", "asset_type", "active", "as_of_date")
