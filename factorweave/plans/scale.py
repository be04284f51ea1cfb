"""A backtest of many factors over made-up scores: what a large run costs without making its scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, portfolio

FACTORS, PERIODS, TICKERS, TOP = 200, 60, 50, 10


def inputs(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, list[dt.date]]:
    """Scores, universe, prices and dates."""
    dates = [dt.date(2015 + i // 12, i % 12 + 1, 28) for i in range(PERIODS + 1)]
    day = F.element_at(F.array(*map(F.lit, dates)), (F.col("t") + 1).cast("int"))
    name = F.format_string("T%03d", F.col("k"))
    prices = spark.range((PERIODS + 1) * TICKERS).select((F.col("id") % TICKERS).alias("k"), F.floor(F.col("id") / TICKERS).alias("t"))
    price = 100 + 3 * F.col("k") + F.col("t") * (F.col("k") + 3) % 17
    prices = prices.select(name.alias("ticker"), day.alias("date"), price.cast("double").alias("adj_close"), F.lit(1000).cast("bigint").alias("volume"))
    rows = spark.range(FACTORS * PERIODS * TICKERS).select((F.col("id") % TICKERS).alias("k"), (F.floor(F.col("id") / TICKERS) % PERIODS).alias("t"), F.floor(F.col("id") / (TICKERS * PERIODS)).alias("f"))
    score = (F.col("f") * 7 + F.col("t") * 13 + F.col("k") * 17) % 101
    scores = rows.select(F.format_string("F%03d", F.col("f")).alias("factor"), name.alias("ticker"), day.alias("signal_date"), score.cast("double").alias("score"), F.lit(True).alias("eligible"), F.lit("").alias("skip_reason"))
    universe = spark.range(TICKERS).select(F.format_string("T%03d", F.col("id")).alias("ticker"), F.lit("stock").alias("asset_type"), F.lit(True).alias("active"), F.lit(1e10).alias("market_cap"))
    return scores, universe, prices, dates


def returns(spark: SparkSession) -> DataFrame:
    scores, universe, prices, dates = inputs(spark)
    periods = calendar.signal_periods(spark.createDataFrame([(d,) for d in dates], "date date"))
    return portfolio.backtest(scores, universe, prices, periods, dates, portfolio.Rules(top_n=TOP))["returns"]


SQL = f"""with k as (select range as k from range({TICKERS})), t as (select range as t from range({PERIODS + 1})), f as (select range as f from range({FACTORS})),
d as (select t, make_date(2015 + t // 12, t % 12 + 1, 28) as date from t), p as (select k, t, (100 + 3 * k + t * (k + 3) % 17)::double as price from k, t),
s as (select f, t, k, (f * 7 + t * 13 + k * 17) % 101 as score from f, t, k where t < {PERIODS}),
top as (select * from (select *, row_number() over (partition by f, t order by score desc, k) as place from s) where place <= {TOP}),
w as (select f, t, k, 1.0::double / {TOP} as weight from top),
g as (select f, w.t, sum(weight * (b.price / a.price - 1)) as ret, count(*) as n from w join p a on a.k = w.k and a.t = w.t join p b on b.k = w.k and b.t = w.t + 1 group by 1, 2),
m as (select coalesce(a.f, b.f) as f, coalesce(a.t, b.t + 1) as t, 0.5 * sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) as turnover from w a full join w b on a.f = b.f and a.k = b.k and a.t = b.t + 1 group by 1, 2)
select printf('F%03d', g.f) as factor, a.date as period_start, b.date as period_end, round(ret, 9) as ret, round(turnover, 9) as turnover, cast(n as integer) as holdings_count from g join d a on a.t = g.t join d b on b.t = g.t + 1 join m on m.f = g.f and m.t = g.t"""
