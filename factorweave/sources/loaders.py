"""Loaders: CSV tables and chart JSON into typed DataFrames, merging of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def number(column: str | Column) -> Column:
    """A finite double, or null."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def ticker(column: str = "ticker") -> Column:
    return F.upper(F.trim(column))


def day(column: str) -> Column:
    return F.left(F.col(column).cast("string"), F.lit(10)).try_cast("date")


def _csv(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumns({n: F.lit(None).cast("string") for n in names if n not in raw.columns})


def last_of(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: the last by ``line``, a row's place in its file, and without such a column the greatest."""
    value = F.struct(*columns)
    best = F.max_by(value, F.struct("line", value)) if "line" in df.columns else F.max(value)
    return df.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed prices: rows without a ticker, a date or an adjusted close are dropped; ``line`` is a row's place in the file.

    Numbers that can't be read are missing: an adjusted close is the close then, unless the file says NaN.
    """
    raw = _csv(spark, path, ("ticker", "date", "open", "high", "low", "close", "adj_close", "volume", "source", "fetched_at"))
    close = number("close")
    rows = raw.select(
        ticker().alias("ticker"), day("date").alias("date"), *(F.coalesce(number(c), close).alias(c) for c in ("open", "high", "low")), close.alias("close"), F.when(~F.coalesce(F.isnan(F.col("adj_close").try_cast("double")), F.lit(False)), F.coalesce(number("adj_close"), close)).alias("adj_close"),
        F.coalesce(number("volume"), F.lit(0.0)).cast("bigint").alias("volume"), F.coalesce("source", F.lit(f"csv:{path.rstrip('/').rpartition('/')[2]}")).alias("source"), F.coalesce("fetched_at", F.lit("fixture")).alias("fetched_at"),
        F.monotonically_increasing_id().alias("line"),
    )
    return rows.where("ticker <> '' and date is not null and adj_close is not null")


def universe_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, ("ticker", "name", "exchange", "asset_type", "active", "market_cap", "sector", "source", "as_of_date"))
    text = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), d if isinstance(d, Column) else F.lit(d)).alias(c)
    said = F.lower(F.trim("active"))
    active = F.when(said.isNull() | (said == ""), True).otherwise(said.isin("1", "true", "yes", "y", "active"))
    return raw.select(ticker().alias("ticker"), text("name", ticker()), text("exchange", "UNKNOWN"), text("asset_type", "stock"), active.alias("active"), number("market_cap").alias("market_cap"), text("sector", "UNKNOWN"), text("source", f"csv:{path.rstrip('/').rpartition('/')[2]}"), text("as_of_date", "unknown"), F.monotonically_increasing_id().alias("line")).where("ticker <> ''")


def inferred_universe(prices: DataFrame) -> DataFrame:
    return prices.select("ticker").distinct().select("ticker", F.col("ticker").alias("name"), F.lit("UNKNOWN").alias("exchange"), F.lit("stock").alias("asset_type"), F.lit(True).alias("active"), F.lit(None).cast("double").alias("market_cap"), F.lit("UNKNOWN").alias("sector"), F.lit("inferred_from_prices").alias("source"), F.lit("unknown").alias("as_of_date"))


def fundamentals_csv(spark: SparkSession, path: str) -> DataFrame:
    """Point-in-time records; every further column is a numeric field."""
    raw = _csv(spark, path, ("ticker", "as_of_date", "available_at"))
    fields = [c for c in raw.columns if c not in ("ticker", "as_of_date", "available_at")]
    known = day("available_at")
    return raw.select(ticker().alias("ticker"), F.coalesce(day("as_of_date"), known).alias("as_of_date"), known.alias("available_at"), *(number(f).alias(f) for f in fields)).where("ticker <> ''")


def adjusted(prices: DataFrame) -> DataFrame:
    """Open, high, low and close on the scale of the adjusted close; rows without one stay as they are.

    A close that is not a positive number counts as the adjusted one; where the ratio of both is none, it is 1.
    Missing opens are closes, missing highs and lows the higher and the lower of open and close; a high below
    its low changes places with it. Nothing else moves a bar: high and low need not span open and close.
    """
    adj = number("adj_close")
    close = F.when(number("close") > 0, number("close")).otherwise(adj)
    ratio = F.when(close > 0, adj / F.nullif(close, F.lit(0.0)))
    ratio = F.when(ratio > 0, ratio).otherwise(1.0)
    first = number("open")
    high = F.coalesce(number("high"), F.when(first.isNull(), close).otherwise(F.greatest(first, close))) * ratio
    low = F.coalesce(number("low"), F.when(first.isNull(), close).otherwise(F.least(first, close))) * ratio
    new = {"open": F.coalesce(first, close) * ratio, "high": F.greatest(high, low), "low": F.least(high, low), "close": adj}
    return prices.withColumns({c: F.when(adj.isNull(), F.col(c)).otherwise(v) for c, v in new.items()})


def chart_json(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Chart payloads (ticker, payload) with columns of arrays into price rows."""
    kind = "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
    result = rows.select("ticker", F.get(F.from_json(column, kind)["chart"]["result"], F.lit(0)).alias("r")).where("r is not null")
    quote, adj = F.get(F.col("r.indicators.quote"), F.lit(0)), F.get(F.col("r.indicators.adjclose"), F.lit(0))
    parts = result.select("ticker", F.col("r.timestamp").alias("at"), *(quote[c].alias(c) for c in ("open", "high", "low", "close", "volume")), adj["adjclose"].alias("adj_close"))
    zipped = parts.select("ticker", F.explode(F.arrays_zip("at", "open", "high", "low", "close", "volume", "adj_close")).alias("x")).select("ticker", "x.*").withColumn("close", F.coalesce("close", "adj_close")).where("at is not null and close is not null")
    value = lambda c: F.coalesce(F.col(c), F.col("close")).alias(c)
    return zipped.select(ticker().alias("ticker"), F.timestamp_seconds("at").cast("date").alias("date"), value("open"), value("high"), value("low"), "close", value("adj_close"), F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0)).cast("bigint").alias("volume"))


def merge_prefer_first(*sources: DataFrame) -> DataFrame:
    """One row for each ticker and date, from the first source that has it."""
    rows = None
    for i, source in enumerate(sources):
        tagged = source.withColumn("source_order", F.lit(i))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    order = Window.partitionBy("ticker", "date").orderBy("source_order")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "source_order")


def replace_histories(rows: DataFrame, recovered: DataFrame) -> DataFrame:
    """Tickers of ``recovered`` lose all their rows in ``rows`` and get those."""
    return rows.join(recovered.select("ticker").distinct(), "ticker", "left_anti").unionByName(recovered, allowMissingColumns=True)


def failed(asked: DataFrame, got: DataFrame) -> DataFrame:
    return asked.select("ticker").distinct().join(got.select("ticker"), "ticker", "left_anti")
