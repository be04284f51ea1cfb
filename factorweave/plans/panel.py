"""A price panel, universe, fundamentals and benchmark derived from order lines: brands are tickers, weeks are sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lines: DataFrame, unit: str) -> DataFrame:
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    money = F.col("l_extendedprice").cast("decimal(18,2)")
    kept = F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast("decimal(3,2)")
    return lines.groupBy("ticker", F.date_trunc(unit, "l_shipdate").cast("date").alias("date")).agg(
        F.min_by(unit_price, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("open"),
        F.max(unit_price).alias("high"),
        F.min(unit_price).alias("low"),
        (F.sum(money).cast("double") / F.sum("l_quantity")).alias("close"),
        (F.sum(money * kept).cast("double") / F.sum("l_quantity")).alias("adj_close"),
        F.sum("l_quantity").alias("volume"),
    )


def prices(spark: SparkSession, sf_dir: str, unit: str = "week", by: str = "p_brand") -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(by).alias("ticker"))
    return _bars(_table(spark, sf_dir, "lineitem").join(part, "l_partkey"), unit)


def benchmark(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """All brands together, with a bar at the start of each month only: it needs an as-of lookup."""
    return _bars(_table(spark, sf_dir, "lineitem").withColumn("ticker", F.lit("ALL")), unit)


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double")
    dim = _table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(cap.alias("market_cap"))
    return dim.select("ticker", F.lit("stock").alias("asset_type"), (~F.col("ticker").like("%5")).cast("string").alias("active"), "market_cap")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly sums of a brand, available 45 days after the quarter."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    quarter = F.date_trunc("quarter", "l_shipdate").cast("date")
    sums = _table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy("ticker", quarter.alias("q")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("pe_ratio"), F.sum("l_quantity").alias("return_on_equity"))
    end = F.date_sub(F.add_months("q", 3), 1)
    return sums.select("ticker", end.alias("as_of_date"), F.date_add(end, 45).alias("available_at"), "pe_ratio", "return_on_equity")


BARS_SQL = """select {ticker} as ticker, cast(date_trunc('{unit}', l_shipdate) as date) as date,
  min_by(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) as open, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / sum(l_quantity) as close,
  cast(sum(cast(l_extendedprice as decimal(18,2)) * (cast(1 as decimal(3,2)) - cast(l_discount as decimal(3,2)))) as double) / sum(l_quantity) as adj_close,
  sum(l_quantity) as volume
  from lineitem l join part p on l.l_partkey = p.p_partkey group by 1, 2"""
PRICES_SQL = BARS_SQL.format(ticker="p_brand", unit="week")
BENCHMARK_SQL = BARS_SQL.format(ticker="'ALL'", unit="month")
UNIVERSE_SQL = "select p_brand as ticker, p_brand not like '%5' as stock, cast(sum(cast(p_retailprice as decimal(18,2))) as double) as market_cap from part group by 1, 2"
FUNDAMENTALS_SQL = """select p_brand as ticker, cast(date_trunc('quarter', l_shipdate) as date) + interval 3 month - interval 1 day + interval 45 day as available_at,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as pe_ratio, sum(l_quantity) as return_on_equity
  from lineitem l join part p on l.l_partkey = p.p_partkey group by 1, 2"""
