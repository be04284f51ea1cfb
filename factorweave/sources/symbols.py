"""Symbol directory screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reasons and, in this order, the parts of a name that give them.
NAME_PARTS = {
    "etf": (" ETF", "EXCHANGE TRADED", "ETF -"),
    "fund": (" FUND", "CLOSED-END", "MUTUAL FUND"),
    "etn_note_bond": (" ETN", "NOTE", "BOND", "DEBENTURE"),
    "preferred": ("PREFERRED", "PREFERENCE", "PREF ", "DEPOSITARY SHARES"),
    "unit": (" UNIT", "UNITS"),
    "warrant": ("WARRANT",),
    "right": (" RIGHT", "RIGHTS"),
    "adr_ads": ("AMERICAN DEPOSITARY", " ADR", " ADS"),
    "ordinary_or_foreign_share": ("ORDINARY SHARE", "COMMON SHARES"),
    "spac_or_blank_check": ("ACQUISITION CORP", "BLANK CHECK"),
    "convertible_or_certificate": ("CONVERTIBLE", "CERTIFICATE", "REDEEMABLE", "SUBORDINATED"),
}


def _flag(name: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(name), F.lit(""))))


def exclusion_reason(benchmarks: tuple[str, ...] = ()) -> Column:
    """Why a row (symbol, name, etf, test_issue, financial_status, nextshares) is left out; '' if it isn't."""
    symbol = _flag("symbol")
    name = F.concat(F.lit(" "), F.upper(F.coalesce("name", F.lit(""))), F.lit(" "))
    why = F.when((symbol == "") | symbol.isin(*benchmarks), "benchmark_or_blank").when(~symbol.rlike("^[A-Z]{1,5}$"), "unsupported_symbol_format")
    why = why.when(_flag("etf") == "Y", "etf").when(_flag("test_issue") == "Y", "test_issue").when(~_flag("financial_status").isin("", "N"), "non_normal_financial_status").when(_flag("nextshares") == "Y", "nextshares")
    for reason, parts in NAME_PARTS.items():
        found = F.lit(False)
        for part in parts:
            found = found | name.contains(part)
        why = why.when(found, reason)
    return why.when(~name.contains("COMMON STOCK"), "not_common_stock_name").otherwise("")


_COLUMNS = {"Symbol": "symbol", "ACT Symbol": "symbol", "Security Name": "name", "Exchange": "exchange", "Market Category": "category", "ETF": "etf", "Test Issue": "test_issue", "Financial Status": "financial_status", "NextShares": "nextshares"}
_FOOTER = "File Creation Time"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", "|").csv(path)
    rows = raw.withColumnsRenamed({k: v for k, v in _COLUMNS.items() if k in raw.columns})
    return rows.withColumns({c: F.lit(None).cast("string") for c in set(_COLUMNS.values()) - set(rows.columns)})


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a pipe-delimited directory file without its creation-time footer."""
    return _raw(spark, path).where(~F.coalesce(F.col("symbol"), F.lit("")).startswith(_FOOTER))


def creation_time(spark: SparkSession, path: str) -> str | None:
    """What the footer of a directory file says."""
    row = _raw(spark, path).where(F.col("symbol").startswith(_FOOTER)).select("symbol").first()
    return row.symbol.partition(":")[2].strip() if row else None


def accepted(directory: DataFrame, benchmarks: tuple[str, ...] = (), as_of: str | None = None, url: str = "") -> DataFrame:
    """The universe rows of the symbols that pass the screen."""
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = directory.where(exclusion_reason(benchmarks) == "")
    ticker = F.upper(F.trim("symbol"))
    return rows.select(
        ticker.alias("ticker"), F.coalesce(text("name"), ticker).alias("name"), F.coalesce(text("exchange"), text("category"), F.lit("UNKNOWN")).alias("exchange"), F.lit("stock").alias("asset_type"), F.lit(True).alias("active"),
        F.lit(None).cast("double").alias("market_cap"), F.lit("UNKNOWN").alias("sector"), F.lit("nasdaq_trader_symbol_directory_current_screen").alias("source"), F.coalesce(F.lit(as_of), F.current_date().cast("string")).alias("as_of_date"),
        F.coalesce(text("name"), F.lit("")).alias("security_name"), F.lit(url).alias("symbol_directory_url"),
    )


def exclusion_counts(directory: DataFrame, benchmarks: tuple[str, ...] = ()) -> DataFrame:
    return directory.select(exclusion_reason(benchmarks).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))
