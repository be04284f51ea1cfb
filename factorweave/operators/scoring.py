"""Factor scores: kernels at signal rows, point-in-time fundamentals, blends and ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import REGISTRY, Factor, validated, with_parts
from . import kernels


def signal_rows(rows: DataFrame, dates: list) -> DataFrame:
    """Of each ticker the last row on or before each signal date, with ``signal_date``: a row stands until the next.

    ``dates`` is a calendar: it is known to the driver and has a few hundred entries at most.
    """
    days = F.array(*(F.lit(d) for d in sorted(dates))) if dates else F.expr("cast(array() as array<date>)")
    until = F.lead("date").over(kernels.by_ticker())
    found = rows.withColumn("until", until).withColumn("signal_date", F.explode(F.filter(days, lambda d: (d >= F.col("date")) & (F.col("until").isNull() | (d < F.col("until"))))))
    return found.drop("until")


def fundamentals_asof(signals: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """``signals`` (ticker, signal_date) with the fields of the newest record available by then.

    One sorted pass over both: records and signals of a ticker in order of time, the last record carried
    on. No pair of rows is made, however many records a ticker has.
    """
    fields = [c for c in fundamentals.columns if c not in ("ticker", "as_of_date", "available_at")]
    known = fundamentals.where("available_at is not null")
    record = F.struct(*fields)
    left = known.select("ticker", F.col("available_at").alias("at"), F.col("as_of_date").alias("of"), F.lit(0).alias("side"), record.alias("record"))
    asked = signals.select("ticker", "signal_date").distinct()
    right = asked.select("ticker", F.col("signal_date").alias("at"), F.lit(None).cast("date").alias("of"), F.lit(1).alias("side"), F.lit(None).cast(left.schema["record"].dataType).alias("record"))
    order = Window.partitionBy("ticker").orderBy("at", "side", "of").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(right).withColumn("last", F.last("record", ignorenulls=True).over(order)).where("side = 1")
    found = carried.select("ticker", F.col("at").alias("signal_date"), *(F.col("last")[f].alias(f) for f in fields))
    return signals.join(found, ["ticker", "signal_date"], "left")


def _melted(wide: DataFrame, factors: list[Factor], pairs: dict[str, kernels.Pair]) -> DataFrame:
    rows = ", ".join(f"named_struct('factor', '{f.name}', 'score', cast({pairs[f.name][0].text} as double), 'reason', {pairs[f.name][1].text})" for f in factors)
    long = wide.select("ticker", "signal_date", F.expr(f"explode(array({rows}))").alias("x")).select("ticker", "signal_date", "x.*")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    reason = F.when(F.col("reason") != "", F.col("reason")).when(finite, "").otherwise(kernels.ERROR)
    return long.select("factor", "ticker", "signal_date", F.when(reason == "", F.col("score")).alias("score"), (reason == "").alias("eligible"), reason.alias("skip_reason"))


def base_scores(prices: DataFrame, dates: list, factors: list[Factor], fundamentals: DataFrame | None = None) -> DataFrame:
    """Scores of factors that aren't blends, in long form: one pass over the prices for all of them.

    Every frame that the factors need is made once; its aggregates and the factors are evaluated at signal rows alone.
    """
    frames = kernels.Frames()
    pairs = {f.name: kernels.kernel(f.kind, frames, **f.params) for f in factors}
    at = frames.aggregated(frames.at_signals(kernels.prepared(prices), dates))
    needed = sorted({f.params["field"] for f in factors if f.kind == "fundamental"})
    if needed:
        have = [n for n in needed if fundamentals is not None and n in fundamentals.columns]
        if have:
            at = fundamentals_asof(at, fundamentals.select("ticker", "as_of_date", "available_at", *have))
        at = at.withColumns({n: F.lit(None).cast("double") for n in needed if n not in have})
    return _melted(at, factors, pairs)


def blended(scores: DataFrame, blends: list[Factor]) -> DataFrame:
    """Scores of blends: the mean of the parts, each min-max normalised over all its eligible tickers of the date."""
    day = Window.partitionBy("factor", "signal_date")
    low, high = F.min("score").over(day), F.max("score").over(day)
    scaled = scores.withColumn("scaled", F.when(F.col("eligible"), F.when(high > low, (F.col("score") - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)))
    uses = F.explode(F.create_map(*(x for p in sorted({p for b in blends for p in b.parts}) for x in (F.lit(p), F.array(*(F.lit(b.name) for b in blends if p in b.parts)))))[F.col("factor")])
    sizes = F.create_map(*(x for b in blends for x in (F.lit(b.name), F.lit(len(b.parts)))))
    part = scaled.withColumn("blend", uses).groupBy("blend", "ticker", "signal_date").agg(F.count("scaled").alias("n"), F.avg("scaled").alias("mean"))
    whole = F.col("n") == sizes[F.col("blend")]
    return part.select(F.col("blend").alias("factor"), "ticker", "signal_date", F.when(whole, F.col("mean")).alias("score"), whole.alias("eligible"), F.when(whole, "").otherwise(kernels.IH).alias("skip_reason"))


def factor_scores(prices: DataFrame, dates: list, names: Iterable[str], fundamentals: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``factor, ticker, signal_date, score, rank, eligible, skip_reason`` of the named factors alone.

    ``keep`` stores a table and reads it back: with it all base factors, parts of blends among them, are computed in one pass.
    """
    names = validated(names)
    every = [REGISTRY[n] for n in with_parts(names)]
    base, blends = [f for f in every if f.kind != "composite"], [f for f in every if f.kind == "composite"]
    if blends and keep:
        every_base = keep(base_scores(prices, dates, base, fundamentals))
        return ranked(every_base.unionByName(blended(every_base.where(F.col("factor").isin(sorted({p for f in blends for p in f.parts}))), blends)).where(F.col("factor").isin(names)))
    scores = base_scores(prices, dates, [f for f in base if f.name in names], fundamentals)
    if blends:
        # a plan of their own for the parts: few of the factors, so few of the frames
        parts = {p for f in blends for p in f.parts}
        scores = scores.unionByName(blended(base_scores(prices, dates, [f for f in base if f.name in parts], fundamentals), blends))
    return ranked(scores.where(F.col("factor").isin(names)))


def ranked(scores: DataFrame) -> DataFrame:
    """Ranks 1..n of the eligible rows of a factor and date, by score down and ticker up."""
    order = Window.partitionBy("factor", "signal_date", "eligible").orderBy(F.desc("score"), "ticker")
    return scores.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order))).select("factor", "ticker", "signal_date", "score", "rank", "eligible", "skip_reason")


def rows_for(scores: DataFrame, factor: str, signal_date: object) -> DataFrame:
    """The rows of one factor and date."""
    return scores.where((F.col("factor") == factor) & (F.col("signal_date") == F.lit(signal_date)))


def factor_names(scores: DataFrame) -> list[str]:
    return [r.factor for r in scores.select("factor").distinct().orderBy("factor").collect()]  # one row for each factor
