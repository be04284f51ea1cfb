"""Scoring kernels: each kind gives a (score, reason) pair from windows over a ticker's rows.

Rows carry ``open, high, low, close, adj_close, volume``; ``prepared`` adds what the kernels share. A kernel
asks ``Frames`` for the windowed columns it needs; each is made once, however many factors use it, and
aggregates and kernels are evaluated at signal rows alone. All frames count rows, so every kernel uses the
one window of its ticker: one exchange and one sort serve them all. A reason of '' means that the score holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IH, IV, MISSING, ERROR = "insufficient_history", "insufficient_volume", "missing_fundamentals", "provider_error"


def by_ticker():
    """The window of a ticker's rows in order of time."""
    return Window.partitionBy("ticker").orderBy("date")


class Sql:
    """SQL text that combines like a column. Hundreds of kernels are built as text and parsed once, instead of node by node over the gateway."""

    __slots__ = ("text",)
    __hash__ = None

    def __init__(self, text: str):
        self.text = text

    @staticmethod
    def of(value: object) -> str:
        if isinstance(value, Sql):
            return value.text
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, float):
            return f"{value!r}D"
        return str(value) if isinstance(value, int) else "'" + str(value) + "'"

    def _with(self, sign: str, other: object, turned: bool = False) -> Sql:
        a, b = Sql.of(self), Sql.of(other)
        return Sql(f"({b} {sign} {a})" if turned else f"({a} {sign} {b})")

    def __add__(self, other: object) -> Sql:
        return self._with("+", other)

    def __sub__(self, other: object) -> Sql:
        return self._with("-", other)

    def __rsub__(self, other: object) -> Sql:
        return self._with("-", other, True)

    def __mul__(self, other: object) -> Sql:
        return self._with("*", other)

    def __truediv__(self, other: object) -> Sql:
        return self._with("/", other)

    def __gt__(self, other: object) -> Sql:
        return self._with(">", other)

    def __ge__(self, other: object) -> Sql:
        return self._with(">=", other)

    def __eq__(self, other: object) -> Sql:  # type: ignore[override]
        return self._with("=", other)

    def __and__(self, other: object) -> Sql:
        return self._with("and", other)

    def __rand__(self, other: object) -> Sql:
        return self._with("and", other, True)

    def __neg__(self) -> Sql:
        return Sql(f"(-{self.text})")

    def __invert__(self) -> Sql:
        return Sql(f"(not {self.text})")

    def __getitem__(self, field: str) -> Sql:
        return Sql(f"{self.text}.{field}")

    def known(self) -> Sql:
        return Sql(f"({self.text} is not null)")


def case(*branches: tuple[object, object], otherwise: object = None) -> Sql:
    body = " ".join(f"when {Sql.of(c)} then {Sql.of(v)}" for c, v in branches)
    return Sql(f"(case {body}{'' if otherwise is None else f' else {Sql.of(otherwise)}'} end)")


def column(name: str) -> Sql:
    return Sql(f"`{name}`")


Pair = tuple[Sql, Sql]


def frame(first: int, last: int = 0):
    return by_ticker().rowsBetween(first, last)


def trailing(n: int):
    return frame(1 - n)


#: Series that kernels ask to be whole in a frame; ``prepared`` counts their values from the first row on.
COUNTED = ("r", "rng", "gap", "day", "dv_change", "traded")


def prepared(prices: DataFrame) -> DataFrame:
    """``prices`` with the row number ``n`` and the series that kernels read; NaN counts as missing."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("open", "high", "low", "close", "adj_close")}
    df = prices.withColumns(clean).withColumn("c", F.col("adj_close"))
    df = df.withColumns({"high": F.coalesce("high", "c"), "low": F.coalesce("low", "c"), "close": F.coalesce("close", "c"), "open": F.coalesce("open", "c")})
    before, shut = F.lag("c").over(by_ticker()), F.lag("close").over(by_ticker())
    df = df.withColumns({"n": F.row_number().over(by_ticker()), "dv": F.coalesce(F.col("volume").cast("double"), F.lit(0.0)) * F.col("c"), "r": F.when(before > 0, F.col("c") / before - 1), "gap": F.when(shut > 0, F.col("open") / shut - 1)})
    old, returned = F.lag("dv").over(by_ticker()), F.col("r").isNotNull()
    df = df.withColumns(
        {
            "dv_change": F.when(old > 0, F.col("dv") / old - 1),
            "day": F.when(F.col("open") > 0, F.col("close") / F.col("open") - 1),
            "rng": F.when((F.col("c") > 0) & (F.col("high") >= F.col("low")), (F.col("high") - F.col("low")) / F.col("c")),
            "traded": F.when(F.col("dv") > 0, F.lit(1)),
            "path": F.abs("r"),
            "cost": F.abs("r") / F.nullif("dv", F.lit(0.0)),
            # least and greatest skip nulls, so a missing return needs its own test
            "down": F.when(returned, F.least("r", F.lit(0.0))),
            "up": F.when(returned, F.greatest("r", F.lit(0.0))),
            "rose": F.when(returned, (F.col("r") > 0).cast("double")),
        }
    )
    return df.withColumns({f"count_{c}": F.count(c).over(frame(Window.unboundedPreceding)) for c in COUNTED})


#: Kept series that may lack values in a frame that counts: their frames leave those out.
GAPPY = ("c", "high", "low", "dv", "path")


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Over an array ``a`` of doubles. Deviations are from a mean taken as an offset from the first value: of equal values all are 0.
_SUM = "aggregate(a, 0D, (s, v) -> s + v)"
_MEAN = f"{_SUM} / nullif(size(a), 0)"
_CENTRE = "get(a, 0) + aggregate(a, 0D, (s, v) -> s + (v - get(a, 0))) / nullif(size(a), 0)"
_M2, _M3, _M4 = (f"aggregate(a, 0D, (s, v) -> s + {' * '.join(['(v - m)'] * k)}) / nullif(size(a), 0)" for k in (2, 3, 4))


class Frames:
    """The windowed columns that kernels ask for, by name; the same request gives the same column.

    Lags and counts are window functions, which cost the same at any width. An aggregate of a frame costs its
    width in every row, so it is taken at signal rows alone, from slices of one array of a ticker's rows.
    """

    def __init__(self) -> None:
        self.lags: dict[str, Column] = {}
        self.aggregates: dict[str, Column] = {}
        self.series: set[str] = set()
        self.longest = 0

    def now(self, name: str) -> Sql:
        if f"now_{name}" not in self.lags:
            self.lags[f"now_{name}"] = F.col(name).alias(f"now_{name}")
        return column(f"now_{name}")

    def lag(self, name: str, k: int) -> Sql:
        if not k:
            return self.now(name)
        own = f"lag_{name}_{k}"
        if own not in self.lags:
            self.lags[own] = F.lag(name, k).over(by_ticker()).alias(own)
        return column(own)

    def full(self, name: str, w: int) -> Sql:
        """Whether the last ``w`` rows all have a value."""
        return self.now(f"count_{name}") - Sql(f"coalesce({self.lag(f'count_{name}', w).text}, 0)") == w

    def rows(self, w: int) -> Sql:
        return self.now("n") >= w

    def _values(self, column: str, w: int, skip: int = 0) -> str:
        """SQL for a frame's values in order of time: ``w`` rows that end ``skip`` rows back, fewer at a ticker's start."""
        self.longest = max(self.longest, w + skip)
        self.series.add(column)
        first = f"greatest(size({column}_trail) - {w + skip}, 0)"
        found = f"slice({column}_trail, {first} + 1, greatest(size({column}_trail) - {skip} - {first}, 0))"
        return f"array_compact({found})" if column in GAPPY else found

    def _once(self, name: str, sql: str) -> Sql:
        if name not in self.aggregates:
            self.aggregates[name] = F.expr(sql)
        return column(name)

    def least(self, column: str, w: int) -> Sql:
        return self._once(f"min_{column}_{w}", f"array_min({self._values(column, w)})")

    def most(self, column: str, w: int, skip: int = 0) -> Sql:
        return self._once(f"max_{column}_{w}_{skip}", f"array_max({self._values(column, w, skip)})")

    def total(self, column: str, w: int) -> Sql:
        return self._once(f"sum_{column}_{w}", _let(self._values(column, w), "a", _SUM))

    def mean(self, column: str, w: int, skip: int = 0) -> Sql:
        return self._once(f"mean_{column}_{w}_{skip}", _let(self._values(column, w, skip), "a", _MEAN))

    def worst(self, column: str, w: int, k: int) -> Sql:
        """The mean of the ``k`` smallest values."""
        return self._once(f"worst_{column}_{w}_{k}", _let(f"slice(array_sort({self._values(column, w)}), 1, {k})", "a", _MEAN))

    def spread(self, column: str, w: int, skip: int = 0) -> Sql:
        """The population standard deviation."""
        return self._once(f"spread_{column}_{w}_{skip}", _let(self._values(column, w, skip), "a", _let(_CENTRE, "m", f"sqrt({_M2})")))

    def shape(self, column: str, w: int) -> Sql:
        """A struct of the second to fourth central moments."""
        return self._once(f"shape_{column}_{w}", _let(self._values(column, w), "a", _let(_CENTRE, "m", f"named_struct('m2', {_M2}, 'm3', {_M3}, 'm4', {_M4})")))

    def covariance(self, x: str, y: str, w: int) -> Sql:
        """The population covariance."""
        a, b = self._values(x, w), self._values(y, w)
        means = _let(a, "a", _let(b, "b", _let(_MEAN, "m", _let(_MEAN.replace("(a,", "(b,").replace("(a)", "(b)"), "k", "aggregate(zip_with(a, b, (p, q) -> (p - m) * (q - k)), 0D, (s, v) -> s + v) / nullif(size(a), 0)"))))
        return self._once(f"cov_{x}_{y}_{w}", means)

    def at_signals(self, rows: DataFrame, dates: list) -> DataFrame:
        """``ticker, signal_date``, lags and, if an aggregate needs them, the trailing rows, at signal rows alone.

        A row stands for the dates from its own to the next row's. Each ticker's series become one array, as long as its
        history; of that only the slices that end at signal rows are made.
        """
        names = list(self.lags)
        days = F.array(*(F.lit(d) for d in sorted(dates))) if dates else F.expr("cast(array() as array<date>)")
        until = F.lead("date").over(by_ticker())
        wide = rows.select("ticker", "date", "n", *self.lags.values(), *(F.col(c).alias(f"row_{c}") for c in sorted(self.series)), until.alias("until"))
        wide = wide.withColumn("signals", F.filter(days, lambda d: (d >= F.col("date")) & (F.col("until").isNull() | (d < F.col("until")))))
        if not self.longest:
            return wide.select("ticker", F.explode("signals").alias("signal_date"), *names)
        mark = F.when(F.size("signals") > 0, F.struct("n", "signals", F.struct(*names).alias("lags") if names else F.lit(None).cast("int").alias("lags")))
        row = F.struct("date", F.struct(*(F.col(f"row_{c}").alias(c) for c in sorted(self.series))).alias("row"))
        held = wide.groupBy("ticker").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.collect_list(mark).alias("marks"))
        w = F.lit(self.longest)
        ends = F.transform("marks", lambda m: F.struct(m.alias("mark"), F.slice(F.col("rows"), F.greatest(m["n"] - w + 1, F.lit(1)), F.least(m["n"], w)).alias("part")))
        cut = held.select("ticker", F.explode(ends).alias("x")).select("ticker", F.explode("x.mark.signals").alias("signal_date"), F.col("x.mark.lags").alias("lags"), F.transform("x.part", lambda r: r["row"]).alias("trail"))
        return cut.select("ticker", "signal_date", *(F.col("lags")[c].alias(c) for c in names), "trail")

    def aggregated(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the aggregates in place of the trailing rows."""
        if not self.longest:
            return rows
        # a transform, not a field access: the optimizer would repeat that inside every aggregate
        apart = rows.select("*", *(F.expr(f"transform(trail, t -> t.{c})").alias(f"{c}_trail") for c in sorted(self.series))).drop("trail")
        return apart.withColumns(self.aggregates).drop(*(f"{c}_trail" for c in self.series))


def given(ok: Sql, score: Sql, reason: str = IH) -> Pair:
    good = Sql(f"coalesce({ok.text}, false)")
    return case((good, score)), case((good, ""), otherwise=reason)


def _ratio(a: Sql, b: Sql) -> Sql:
    return Sql(f"({a.text} / nullif({b.text}, 0.0D))")


def momentum(at: Frames, lookback: int, skip: int = 0) -> Pair:
    start = at.lag("c", lookback)
    return given((start > 0) & (skip < lookback), _ratio(at.lag("c", skip), start) - 1)


def reversal(at: Frames, lookback: int) -> Pair:
    score, reason = momentum(at, lookback)
    return -score, reason


def volatility(at: Frames, window: int, measure: str = "total") -> Pair:
    if measure == "range":
        return given(at.full("rng", window), -at.mean("rng", window))
    return given(at.full("r", window), -at.spread({"total": "r", "downside": "down", "upside": "up"}[measure], window))


def return_skew(at: Frames, window: int) -> Pair:
    m = at.shape("r", window)
    return given(at.full("r", window) & (m["m2"] > 0), _ratio(m["m3"], Sql(f"power({m['m2'].text}, 1.5D)")))


def return_kurtosis(at: Frames, window: int) -> Pair:
    m = at.shape("r", window)
    return given(at.full("r", window) & (m["m2"] > 0), 3 - _ratio(m["m4"], m["m2"] * m["m2"]))


def tail_loss(at: Frames, window: int) -> Pair:
    k = max(1, math.ceil(0.10 * window))
    return given(at.full("r", window), at.worst("r", window, k))


def trend_efficiency(at: Frames, window: int) -> Pair:
    start = at.lag("c", window)
    net = _ratio(_ratio(at.now("c"), start) - 1, at.total("path", window))
    return given(start > 0, Sql(f"coalesce({net.text}, 0.0D)"))


def return_consistency(at: Frames, window: int) -> Pair:
    return given(at.full("r", window), at.mean("rose", window))


def risk_adjusted_momentum(at: Frames, lookback: int, skip: int, vol_window: int) -> Pair:
    score, reason = momentum(at, lookback, skip)
    spread = at.spread("r", vol_window)
    return given((reason == "") & at.full("r", vol_window) & (spread > 0), _ratio(score, spread))


def liquidity(at: Frames, window: int) -> Pair:
    return given(at.rows(window), at.mean("dv", window))


def illiquidity(at: Frames, window: int) -> Pair:
    enough, traded = at.full("r", window), at.full("traded", window)
    return case((enough & traded, -at.mean("cost", window) * 1e6)), case((~enough, IH), (~traded, IV), otherwise="")


def volume_trend(at: Frames, short: int, long: int) -> Pair:
    enough, base = at.rows(long), at.mean("dv", long)
    return case((enough & (base > 0), _ratio(at.mean("dv", short), base) - 1)), case((~enough, IH), (base > 0, ""), otherwise=IV)


def volume_shock(at: Frames, short: int, long: int) -> Pair:
    if short >= long:
        return NONE, Sql(Sql.of(IH))
    mean, spread = at.mean("dv", long - short, short), at.spread("dv", long - short, short)
    enough, traded, recent = at.rows(long), at.full("traded", long), at.mean("dv", short)
    score = case((spread > 0, _ratio(recent - mean, spread)), otherwise=_ratio(recent, mean) - 1)
    return case((enough & traded, score)), case((~enough, IH), (~traded, IV), otherwise="")


def price_volume_corr(at: Frames, window: int) -> Pair:
    # deviations from paired rows only: both series must be whole in the frame
    score = _ratio(at.covariance("r", "dv_change", window), at.spread("r", window) * at.spread("dv_change", window))
    enough, traded, whole = at.rows(window + 1), at.full("dv_change", window), at.full("r", window)
    return case((enough & traded & whole, score)), case((~enough, IH), (~traded, IV), (whole & score.known(), ""), otherwise=IH)


def moving_average_gap(at: Frames, window: int) -> Pair:
    mean = at.mean("c", window)
    return given(at.rows(window) & (mean > 0), _ratio(at.now("c"), mean) - 1)


def moving_average_cross(at: Frames, short: int, long: int) -> Pair:
    mean = at.mean("c", long)
    return given(at.rows(long) & (mean > 0), _ratio(at.mean("c", short), mean) - 1)


def range_position(at: Frames, window: int) -> Pair:
    low, high = at.least("low", window), at.most("high", window)
    return given(at.rows(window) & (high > low), _ratio(at.now("c") - low, high - low))


def drawdown_high(at: Frames, window: int) -> Pair:
    high = at.most("c", window)
    return given(at.rows(window) & (high > 0), _ratio(at.now("c"), high) - 1)


def breakout_strength(at: Frames, window: int) -> Pair:
    high = at.most("high", window, 1)
    return given(at.rows(window + 1) & (high > 0), _ratio(at.now("c"), high) - 1)


def range_contraction(at: Frames, short: int, long: int) -> Pair:
    base = at.mean("rng", long)
    return given(at.rows(long) & at.full("rng", long) & (base > 0), -(_ratio(at.mean("rng", short), base) - 1))


def overnight_return(at: Frames, window: int) -> Pair:
    return given(at.rows(window + 1) & at.full("gap", window), at.mean("gap", window))


def intraday_return(at: Frames, window: int) -> Pair:
    return given(at.full("day", window), at.mean("day", window))


def acceleration(at: Frames, short: int, long: int, skip: int = 0) -> Pair:
    (a, why_a), (b, why_b) = momentum(at, short, skip), momentum(at, long, skip)
    return given((why_a == "") & (why_b == ""), a - b)


def fundamental(at: Frames, field: str, direction: str) -> Pair:
    """From the as-of column that scoring attaches; a lower value is better only if it is above 0."""
    value = column(field)
    ok = value.known() & Sql(f"(not isnan({value.text}))")
    return given(ok & (value > 0), -value, MISSING) if direction == "negative" else given(ok, value, MISSING)


NONE = Sql("cast(null as double)")

KERNELS: dict[str, Callable[..., Pair]] = {
    k.__name__: k
    for k in (
        momentum, reversal, volatility, return_skew, return_kurtosis, tail_loss, trend_efficiency, return_consistency, risk_adjusted_momentum, liquidity, illiquidity, volume_trend,
        volume_shock, price_volume_corr, moving_average_gap, moving_average_cross, range_position, drawdown_high, breakout_strength, range_contraction, overnight_return, intraday_return, acceleration, fundamental,
    )
}


def kernel(kind: str, at: Frames, **params) -> Pair:
    """The pair of a kind; unknown kinds report an error in every row."""
    if kind not in KERNELS:
        return NONE, Sql(Sql.of(ERROR))
    return KERNELS[kind](at, **params)
