"""The factor registry: families of parameter grids, expanded in a fixed order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Factor:
    name: str
    kind: str
    category: str
    params: dict = field(default_factory=dict, hash=False)
    needs: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    @property
    def description(self) -> str:
        told = ", ".join(f"{k} {v}" for k, v in self.params.items()) or " + ".join(self.parts)
        return f"{self.kind.replace('_', ' ')}: {told}"


@dataclass(frozen=True)
class Family:
    """A name pattern over a grid; a tuple of names in an axis key is stepped through together."""

    pattern: str
    kind: str
    category: str
    axes: dict

    def factors(self) -> Iterable[Factor]:
        for values in product(*self.axes.values()):
            params: dict = {}
            for key, value in zip(self.axes, values, strict=True):
                params |= dict(zip(key, value, strict=True)) if isinstance(key, tuple) else {key: value}
            if params.get("skip", 0) >= params.get("lookback", 10**9) or "ma_cross" in self.pattern and params["short"] >= params["long"]:
                continue
            yield Factor(self.pattern.format(**params), self.kind, self.category, params)


# Grids, names and blends that results are compared by.
_FIVE = (21, 42, 63, 126, 252)
_SIX = (10, 21, 42, 63, 126, 252)
_FAMILIES = (
    (Family("mom_{lookback}d_skip_{skip}d", "momentum", "momentum", {"lookback": (21, 42, 63, 84, 105, 126, 168, 189, 210, 252, 315, 378, 504, 756), "skip": (0, 5, 10, 21, 42, 63)}),),
    (Family("reversal_{lookback}d", "reversal", "reversal", {"lookback": (3, 5, 10, 21, 42, 63)}),),
    (Family("vol_{measure}_{window}d", "volatility", "risk", {"window": (10, 21, 42, 63, 84, 126, 189, 252), "measure": ("total", "downside", "upside", "range")}),),
    (
        Family("skew_{window}d", "return_skew", "distribution", {"window": _FIVE}),
        Family("kurtosis_low_{window}d", "return_kurtosis", "distribution", {"window": _FIVE}),
        Family("tail_loss_{window}d", "tail_loss", "tail", {"window": _FIVE}),
        Family("trend_efficiency_{window}d", "trend_efficiency", "trend_quality", {"window": _FIVE}),
        Family("return_consistency_{window}d", "return_consistency", "trend_quality", {"window": _FIVE}),
    ),
    (Family("ramom_{lookback}d_skip_{skip}d_vol_{vol_window}d", "risk_adjusted_momentum", "risk_adjusted_momentum", {"lookback": (63, 84, 126, 168, 252, 378, 504), "skip": (0, 21, 42), "vol_window": (21, 63, 126)}),),
    (Family("dvol_avg_{window}d", "liquidity", "liquidity", {"window": _SIX}), Family("amihud_illiq_{window}d", "illiquidity", "liquidity", {"window": _SIX})),
    (
        Family("dvol_trend_{short}d_{long}d", "volume_trend", "liquidity", {("short", "long"): ((10, 63), (21, 63), (21, 126), (42, 126), (63, 252))}),
        Family("dvol_shock_{short}d_{long}d", "volume_shock", "liquidity", {("short", "long"): ((10, 63), (21, 63), (21, 126), (42, 126), (63, 252))}),
    ),
    (Family("price_volume_corr_{window}d", "price_volume_corr", "accumulation", {"window": _FIVE}),),
    (Family("ma_gap_{window}d", "moving_average_gap", "trend", {"window": (10, 20, 30, 50, 100, 150, 200)}),),
    (Family("ma_cross_{short}d_{long}d", "moving_average_cross", "trend", {"short": (5, 10, 20, 50), "long": (50, 100, 150, 200)}),),
    (Family("range_pos_{window}d", "range_position", "trend", {"window": _FIVE}), Family("breakout_{window}d", "breakout_strength", "trend", {"window": _FIVE})),
    (Family("range_contraction_{short}d_{long}d", "range_contraction", "risk", {("short", "long"): ((5, 21), (10, 42), (21, 63), (42, 126), (63, 252))}),),
    (
        Family("overnight_return_{window}d", "overnight_return", "intraday", {"window": (5, 21, 42, 63, 126)}),
        Family("intraday_return_{window}d", "intraday_return", "intraday", {"window": (5, 21, 42, 63, 126)}),
        Family("drawdown_high_{window}d", "drawdown_high", "trend", {"window": (5, 21, 42, 63, 126)}),
    ),
    (Family("accel_{short}d_{long}d_skip_{skip}d", "acceleration", "momentum", {("short", "long"): ((21, 63), (21, 126), (42, 126), (63, 252), (126, 504)), "skip": (0, 21)}),),
)
_FUNDAMENTALS = {
    "value_pe": ("value", "pe_ratio", "negative"),
    "quality_roe": ("quality", "return_on_equity", "positive"),
    "value_pb": ("value", "price_to_book", "negative"),
    "value_ps": ("value", "price_to_sales", "negative"),
    "value_fcf_yield": ("value", "free_cash_flow_yield", "positive"),
    "quality_margin": ("quality", "profit_margin", "positive"),
    "quality_debt_to_equity": ("quality", "debt_to_equity", "negative"),
    "growth_revenue": ("growth", "revenue_growth", "positive"),
}
_BLENDS = {
    "composite_defensive": ("momentum_6m", "low_volatility", "liquidity"),
    "blend_mom126_lowvol63_liq63": ("mom_126d_skip_21d", "vol_total_63d", "dvol_avg_63d"),
    "blend_mom252_lowvol126_liq126": ("mom_252d_skip_21d", "vol_total_126d", "dvol_avg_126d"),
    "blend_ramom126_trend50_liq63": ("ramom_126d_skip_21d_vol_63d", "ma_gap_50d", "dvol_avg_63d"),
    "blend_ramom252_trend200_liq126": ("ramom_252d_skip_21d_vol_126d", "ma_gap_200d", "dvol_avg_126d"),
    "blend_reversal21_lowvol63_liq63": ("reversal_21d", "vol_total_63d", "dvol_avg_63d"),
    "blend_range63_mom126_lowvol63": ("range_pos_63d", "mom_126d_skip_21d", "vol_total_63d"),
    "blend_drawdown126_mom252_lowvol126": ("drawdown_high_126d", "mom_252d_skip_21d", "vol_total_126d"),
    "blend_accel21_126_ramom126_liq63": ("accel_21d_126d_skip_0d", "ramom_126d_skip_21d_vol_63d", "dvol_avg_63d"),
    "blend_mom63_vol21_dvol21": ("mom_63d_skip_0d", "vol_total_21d", "dvol_avg_21d"),
    "blend_mom504_lowvol252_liq252": ("mom_504d_skip_21d", "vol_total_252d", "dvol_avg_252d"),
}


def _fundamental(name: str) -> Factor:
    category, column, direction = _FUNDAMENTALS[name]
    return Factor(name, "fundamental", category, {"field": column, "direction": direction}, (column,))


def _blend(name: str) -> Factor:
    return Factor(name, "composite", "composite", parts=_BLENDS[name])


CORE = (
    Factor("momentum_12_1", "momentum", "momentum", {"lookback": 252, "skip": 21}),
    Factor("momentum_6m", "momentum", "momentum", {"lookback": 126, "skip": 21}),
    Factor("low_volatility", "volatility", "risk", {"window": 126, "measure": "total"}),
    Factor("short_reversal", "reversal", "reversal", {"lookback": 21}),
    Factor("risk_adjusted_momentum", "risk_adjusted_momentum", "risk_adjusted_momentum", {"lookback": 126, "skip": 21, "vol_window": 126}),
    Factor("liquidity", "liquidity", "liquidity", {"window": 63}),
    _fundamental("value_pe"),
    _fundamental("quality_roe"),
    _blend("composite_defensive"),
)


def _registry() -> dict[str, Factor]:
    found = {f.name: f for f in CORE}
    for group in _FAMILIES:
        # families of one group alternate, as their grids go along together
        for row in zip(*(tuple(f.factors()) for f in group), strict=True):
            found |= {f.name: f for f in row if f.name not in found}
    found |= {n: _fundamental(n) for n in _FUNDAMENTALS if n not in found}
    return found | {n: _blend(n) for n in _BLENDS if n not in found}


REGISTRY = _registry()


def preset(name: str) -> list[str]:
    if name == "core":
        return [f.name for f in CORE]
    if name == "zoo":
        return list(REGISTRY)
    raise ValueError(f"unknown preset: {name}")


def validated(names: Iterable[str]) -> list[str]:
    """Names without repeats, in their order; an unknown one is an error."""
    names = list(dict.fromkeys(names))
    if unknown := [n for n in names if n not in REGISTRY]:
        raise ValueError(f"unknown factors: {', '.join(unknown)}")
    return names


def with_parts(names: Iterable[str]) -> list[str]:
    """Names with the factors they are blended from, those first."""
    out: dict[str, None] = {}

    def visit(name: str) -> None:
        for part in REGISTRY[name].parts:
            visit(part)
        out.setdefault(name)

    for name in validated(names):
        visit(name)
    return list(out)


def category_counts(names: Iterable[str]) -> dict[str, int]:
    return dict(sorted(Counter(REGISTRY[n].category for n in names).items()))


def kind_counts(names: Iterable[str]) -> dict[str, int]:
    return dict(sorted(Counter(REGISTRY[n].kind for n in names).items()))


def catalog(spark: SparkSession, names: Iterable[str] | None = None) -> DataFrame:
    """A row for each factor."""
    rows = [(f.name, f.description, f.kind, f.category, {k: str(v) for k, v in f.params.items()}, list(f.needs), list(f.parts)) for f in (REGISTRY[n] for n in validated(names or REGISTRY))]
    return spark.createDataFrame(rows, "factor string, description string, kind string, category string, params map<string,string>, requires array<string>, dependencies array<string>")


def family_summary(factors: DataFrame) -> DataFrame:
    """By category: how many, how many by kind, the first six names, how many need fundamentals."""
    from pyspark.sql import functions as F

    kinds = factors.groupBy("category", "kind").agg(F.count("*").alias("n")).groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    own = factors.groupBy("category").agg(F.count("*").alias("factors"), F.slice(F.sort_array(F.collect_list("factor")), 1, 6).alias("examples"), F.count_if(F.size("requires") > 0).alias("fundamental"))
    return own.join(kinds, "category")
