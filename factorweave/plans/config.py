"""Settings of a run and the checks on them."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from ..functions.registry import preset, validated
from ..operators.portfolio import Rules


@dataclass(frozen=True)
class RunConfig:
    """What a run computes and which gates it must pass; a gate of 0 is open.

    ``requested`` is how many tickers were asked for (at least those with prices); ``expected_end`` the last
    completed session that prices must reach.
    """

    frequency: str = "M"
    factors: tuple[str, ...] = ()
    preset: str = "core"
    rules: Rules = field(default_factory=Rules)
    benchmarks: tuple[str, ...] = ()
    expected_end: dt.date | None = None
    requested: int = 0
    min_price_coverage: float = 0.0
    min_latest_coverage: float = 0.0
    min_tickers: int = 0
    min_history: int = 0
    min_eligible: int = 0
    holdout_fraction: float = 0.25
    holdout_periods: int = 6
    market_cap_attempted: bool = False
    fallback_reason: str = ""

    def names(self) -> list[str]:
        return validated(self.factors) if self.factors else preset(self.preset)


def tickers(symbols: Iterable[str]) -> list[str]:
    """Upper-case symbols without blanks, each once, in the order given."""
    return list(dict.fromkeys(t for t in (str(s or "").strip().upper() for s in symbols) if t))


# The public inputs of an analysis with their kinds, ranges and defaults.
INPUTS: dict[str, tuple] = {
    "period": ("5y", ("2y", "5y", "10y")),
    "rebalance": ("M", ("M", "W")),
    "top_n": (20, int, 1, 100),
    "weighting": ("score", ("score", "equal")),
    "factor_preset": ("zoo", ("zoo", "core")),
    "factor_allowlist": ("", str),
    "min_market_cap": (10_000_000_000, float, 0, 1e15),
    "min_dollar_volume": (50_000_000, float, 0, 1e15),
    "eligibility_adv_window": (63, int, 5, 252),
    "transaction_cost_bps": (5, float, 0, 1000),
    "transaction_cost_model": ("one_way_notional", ("one_way_notional", "portfolio_turnover")),
}


def analysis_value(name: str, raw: object, fallback: bool = True) -> object:
    """One input, checked: words must be listed, numbers finite and within their range."""
    default, kind, *bounds = INPUTS[name]
    text = "" if raw is None else str(raw).strip()
    if kind is str:
        names = [] if text == "__preset__" else list(dict.fromkeys(filter(None, (x.strip() for x in text.split(",")))))
        if bad := [n for n in names if not re.match(r"[A-Za-z0-9_]+\Z", n)]:
            raise ValueError(f"{name}: not a factor name: {bad[0]}")
        return ",".join(names)
    if not text:
        if fallback:
            return default
        raise ValueError(f"{name} is empty")
    if isinstance(kind, tuple):
        if str(raw) not in kind:
            raise ValueError(f"{name} must be one of {', '.join(kind)}")
        return str(raw)
    try:
        value = float(text)
    except ValueError:
        value = math.nan
    if not math.isfinite(value) or kind is int and value != int(value):
        raise ValueError(f"{name} must be a {'whole ' if kind is int else ''}number")
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must be within {bounds[0]:g} and {bounds[1]:g}")
    return kind(value)


def analysis(raw: Mapping[str, object], fallback: bool = True) -> dict[str, object]:
    """All inputs, checked; those that ``raw`` lacks take their defaults."""
    if unknown := sorted(set(raw) - set(INPUTS)):
        raise ValueError(f"unknown input: {unknown[0]}")
    return {name: analysis_value(name, raw.get(name), fallback) for name in INPUTS}


def run_config(inputs: Mapping[str, object], **more: object) -> RunConfig:
    """A run's settings from checked inputs."""
    rules = Rules(
        top_n=inputs["top_n"], weighting=inputs["weighting"], min_market_cap=float(inputs["min_market_cap"]), min_dollar_volume=float(inputs["min_dollar_volume"]),
        adv_window=inputs["eligibility_adv_window"], cost_bps=float(inputs["transaction_cost_bps"]), cost_model=inputs["transaction_cost_model"],
    )
    names = tuple(filter(None, str(inputs["factor_allowlist"]).split(",")))
    return RunConfig(frequency=inputs["rebalance"], factors=names, preset=inputs["factor_preset"], rules=rules, **more)
