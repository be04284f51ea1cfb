"""Artifacts of a run: its tables and reports in a folder, and the JSON that a static dashboard reads.

Rankings, metrics, period returns, holdings and reasons are bounded by factors and periods and become single
files. Prices and scores grow with the input; Spark writes those as folders of CSV parts.
"""

from __future__ import annotations

import csv
import datetime as dt
import html
import json
import math
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators import portfolio
from ..sources import sinks

# File names, the columns that stay text, whole numbers, and the metadata that may be shown.
FILES = {
    "ranking": "factor_rankings.csv",
    "metrics": "factor_metrics.csv",
    "latest_holdings": "latest_holdings.csv",
    "returns": "portfolio_returns.csv",
    "benchmark_returns": "benchmark_returns.csv",
    "skipped": "skipped_reasons.csv",
    "holdout_ranking": "factor_holdout_rankings.csv",
    "holdout_metrics": "factor_holdout_metrics.csv",
}
REQUIRED = ("factor_rankings.csv", "factor_metrics.csv", "run_metadata.json")
SECTIONS = {
    "rankings": "ranking",
    "metrics": "metrics",
    "latest_holdings": "latest_holdings",
    "factor_period_returns": "returns",
    "benchmark_returns": "benchmark_returns",
    "skipped_reasons": "skipped",
    "holdout_rankings": "holdout_ranking",
    "holdout_metrics": "holdout_metrics",
}
TEXT = ("factor", "ticker", "benchmark", "period_start", "period_end", "price_date_start", "price_date_end", "rebalance_date", "price_date_used", "skip_reason")
WHOLE = ("rank", "count", "holdings_count")
SHOWN = ("provider", "fetched_at", "universe_as_of_date", "data_end_date", "tested_factor_count", "effective_factor_count", "factor_preset", "factor_library_size", "selected_factor_count", "source_hash", "price_coverage_ratio", "universe_ticker_count", "rankable_stock_universe_count", "holdout_validation")
SOURCES = ("csv", "yfinance", "yahoo_chart", "yfinance_yahoo_chart")
LOW_COVERAGE, LISTED = 0.9, 30
#: How results are refreshed; a scheduler is the caller's.
AUTOMATION = {"mode": "on_demand", "entry_point": "python -m factorweave run", "fallback_policy": "a failed gate leaves the published result as it is"}


def number(text: object, whole: bool = False) -> int | float | None:
    """A finite number, or None; whole ones lose their fraction."""
    try:
        value = float(str(text).strip() if text is not None else "nan")
    except ValueError:
        return None
    return None if not math.isfinite(value) else int(value) if whole else value


def read_rows(path: Path) -> list[dict]:
    """Rows of an artifact with numbers where they belong; none if it is absent."""
    if not path.exists():
        return []
    with path.open(newline="") as f:
        return [{k: v if k in TEXT else number(v, k in WHOLE) for k, v in row.items()} for row in csv.DictReader(f)]


def with_latest(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the newest holdings of the factor that ranks first."""
    best = tables["ranking"].where("rank = 1").select("factor").first()
    return dict(tables) | {"latest_holdings": portfolio.latest_holdings(tables["holdings"], best.factor if best else "")}


def _page(title: str, tables: Mapping[str, list[dict]], bars: Mapping[str, str]) -> str:
    said = lambda v: html.escape("" if v is None else f"{v:.10g}" if isinstance(v, float) else str(v), quote=True)

    def cell(section: str, name: str, value: object) -> str:
        if bars.get(section) != name:
            return f"<td>{said(value)}</td>"
        share = 100 * (number(value) or 0.0)
        return f'<td><meter min="0" max="100" value="{max(0.0, min(100.0, share)):.4g}"></meter> {said(value)}</td>'

    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{said(title)}</title></head><body><h1>{said(title)}</h1>"]
    for section, rows in tables.items():
        names = list(rows[0]) if rows else []
        out.append(f"<h2>{said(section)}</h2><table><tr>{''.join(f'<th>{said(n)}</th>' for n in names)}</tr>")
        out += [f"<tr>{''.join(cell(section, n, row[n]) for n in names)}</tr>" for row in rows]
        out.append("</table>")
    return "\n".join([*out, "</body></html>"]) + "\n"


def write_artifacts(tables: Mapping[str, DataFrame], folder: str | Path, metadata: Mapping, config: Mapping, prices: DataFrame | None = None, scores: bool = True) -> None:
    """Tables, configuration, metadata and both reports of a run; the scores may be left out.

    The driver writes the small files, executors the snapshots: on a cluster ``folder`` must be mounted on all of them.
    """
    root, tables = Path(folder), with_latest(tables)
    for name, file in FILES.items():
        if name in tables:
            sinks.write_csv(tables[name], root / file)
    for name, df in (("factor_scores", tables.get("scores") if scores else None), ("prices_snapshot", tables.get("prices") if prices is None else prices), ("universe_snapshot", tables.get("universe"))):
        if df is not None:
            sinks.write_parts(df.drop("line"), str(root / name))
    sinks.write_json(root / "run_config.json", dict(config))
    sinks.write_json(root / "run_metadata.json", dict(metadata))
    (root / "report.md").write_text(sinks.report(tables["ranking"], tables["latest_holdings"], tables["skipped"], metadata))
    shown = {s: read_rows(root / FILES[SECTIONS[s]]) for s in ("rankings", "latest_holdings", "skipped_reasons")}
    (root / "report.html").write_text(_page("Factor report", shown, {"rankings": "composite_score", "latest_holdings": "weight"}))


def source_kind(metadata: Mapping) -> str:
    """Where prices came from, without paths: a known provider or the known prefix of a source."""
    said = (str(metadata.get("provider") or ""), str(metadata.get("source") or "").partition(":")[0])
    return next((s for s in (x.strip().lower() for x in said) if s in SOURCES), "unknown")


def site_payload(folder: str | Path, scope: str = "csv_run", generated_at: str | None = None) -> dict:
    """What a dashboard shows of a run: rankings, metrics and metadata must be there, the rest may be missing."""
    root = Path(folder)
    if absent := [n for n in REQUIRED if not (root / n).exists()]:
        raise FileNotFoundError(f"missing artifacts: {', '.join(absent)}")
    metadata = json.loads((root / "run_metadata.json").read_text())
    if not isinstance(metadata, dict):
        raise ValueError("metadata must be an object")
    sections = {s: read_rows(root / FILES[name]) for s, name in SECTIONS.items()}
    best = sections["rankings"][0] if sections["rankings"] else {}
    late = next((r for r in sections["holdout_rankings"] if r["factor"] == best.get("factor")), {})
    public = {k: metadata[k] for k in SHOWN if metadata.get(k) not in (None, "")} | {"source_kind": source_kind(metadata)}
    summary = {
        "best_factor": best.get("factor"),
        "best_composite_score": best.get("composite_score"),
        "ranking_count": len(sections["rankings"]),
        "holding_count": len(sections["latest_holdings"]),
        **{k: number(metadata.get(k), True) for k in ("tested_factor_count", "effective_factor_count", "factor_library_size", "selected_factor_count")},
        **{k: metadata.get(k) or None for k in ("factor_preset", "fetched_at", "data_end_date", "source_hash", "universe_as_of_date")},
        "provider": metadata.get("provider") or "unknown",
        "interpretation_label": "in_sample_exploratory_with_recent_holdout_check",
        "static_data_warning": "A stored result of one run: it does not refresh by itself.",
        **{f"best_factor_holdout_{k}": late.get(k) for k in ("rank", "cagr", "sharpe")},
    }
    at = generated_at or dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
    lists = {k: metadata[k] if isinstance(metadata.get(k), list) else [] for k in ("factor_catalog", "factor_family_summary", "caveats")}
    lists["caveats"] = [str(c) for c in lists["caveats"] or sinks.CAVEATS]
    return {"schema_version": 1, "generated_at": at, "data_scope": scope, "summary": summary, **sections, **lists, "metadata": public, "automation": dict(AUTOMATION)}


def public_summary(payload: Mapping) -> dict:
    """The short form: its state is degraded without holdings or below nine tenths of price coverage."""
    holdings, covered = payload["latest_holdings"], payload["metadata"].get("price_coverage_ratio")
    reasons = [] if holdings else ["latest holdings missing"]
    if isinstance(covered, (int, float)) and covered < LOW_COVERAGE:
        reasons.append("price coverage below 90%")
    return {
        "schemaVersion": 1,
        "generatedAt": payload["generated_at"],
        "dataAsOf": payload["summary"]["data_end_date"],
        "timezone": "UTC",
        "status": {"state": "degraded" if reasons else "ok", "degradedReasons": reasons},
        "coverage": {
            "rankingCount": len(payload["rankings"]), "holdingCount": len(holdings), "priceCoverageRatio": covered, "testedFactorCount": payload["summary"]["tested_factor_count"], "selectedFactorCount": payload["summary"]["selected_factor_count"],
            "universeTickerCount": payload["metadata"].get("universe_ticker_count"), "rankableStockUniverseCount": payload["metadata"].get("rankable_stock_universe_count"),
        },
        "highlights": [{"label": k, "value": payload["summary"][k]} for k in ("best_factor", "best_composite_score", "best_factor_holdout_rank")],
        "limitations": payload["caveats"][:4],
        "bestFactor": payload["summary"]["best_factor"],
        "primaryEntities": [{"symbol": r["ticker"], "weight": r["weight"], "score": r.get("score"), "rebalanceDate": r.get("rebalance_date")} for r in holdings[:LISTED]],
    }


def write_site(folder: str | Path, output: str | Path, scope: str = "csv_run", generated_at: str | None = None) -> dict:
    """The payload at ``output`` and ``summary.json`` beside it, which tells the payload's size."""
    payload = site_payload(folder, scope, generated_at)
    sinks.write_json(output, payload)
    sinks.write_json(Path(output).with_name("summary.json"), public_summary(payload) | {"detailBytes": Path(output).stat().st_size})
    return payload

