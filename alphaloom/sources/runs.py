"""Saved runs: tables as Parquet, settings and figures as JSON, and a page to read."""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Delay, Neutralization, Universe
from ..plans.backtest import Backtest, Strategy
from ..plans.expr import parse
from ..plans.signal import Alpha
from ..plans.simulate import aggregate_returns, formatted_summary, summary
from .files import commit, get, newest, put, tidy

TABLES = ("panel", "portfolio", "yearly", "source_data")


def config_of(strategy: Strategy, book_size: float) -> dict[str, Any]:
    a = strategy.alpha
    return {
        "signals": {k: str(v) for k, v in a.signals.items()},
        "constraints": {k: str(v) for k, v in a.constraints.items()},
        "exit_condition": str(a.exit_condition) if a.has_exit_condition else None,
        "universe": strategy.universe.name if isinstance(strategy.universe, Universe) else list(strategy.universe),
        "delay": strategy.delay.name,
        "decay": strategy.decay,
        "truncation": strategy.truncation,
        "neutralization": strategy.neutralization.name,
        "book_size": book_size,
    }


def strategy_of(config: dict[str, Any]) -> Strategy:
    read = lambda d: {k: parse(v) for k, v in d.items()} or None
    leave = config["exit_condition"]
    alpha = Alpha(signals=read(config["signals"]), constraints=read(config["constraints"]), exit_condition=parse(leave) if leave else None)
    universe = Universe[config["universe"]] if isinstance(config["universe"], str) else config["universe"]
    return Strategy(alpha, universe=universe, delay=Delay[config["delay"]], decay=config["decay"], truncation=config["truncation"], neutralization=Neutralization[config["neutralization"]])


def run_name(strategy: Strategy, book_size: float) -> str:
    """A readable name with a hash of all settings."""
    config = config_of(strategy, book_size)
    universe = config["universe"] if isinstance(config["universe"], str) else f"{len(config['universe'])} names"
    text = f"{next(iter(config['signals'].values()))} {universe} {config['neutralization']} delay {strategy.delay.value} decay {config['decay']} trunc {config['truncation']}"
    slug = re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")
    return f"{slug[:120]}-{hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]}"


def save_backtest(run: Backtest, path: str, source_data: DataFrame | None = None) -> str:
    """Writes the run's tables, config, summary and page under path; tables without rows are left out.

    The panel is written first, by the only job that runs the formulas; every other table, the figures and the page are made of what is
    written. All of it goes to a folder of its own, and a manifest that names this folder and its
    tables is put in place last. A run that is killed before has no manifest and is not there for readers; one that is saved
    again leaves the version before it whole until then.
    """
    spark = run.panel.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    at, tables = f"{path}/{folder}", {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        tables[name] = df.schema.json()
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    kept = run.written(f"{at}/panel")
    tables["panel"] = kept.panel.schema.json()
    portfolio = keep("portfolio", kept.portfolio)
    yearly = keep("yearly", aggregate_returns(portfolio, "yearly", delay=run.strategy.delay, book_size=run.book_size))
    totals = keep("totals", name_totals(kept.panel))
    figures = formatted_summary(summary(portfolio, delay=run.strategy.delay, book_size=run.book_size).first().asDict())
    if not kept.observed["n_rows"]:
        tables.clear()
    if source_data is not None:
        seen = Observation("source")
        keep("source_data", source_data.observe(seen, F.count(F.lit(1)).alias("n")))
        if not seen.get["n"]:
            del tables["source_data"]
    title = run_name(run.strategy, run.book_size)
    put(spark, f"{at}/compact_summary", report_page(title, figures, portfolio, yearly, totals, ends=(kept.observed["first"], kept.observed["last"])))
    commit(spark, path, {"folder": folder, "tables": tables, "config": config_of(run.strategy, run.book_size), "summary": figures})
    return path


def load_backtest(spark: SparkSession, path: str, root: str | None = None) -> tuple[Strategy, dict[str, DataFrame], dict[str, Any]]:
    """(the strategy, its tables, its figures) of the newest whole run at path, or under root if there is none."""
    manifest = newest(spark, path)
    if manifest is None and root is not None:
        path = f"{root.rstrip('/')}/{path}"
        manifest = newest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no saved run at {path}")
    read = lambda name, schema: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{manifest['folder']}/{name}")
    tables = {name: read(name, schema) for name, schema in manifest["tables"].items() if name in TABLES}
    strategy = strategy_of(manifest["config"])
    strategy.record(**tables)
    return strategy, tables, manifest["summary"]


def read_page(spark: SparkSession, path: str) -> str:
    """The page of the newest whole run at path."""
    return get(spark, f"{path}/{newest(spark, path)['folder']}/compact_summary")


def tidy_run(spark: SparkSession, path: str) -> None:
    """Removes what the newest whole run at path does not need: older versions, and what killed runs left."""
    if manifest := newest(spark, path):
        tidy(spark, path, {manifest["folder"]}, "data-|manifest-")


def _lines(series: dict[str, list[tuple[Any, float]]], width: int = 720, height: int = 180) -> str:
    """One chart of a few lines over the same dates."""
    values = [v for points in series.values() for _, v in points if v is not None]
    if not values:
        return ""
    low, high = min(values), max(values)
    points = next(iter(series.values()))
    at = lambda i, v: f"{i * width / max(1, len(points) - 1):.1f},{height - (v - low) / ((high - low) or 1) * height:.1f}"
    drawn = "".join(f'<polyline fill="none" stroke="{colour}" points="{" ".join(at(i, v) for i, (_, v) in enumerate(own) if v is not None)}"/>' for own, colour in zip(series.values(), ("#246", "#a52"), strict=False))
    return f'<figure><figcaption>{html.escape(" / ".join(series))}: {points[0][0]} to {points[-1][0]}, {low:,.4g} to {high:,.4g}</figcaption><svg viewBox="0 0 {width} {height}">{drawn}</svg></figure>'


def _bars(rows: list[tuple[str, float]], width: int = 720) -> str:
    """Horizontal bars from a common zero, with names and values."""
    if not rows:
        return ""
    low, high = min(0.0, *(v for _, v in rows)), max(0.0, *(v for _, v in rows))
    x = lambda v: (v - low) / ((high - low) or 1) * (width - 240) + 120
    drawn = "".join(
        f'<rect x="{min(x(0), x(v)):.1f}" y="{18 * i + 2}" width="{abs(x(v) - x(0)):.1f}" height="14" fill="{"#246" if v >= 0 else "#a52"}"/>'
        f'<text x="0" y="{18 * i + 14}" font-size="12">{html.escape(n)}</text><text x="{width - 110}" y="{18 * i + 14}" font-size="12">{v:,.2f}</text>'
        for i, (n, v) in enumerate(rows)
    )
    return f'<svg viewBox="0 0 {width} {18 * len(rows) + 4}">{drawn}</svg>'


def _table(df: DataFrame, columns: list[str]) -> str:
    """A small table in the order of its first column."""
    cell = lambda v: f"{v:,.4f}" if isinstance(v, float) else html.escape(str(v if v is not None else ""))
    rows = sorted(df.select(*columns).collect(), key=lambda r: str(r[0]))
    return "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def thinned(portfolio: DataFrame, columns: list[str], ends: tuple[date, date], width: int = 2000) -> list[Any]:
    """At most two rows for each of ``width`` parts of the time between the ends, the first and last included: all of the sample, as fine as a page can show."""
    day = F.col("date").cast("date")
    first, last = ends
    part = F.floor(F.datediff(day, F.lit(first)) * width / max((last - first).days + 1, 1))
    row = F.struct(day.alias("date"), *columns)
    both = portfolio.groupBy(part.alias("part")).agg(F.min_by(row, "date").alias("first"), F.max_by(row, "date").alias("last")).collect()
    return sorted({r[c]["date"]: r[c] for r in both for c in ("first", "last")}.values(), key=lambda r: r["date"])


def name_totals(panel: DataFrame) -> DataFrame:
    """kind (sector or ticker), name and pnl: both from one pass over the panel."""
    kinds = [c for c in ("sector", "ticker") if c in panel.columns]
    rows = panel.select(*(F.col(c).cast("string").alias(c) for c in kinds), "pnl").groupingSets([[F.col(c)] for c in kinds], *(F.col(c) for c in kinds))
    kind = F.when(F.grouping("ticker") == 0, "ticker").otherwise("sector") if "sector" in kinds else F.lit("ticker")
    return rows.agg(kind.alias("kind"), F.sum("pnl").alias("pnl")).select("kind", F.coalesce(*kinds, F.lit("None")).alias("name"), "pnl")


def report_page(title: str, figures: dict[str, Any], portfolio: DataFrame, yearly: DataFrame, totals: DataFrame | None = None, *, ends: tuple[date | None, date | None], width: int = 2000, names: int = 10) -> str:
    """An HTML page: figures, lines of the portfolio over the whole sample, the yearly table and, of ``name_totals``, bars of PnL by sector and of the best and worst names."""
    charts = [({"cum_pnl": "Cumulative PnL"}), ({"drawdown": "Drawdown"}), ({"expanding_sharpe": "Expanding Sharpe", "rolling_sharpe": "Rolling Sharpe"}), ({"turnover": "Turnover"}), ({"gross_exposure": "Gross exposure", "net_exposure": "Net exposure"})]
    days = thinned(portfolio, [c for chart in charts for c in chart], ends, width) if ends[0] is not None else []
    lines = "".join(_lines({t: [(d["date"], d[c]) for d in days] for c, t in chart.items()}) for chart in charts)
    listed = "".join(f"<dt>{html.escape(k)}</dt><dd>{html.escape(str(v))}</dd>" for k, v in figures.items())
    more = ""
    if totals is not None:
        known = totals.where("pnl is not null")
        sectors = sorted(((r["name"], r["pnl"]) for r in known.where("kind = 'sector'").collect()), key=lambda r: (-r[1], r[0]))
        ends_of = lambda order: [(r["name"], r["pnl"]) for r in known.where("kind = 'ticker'").orderBy(order, "name").limit(names).collect()]
        more = "".join(f"<h2>{h}</h2>{_bars(rows)}" for h, rows in (("PnL by sector", sectors), ("Best names", ends_of(F.desc("pnl"))), ("Worst names", ends_of(F.asc("pnl")))))
    years = _table(yearly, ["date", "ret", "vol", "pnl", "sharpe", "turnover", "drawdown", "capacity_score", "margin"])
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><dl>{listed}</dl>{lines}{years}{more}'
