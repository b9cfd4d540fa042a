"""A strategy and its backtest: signals, weights, trades, PnL, portfolio, figures and checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Decay, Delay, InstrumentType, Neutralization, Region, TradingPeriod, Universe, number
from .signal import Alpha, compute_signals
from .simulate import aggregate_returns, allocations, asset_returns, daily_portfolio, formatted_summary, summary
from .validate import ValidityReport, are_market_changes_valid, observations, validate_backtest
from .weights import compute_weights

if TYPE_CHECKING:
    from ..sources.bars import BarStore

FIXED = {"instrument_type", "region"}
#: Headline figures of a run, and the summary's columns they are.
HEADLINE = {"pnl": "total_pnl", "ret": "annualised_return", "sharpe": "sharpe", "turnover": "turnover", "capacity_score": "capacity_score", "drawdown": "drawdown", "margin": "margin"}


class Strategy:
    """An alpha and how it is traded. Settings are checked when they are set; the instrument type and region only once."""

    def __init__(
        self,
        alpha: Alpha | None = None,
        *,
        signal: Any = None,
        constraint: Any = None,
        signals: Any = None,
        constraints: Any = None,
        exit_condition: Any = None,
        universe: Universe | list[str] = Universe.TOP500_PIT,
        delay: Delay = Delay.ONE,
        decay: int | Decay = Decay.NONE,
        truncation: float = 0.0,
        neutralization: Neutralization | str = Neutralization.NONE,
        instrument_type: InstrumentType = InstrumentType.EQUITY,
        region: Region = Region.USA,
    ) -> None:
        self.alpha = alpha if alpha is not None else Alpha(signal, constraint, exit_condition, signals=signals, constraints=constraints)
        self.universe, self.delay, self.decay, self.truncation, self.neutralization = universe, delay, decay, truncation, neutralization
        self.instrument_type, self.region = instrument_type, region
        self.results: dict[str, Any] = {}

    def __setattr__(self, name: str, value: Any) -> None:
        check = {
            "alpha": lambda v: isinstance(v, Alpha),
            "delay": lambda v: isinstance(v, Delay),
            "decay": lambda v: isinstance(v, Decay) or isinstance(v, int) and not isinstance(v, bool) and v >= 0,
            "truncation": lambda v: isinstance(v, Enum) or isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1,
            "neutralization": lambda v: isinstance(v, (Neutralization, str)),
            "instrument_type": lambda v: isinstance(v, InstrumentType),
            "region": lambda v: isinstance(v, Region),
        }
        if name in FIXED and name in self.__dict__:
            raise AttributeError(f"{name} cannot be changed")
        if name in check and not check[name](value):
            raise ValueError(f"{value!r} is no {name}")
        if name == "neutralization":
            value = Neutralization(value)
        elif name == "decay":
            value = int(number(value))
        elif name == "truncation":
            value = number(value)
        object.__setattr__(self, name, value)

    @property
    def signal(self):
        return next(iter(self.alpha.signals.values()))

    @property
    def constraints(self):
        return self.alpha.constraints

    def record(self, **results: Any) -> None:
        self.results.update(results)
        self.__dict__.pop("_figures", None)

    @property
    def aggregate_metrics(self) -> dict[str, Any]:
        """The last run's headline figures; empty before there is one. The first look runs the summary's plan."""
        if "_figures" not in self.__dict__:
            table = self.results.get("summary")
            row = table.first() if table is not None else None
            object.__setattr__(self, "_figures", {name: row[column] for name, column in HEADLINE.items()} if row is not None else {})
        return self.__dict__["_figures"]

    def __getattr__(self, name: str) -> Any:
        """What a strategy lacks its alpha has, or its tables and figures of the last run do."""
        if name.startswith("_") or "alpha" not in self.__dict__:
            raise AttributeError(name)
        if hasattr(self.alpha, name):
            return getattr(self.alpha, name)
        if name in self.__dict__.get("results", {}):
            return self.results[name]
        if name in HEADLINE and name in self.aggregate_metrics:
            return self.aggregate_metrics[name]
        raise AttributeError(f"a strategy has no {name!r}")


@dataclass
class Backtest:
    """Lazy tables: the panel with weights and PnL, the daily portfolio, yearly figures and the summary."""

    strategy: Strategy
    book_size: float
    source: DataFrame
    panel: DataFrame
    portfolio: DataFrame
    yearly: DataFrame
    summary: DataFrame
    fields: list[str] = field(default_factory=list)
    signal_col: str = "signal"
    weight_col: str = "weights"
    #: What was observed while the panel was written, if it was.
    observed: dict[str, Any] | None = None

    def written(self, path: str) -> Backtest:
        """This run with its panel written to ``path`` and all that is made of the panel reading it there.

        The formulas run once, and what the checks count of rows is observed in that job.
        """
        seen = Observation("panel")
        self.panel.observe(seen, *observations(self.panel, self.signal_col)).write.parquet(path)
        panel = self.panel.sparkSession.read.schema(self.panel.schema).parquet(path)
        return replace(self, panel=panel, **tables_of(panel, self.strategy, self.book_size, self.weight_col), observed=seen.get)

    def figures(self) -> dict[str, Any]:
        return formatted_summary(self.summary.first().asDict())

    def validate(self) -> dict[str, ValidityReport]:
        s = self.strategy
        return validate_backtest(
            self.source, self.panel, self.portfolio, fields=self.fields, neutralization=s.neutralization, truncation=s.truncation, signal=self.signal_col, weight=self.weight_col, observed=self.observed, one_plan=True
        )

    def display(self) -> bool:
        """Prints settings, formulas, checks and figures; whether all checks passed."""
        s, reports = self.strategy, self.validate()
        print(are_market_changes_valid(self.panel))
        for name in ("universe", "delay", "decay", "truncation", "neutralization"):
            print(f"{name}: {getattr(s, name)}")
        for kind, exprs in (("signal", s.alpha.signals), ("constraint", s.alpha.constraints)):
            for name, e in exprs.items():
                print(f"{kind} {name}: {e}")
        for name, report in reports.items():
            print(f"{name}: {'ok' if report else report}")
        for name, value in self.figures().items():
            print(f"{name}: {value}")
        return all(map(bool, reports.values()))


def tables_of(panel: DataFrame, strategy: Strategy, book_size: float, weight_col: str) -> dict[str, DataFrame]:
    """The portfolio, yearly figures and summary that a panel gives."""
    portfolio = daily_portfolio(panel, book_size=book_size, weight=weight_col)
    return {
        "portfolio": portfolio,
        "yearly": aggregate_returns(portfolio, "yearly", delay=strategy.delay, book_size=book_size),
        "summary": summary(portfolio, delay=strategy.delay, book_size=book_size),
    }


def run_backtest(
    strategy: Strategy | Alpha,
    data: DataFrame | None = None,
    signal_col: str = "signal",
    weight_col: str = "weights",
    trading_period: TradingPeriod | None = None,
    book_size: float = 1.0,
    display: bool = True,
    *,
    store: BarStore | None = None,
    universe_size: int | Universe | None = None,
    noise: float = 0.0,
    cache: bool = False,
) -> Backtest:
    """The whole chain as one lazy plan. The column ``signal_col`` is traded if there is such a signal, else the first one.

    Without ``data`` the panel comes from the ``store``: the universe's tickers in the trading period, with all fields that
    the formulas and the neutralization need. A trading period also cuts given data. With a ``universe_size`` only so many of the
    largest names of each date are traded, unless the panel says which (``in_universe``). The panel's weights are called
    ``weight_col``; ``noise`` is that of group_neutralize. With ``cache`` the panel is kept for the tables that are made
    of it. With ``display`` (the usual case at a prompt) the run is checked and printed, which runs the plan; without it nothing runs yet.
    """
    if isinstance(book_size, bool) or not isinstance(book_size, (int, float)) or not book_size > 0:
        raise ValueError("the book size is a number above 0")
    strategy = Strategy(strategy) if isinstance(strategy, Alpha) else strategy
    if data is None:
        if store is None or trading_period is None:
            raise ValueError("without data, a store and a trading period are needed")
        if isinstance(strategy.universe, Universe):
            raise ValueError("a named universe is a mask over a panel: give the strategy a list of tickers")
        data = store.build_data(strategy.alpha, tickers=list(strategy.universe), start=trading_period.start, end=trading_period.end, group=strategy.neutralization.field, universe=universe_size)
    elif trading_period is not None:
        data = data.where(F.col("date").cast("date").between(F.lit(trading_period.start), F.lit(trading_period.end)))
    panel = compute_signals(data, strategy.alpha, universe=universe_size)
    if signal_col not in panel.columns:
        panel = panel.withColumn(signal_col, F.col(f"`{next(iter(strategy.alpha.signals))}`"))
    panel = compute_weights(panel, neutralization=strategy.neutralization, decay=strategy.decay, truncation=strategy.truncation, signal=signal_col, noise=noise)
    panel = asset_returns(allocations(panel, delay=strategy.delay, book_size=book_size))
    panel = panel.cache() if cache else panel
    panel = panel.withColumnRenamed("weights", weight_col)
    out = Backtest(strategy, float(book_size), data, panel, **tables_of(panel, strategy, book_size, weight_col), fields=[f for f in strategy.alpha.fields], signal_col=signal_col, weight_col=weight_col)
    strategy.record(source_data=data, df=out.panel, panel=out.panel, portfolio=out.portfolio, yearly=out.yearly, summary=out.summary, weights=out.panel.select("date", "ticker", weight_col), book_size=out.book_size)
    if display:
        out.display()
    return out
