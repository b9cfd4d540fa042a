"""The tables behind a dashboard: sample periods and their figures, leaders by month, benchmarks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Delay, TradingPeriod
from ..functions.metrics import TRADING_DAYS, capacity_score
from .attribution import attribution
from .simulate import aggregate_returns, by_date, rolling_beta_alpha


def split_periods(first: date, last: date, train: float = 0.6, validation: float = 0.8, *, apart: bool = False) -> list[TradingPeriod]:
    """TRAIN, VALIDATION and OOS: cut at shares of the calendar span. Neighbours share the day of the cut, unless they shall be ``apart``."""
    span = (last - first).days
    cuts = [first + timedelta(days=int(span * train)), first + timedelta(days=int(span * validation))]
    after = [c + timedelta(days=int(apart)) for c in cuts]
    return [TradingPeriod(first, cuts[0], "TRAIN"), TradingPeriod(after[0], cuts[1], "VALIDATION"), TradingPeriod(after[1], last, "OOS")]


def in_period(period: TradingPeriod, day: str = "date") -> Column:
    return F.col(day).cast("date").between(F.lit(period.start), F.lit(period.end))


def period_name(periods: list[TradingPeriod], day: str = "date") -> Column:
    """The name of the first period that holds the day."""
    out = F.lit(None).cast("string")
    for p in reversed(periods):
        out = F.when(in_period(p, day), p.name).otherwise(out)
    return out


def periods_of(periods: list[TradingPeriod], day: str = "date") -> Column:
    """The names of all periods that hold the day: a day that two periods share is in both."""
    return F.array_compact(F.array(*[F.when(in_period(p, day), p.name) for p in periods]))


def period_figures(portfolio: DataFrame, periods: list[TradingPeriod], *, book_size: float, delay: Delay = Delay.ONE) -> DataFrame:
    """Each period's aggregate as a sample of its own, with the first two together as IS; one pass over the portfolio, whose
    dates take part in every period that they are in."""
    named = [*periods[:2], TradingPeriod(periods[0].start, periods[1].end, "IS"), *periods[2:]]
    figures = aggregate_returns(portfolio.withColumn("period", F.explode(periods_of(named))), "full", delay=delay, book_size=book_size, sample=("period",))
    return figures.withColumns({"total_pnl": F.col("pnl"), "annualised_mean_pnl": F.col("mean_pnl") * TRADING_DAYS})


def common_start(*tables: DataFrame) -> date | None:
    """The latest of the tables' first dates."""
    firsts = [t.agg(F.min(F.col("date").cast("date"))).first()[0] for t in tables]
    return max((f for f in firsts if f), default=None)


def from_date(table: DataFrame, start: date | None) -> DataFrame:
    return (table.where(F.col("date") >= F.lit(start)) if start else table).orderBy("date")


def with_display_columns(daily: DataFrame, *, book_size: float) -> DataFrame:
    """daily with the running columns that charts need, where it lacks them and has what they are made of: a table with one row a date.

    The capacity score is made of the expanding means of return and turnover, from the second date on, and of the first Sharpe
    ratio that there is.
    """
    run = by_date().rowsBetween(Window.unboundedPreceding, 0)
    have = lambda *names: set(names) <= set(daily.columns)
    grown = lambda c: F.when(F.count(c).over(run) >= 2, F.avg(c).over(run))
    recipes = [
        ("ret", ("pnl",), lambda: F.col("pnl") / float(book_size)),
        ("cum_pnl", ("pnl",), lambda: F.sum(F.coalesce("pnl", F.lit(0.0))).over(run)),
        ("drawdown", ("cum_pnl",), lambda: (F.col("cum_pnl") - F.max("cum_pnl").over(run)) / float(book_size)),
        ("ann_ret", ("ret",), lambda: F.col("ret") * TRADING_DAYS),
        ("log_ret", ("ret",), lambda: F.when(F.col("ret") > -1, F.log1p("ret"))),
        ("rolling_sharpe", ("expanding_sharpe",), lambda: F.col("expanding_sharpe")),
    ]
    for name, needs, made in recipes:
        if name not in daily.columns and have(*needs):
            daily = daily.withColumn(name, made())
    sharpe = next((c for c in ("expanding_sharpe", "rolling_sharpe", "sharpe") if c in daily.columns), None)
    if sharpe and have("ret", "turnover") and not {"rolling_capacity_score", "expanding_capacity_score", "capacity_score"} & set(daily.columns):
        daily = daily.withColumn("expanding_capacity_score", capacity_score(grown("ret") * TRADING_DAYS, F.col(sharpe), grown("turnover")))
    return daily


def benchmark_returns(closes: DataFrame) -> DataFrame:
    """date, b: change of a benchmark's (date, close), a missing close taken as the one before."""
    run = by_date().rowsBetween(Window.unboundedPreceding, 0)
    held = closes.select("date", F.last("close", ignorenulls=True).over(run).alias("close"))
    before = F.lag("close").over(by_date())
    return held.select("date", F.when(before != 0, F.col("close") / before - 1).alias("b"))


def portfolio_beta(portfolio: DataFrame, closes: DataFrame, window: int = 63) -> DataFrame:
    if not 30 <= window <= 252:
        raise ValueError("the window is 30 to 252 days")
    return rolling_beta_alpha(portfolio.select("date", F.col("ret").alias("p")), benchmark_returns(closes), window)


def monthly_leaders(panel: DataFrame, *, book_size: float, groups: tuple[str, ...] = ("ticker",), top: int = 10) -> DataFrame:
    """The best and the worst contributions of each month, numbered from 1 within month and kind."""
    table = attribution(panel, horizon="monthly", groups=groups, book_size=book_size)
    place = lambda order: F.row_number().over(Window.partitionBy("date").orderBy(order, *groups))
    both = table.withColumns({"_win": place(F.desc("contribution_pnl")), "_lose": place(F.asc("contribution_pnl"))}).where((F.col("_win") <= top) | (F.col("_lose") <= top))
    kinds = F.array(F.when(F.col("_win") <= top, F.struct(F.lit("winner").alias("kind"), F.col("_win").alias("place"))), F.when(F.col("_lose") <= top, F.struct(F.lit("loser").alias("kind"), F.col("_lose").alias("place"))))
    return both.withColumn("_k", F.explode(kinds)).where("_k is not null").select("date", *groups, "contribution_pnl", "contribution_pct", F.col("_k.kind").alias("kind"), F.col("_k.place").alias("place"))


def day_snapshot(panel: DataFrame, day: str) -> DataFrame:
    """The rows of one day, largest PnL by size first."""
    return panel.where(F.col("date").cast("date") == F.lit(day).cast("date")).orderBy(F.desc(F.abs("pnl")), "ticker")


def top_groups(panel: DataFrame, periods: list[TradingPeriod], group: str, *, top: int = 12) -> DataFrame:
    """The groups with the largest PnL by size in each period."""
    sums = panel.withColumn("period", period_name(periods)).where("period is not null").groupBy("period", group).agg(F.sum("pnl").alias("pnl"))
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.desc(F.abs("pnl")), group))
    return sums.withColumn("place", place).where(F.col("place") <= top)


def largest_rows(table: DataFrame, *, top: int = 25, groups: tuple[str, ...] = ("ticker",)) -> DataFrame:
    return table.orderBy(F.desc(F.abs("contribution_pnl")), "date", *groups).limit(top)
