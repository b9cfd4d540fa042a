"""Performance metrics as Columns: aggregates over returns or PnL, and expressions on them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators.library import no_nan, num

# Fixed values.
TRADING_DAYS = 252
HORIZON_DAYS = {"daily": 1, "monthly": 21, "quarterly": 63, "yearly": 252}
HORIZONS = ("daily", "monthly", "yearly", "full")
TURNOVER_FLOOR = 0.125


def _seen(x: Column) -> Column:
    return no_nan(num(x))


def get_mean(x: Column) -> Column:
    return F.avg(_seen(x))


def get_volatility(x: Column) -> Column:
    return F.stddev_samp(_seen(x))


def get_variance(x: Column) -> Column:
    return F.var_samp(_seen(x))


def annualised_return(pnl: Column, book_size: float, ann_factor: float = TRADING_DAYS) -> Column:
    return ann_factor * get_mean(pnl) / F.lit(float(book_size))


def information_ratio(x: Column) -> Column:
    return F.when(get_volatility(x) > 0, get_mean(x) / get_volatility(x))


def sharpe(x: Column, ann_factor: float = TRADING_DAYS) -> Column:
    return information_ratio(x) * F.sqrt(F.lit(float(ann_factor)))


def turnover(trade_volume: Column, book_size: float) -> Column:
    return trade_volume / F.lit(float(book_size))


def capacity_score(ret: Column, sharpe_: Column, turnover_: Column, floor: float = TURNOVER_FLOOR) -> Column:
    """Missing if any of the three is."""
    per = F.when(turnover_.isNotNull(), F.greatest(turnover_, F.lit(floor)))
    return sharpe_ * F.sqrt(F.abs(ret) / per)


def drawdown(cumulative: Column, by: list[str] | None = None, order: str = "date") -> Column:
    """Below the running maximum, from the first value on; by: columns that restart it."""
    run = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cumulative - F.max(cumulative).over(run)


def max_drawdown(drawdown_: Column) -> Column:
    return F.min(drawdown_)


def margin(pnl: Column, trade_volume: Column) -> Column:
    return F.when(trade_volume > 0, pnl / trade_volume).otherwise(F.lit(0.0))


def perc_profitable_days(ret: Column) -> Column:
    return F.avg((_seen(ret) > 0).cast("double"))


def count_long(sign: Column) -> Column:
    return F.count_if(sign == 1)


def count_short(sign: Column) -> Column:
    return F.count_if(sign == -1)


def pnl_change(pnl: Column, order: str = "date") -> Column:
    """Each row's PnL less the row's before; its mean is the trend."""
    return pnl - F.lag(pnl).over(Window.partitionBy().orderBy(order))
