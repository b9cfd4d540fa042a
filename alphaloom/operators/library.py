"""The operators of the formula language, each as a function from Columns to a Column.

An operator has a scope. ``ticker``: along a ticker's rows in date order; ``date``: across the
rows of a date; ``row``: each row alone. Windows count rows. Null is the only missing value,
and no expression here yields NaN or fails under ANSI mode.

``operator`` registers a function under its name, and the name is from then on a word of the
language; users add their own in the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.expr import Call, Expr, Literal, as_expr

TICKER, DATE, ROW = "ticker", "date", "row"


@dataclass(frozen=True)
class Scope:
    """The columns that hold a panel's keys; without one, its operators run over all rows in the order of the other."""

    ticker: str | None = "ticker"
    date: str | None = "date"

    def time(self) -> WindowSpec:
        by = Window.partitionBy(self.ticker) if self.ticker else Window.partitionBy()
        return by.orderBy(self.date)

    def cross(self, *more: Column) -> WindowSpec:
        return Window.partitionBy(*([self.date] if self.date else []), *more)


@dataclass(frozen=True)
class Operator:
    name: str
    scope: str
    build: Callable[..., Column]

    def __call__(self, *args: Any, **kwargs: Any) -> Call:
        """The formula that applies the operator."""
        return Call(self.name, tuple(map(_argument, args)), tuple((k, _argument(v)) for k, v in kwargs.items()))


def _argument(value: Any) -> Expr:
    return Literal(value) if value is None or isinstance(value, str) else as_expr(value)


REGISTRY: dict[str, Operator] = {}


def operator(scope: str, *aliases: str) -> Callable[[Callable[..., Column]], Operator]:
    """Registers build(scope, *arguments): columns come as Columns, numbers as numbers."""

    def register(build: Callable[..., Column]) -> Operator:
        made = Operator(build.__name__, scope, build)
        for name in (build.__name__, *aliases):
            REGISTRY[name] = made
        return made

    return register


# ---- helpers


def is_column(x: Any) -> bool:
    return isinstance(x, Column)


def col(x: Any) -> Column:
    return x if is_column(x) else F.lit(float(x) if isinstance(x, int) and not isinstance(x, bool) else x)


def num(x: Any) -> Column:
    return col(x).cast("double")


def truth(x: Any) -> Column:
    """Above zero; missing is false."""
    return F.coalesce(num(x) > 0, F.lit(False))


def finite(x: Column) -> Column:
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False))


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def ratio(x: Any, y: Any) -> Column:
    """x / y, missing where y is zero."""
    return F.when(num(y) != 0, num(x) / num(y))


def _window(s: Scope, n: int) -> WindowSpec:
    return s.time().rowsBetween(-(int(n) - 1), 0)


def _full(s: Scope, n: int, x: Column, value: Column) -> Column:
    """value where all n rows of the window hold a finite x."""
    return F.when(F.count(x).over(_window(s, n)) == int(n), value)


def _observed(x: Any) -> Column:
    """Infinite values count as missing in windows."""
    return F.when(finite(num(x)), num(x))


def _rolling(aggregate: Callable[[Column], Column]) -> Callable[..., Column]:
    def build(s: Scope, x: Any, n: int) -> Column:
        v = _observed(x)
        return _full(s, n, v, aggregate(v).over(_window(s, n)))

    return build


# ---- across a date


def scaled_rank(x: Column, by: WindowSpec) -> Column:
    """Average-tie rank of x from 0 to 1 within a window; one half for a lone value.

    The places of the first and of the last of equal values and the number of all come from one order: the rows are sorted once.
    """
    up = by.orderBy(F.asc_nulls_last(x))
    first, last = F.rank().over(up), F.count(x).over(up.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.count(x).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    place = (first + last) / 2.0
    return F.when(x.isNotNull(), F.when(n == 1, F.lit(0.5)).otherwise((place - 1) / F.greatest(n - 1, F.lit(1))))


@operator(DATE)
def rank(s: Scope, x: Any, rate: int = 0) -> Column:
    v = no_nan(num(x))
    return scaled_rank(F.bround(v, int(rate)) if rate > 0 else v, s.cross())


@operator(DATE)
def zscore(s: Scope, x: Any) -> Column:
    w = s.cross()
    return ratio(num(x) - F.avg(num(x)).over(w), F.stddev_samp(num(x)).over(w))


@operator(DATE)
def cs_mean(s: Scope, x: Any) -> Column:
    return F.avg(num(x)).over(s.cross())


@operator(DATE)
def group_zscore(s: Scope, x: Any, group: Any) -> Column:
    w = s.cross(col(group))
    return F.when(col(group).isNotNull(), ratio(num(x) - F.avg(num(x)).over(w), F.stddev_samp(num(x)).over(w)))


# ---- along a ticker


@operator(TICKER)
def ts_delay(s: Scope, x: Any, d: int) -> Column:
    return F.lag(col(x), int(d)).over(s.time())


@operator(TICKER)
def ts_delta(s: Scope, x: Any, d: int) -> Column:
    return num(x) - F.lag(num(x), int(d)).over(s.time())


@operator(TICKER)
def ts_rank(s: Scope, x: Any, d: int) -> Column:
    v, d = _observed(x), int(d)
    seen = F.collect_list(v).over(_window(s, d))
    below = F.size(F.filter(seen, lambda e: e < v))
    equal = F.size(F.filter(seen, lambda e: e == v))
    return _full(s, d, v, (below + (equal - 1) / 2.0) / (d - 1) if d > 1 else F.lit(None).cast("double"))


@operator(TICKER)
def ts_mean(s: Scope, x: Any, n: int) -> Column:
    return _rolling(F.avg)(s, x, n)


@operator(TICKER)
def sma(s: Scope, x: Any, n: int) -> Column:
    return _rolling(F.avg)(s, x, n)


@operator(TICKER)
def ts_std(s: Scope, x: Any, n: int) -> Column:
    return _rolling(F.stddev_samp)(s, x, n)


@operator(TICKER)
def ts_zscore(s: Scope, x: Any, n: int) -> Column:
    return ratio(num(x) - _rolling(F.avg)(s, x, n), _rolling(F.stddev_samp)(s, x, n))


@operator(TICKER)
def ts_sum(s: Scope, x: Any, n: int) -> Column:
    return _rolling(F.sum)(s, x, n)


@operator(TICKER)
def product(s: Scope, x: Any, n: int) -> Column:
    return _rolling(F.product)(s, x, n)


@operator(TICKER)
def ts_min(s: Scope, x: Any, n: int) -> Column:
    return _rolling(F.min)(s, x, n)


@operator(TICKER)
def ts_max(s: Scope, x: Any, n: int) -> Column:
    return _rolling(F.max)(s, x, n)


def _arg(s: Scope, x: Any, n: int, best: Callable[[Column], Column], first: int) -> Column:
    """The place of the best value, of equal ones the oldest: one struct a window, not its values."""
    v, here = _observed(x), F.row_number().over(s.time())
    found = best(F.when(v.isNotNull(), F.struct(v.alias("v"), (here * first).alias("at")))).over(_window(s, n))
    return _full(s, n, v, (found["at"] * first - here + int(n)).cast("double"))


@operator(TICKER, "ts_arg_max")
def ts_argmax(s: Scope, x: Any, n: int) -> Column:
    """From 1, the oldest row; the first of equal ones."""
    return _arg(s, x, n, F.max, -1)


@operator(TICKER, "ts_arg_min")
def ts_argmin(s: Scope, x: Any, n: int) -> Column:
    return _arg(s, x, n, F.min, 1)


@operator(TICKER)
def linear_decay(s: Scope, x: Any, n: int) -> Column:
    """Weights 1 to n, the latest row's the largest; missing counts as 0, and so do the rows before the n-th."""
    n = int(n)
    v = F.coalesce(no_nan(num(x)), F.lit(0.0))
    total = sum((F.coalesce(F.lag(v, j).over(s.time()), F.lit(0.0)) * float(n - j) for j in range(1, n)), v * float(n))
    return F.when(F.row_number().over(s.time()) >= n, total / (n * (n + 1) / 2.0)).otherwise(F.lit(0.0))


def _pairs(x: Any, y: Any) -> tuple[Column, Column]:
    a, b = _observed(x), _observed(y)
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


@operator(TICKER)
def ts_correlation(s: Scope, x: Any, y: Any, n: int) -> Column:
    a, b = _pairs(x, y)
    w = _window(s, n)
    return _full(s, n, a, ratio(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)))


@operator(TICKER)
def ts_covariance(s: Scope, x: Any, y: Any, n: int) -> Column:
    a, b = _pairs(x, y)
    return _full(s, n, a, F.covar_samp(a, b).over(_window(s, n)))


def _changed(s: Scope, x: Column) -> Column:
    """True where a run of equal values starts; missing values equal nothing."""
    return F.coalesce(x != F.lag(x).over(s.time()), F.lit(True))


@operator(TICKER)
def days_from_last_change(s: Scope, x: Any) -> Column:
    here = F.row_number().over(s.time())
    start = F.max(F.when(_changed(s, col(x)), here)).over(s.time().rowsBetween(Window.unboundedPreceding, 0))
    return (here - start + 1).cast("double")


@operator(TICKER)
def hump(s: Scope, x: Any, hump: float = 0.01) -> Column:
    v, before = num(x), F.lag(num(x)).over(s.time())
    step = v - before
    return F.when(F.abs(step) > float(hump), before + F.signum(step) * float(hump)).otherwise(v)


@operator(TICKER)
def kth_element(s: Scope, x: Any, d: int, k: int, ignore: float | None = None) -> Column:
    """The k-th value back from today, 1 being today's, among those of the last d rows that are not ignored; missing if there are fewer.

    Without ``ignore`` missing values are ignored; with it only values equal to it are, and missing ones count as values. A k below 1 is no value.
    """
    if k > d:
        raise ValueError(f"k is {k}, more than the {d} rows looked at")
    v = no_nan(num(x))
    valid = v.isNotNull() if ignore is None or ignore != ignore else v.isNull() | (v != float(ignore))
    if k < 1:
        return F.when(F.lit(False), v)
    # in a struct a missing value is kept
    return F.try_element_at(F.collect_list(F.when(valid, F.struct(v.alias("v")))).over(_window(s, d)), F.lit(-int(k)))["v"]


@operator(TICKER)
def last_diff_value(s: Scope, x: Any, d: int) -> Column:
    """The value that last started a run of equal ones in the d + 1 rows before today."""
    starts = F.when(_changed(s, col(x)), col(x))
    return F.last(starts, ignorenulls=True).over(s.time().rowsBetween(-(int(d) + 1), -1))


@operator(TICKER)
def trade_when(s: Scope, trigger: Any, signal: Any, exit: Any = -1) -> Column:
    """signal where trigger is above 0, held until the next one; missing from where exit is above 0 until then."""
    run = s.time().rowsBetween(Window.unboundedPreceding, 0)
    out = truth(exit)
    if not is_column(exit):
        return F.lit(None).cast("double") if exit > 0 else F.last(F.when(truth(trigger), num(signal)), ignorenulls=True).over(run)
    # The value held, with the row it is from; an exit after that row ends it.
    here = F.row_number().over(s.time())
    held = F.max(F.when(truth(trigger) & ~out & num(signal).isNotNull(), F.struct(here.alias("at"), num(signal).alias("v")))).over(run)
    left = F.max(F.when(out, here)).over(run)
    return F.when(~out & (held["at"] > F.coalesce(left, F.lit(0))), held["v"])


# ---- each row alone


@operator(ROW)
def round_rank(s: Scope, x: Any, rate: int = 2) -> Column:
    return F.bround(num(x), int(rate)) if rate > 0 else num(x)


@operator(ROW)
def if_else(s: Scope, condition: Any, yes: Any, no: Any) -> Column:
    return F.when(truth(condition), col(yes)).otherwise(col(no))


def boolean(x: Any) -> Column:
    return F.coalesce(col(x).cast("boolean"), F.lit(False))


@operator(ROW)
def logical_and(s: Scope, x: Any, y: Any) -> Column:
    return boolean(x) & boolean(y)


@operator(ROW)
def logical_or(s: Scope, x: Any, y: Any) -> Column:
    return boolean(x) | boolean(y)


@operator(ROW)
def add(s: Scope, x: Any, y: Any) -> Column:
    return no_nan(num(x) + num(y))


@operator(ROW)
def subtract(s: Scope, x: Any, y: Any, filter: bool = True) -> Column:
    if filter and is_column(x) and is_column(y):
        x, y = F.coalesce(num(x), F.lit(0.0)), F.coalesce(num(y), F.lit(0.0))
    return no_nan(num(x) - num(y))


@operator(ROW)
def multiply(s: Scope, *args: Any, filter: bool = True) -> Column:
    if not args:
        return F.lit(None).cast("double")
    out = F.lit(1.0)
    for a in args:
        out = out * (F.coalesce(num(a), F.lit(1.0)) if filter else num(a))
    return no_nan(out)


@operator(ROW)
def divide(s: Scope, x: Any, y: Any) -> Column:
    return no_nan(ratio(x, y))


@operator(ROW)
def inverse(s: Scope, x: Any) -> Column:
    return ratio(1.0, x)


@operator(ROW)
def power(s: Scope, x: Any, y: Any) -> Column:
    return no_nan(F.pow(num(x), num(y)))


@operator(ROW)
def signed_power(s: Scope, x: Any, y: Any) -> Column:
    return no_nan(F.signum(num(x)) * F.pow(F.abs(num(x)), num(y)))


@operator(ROW)
def reverse(s: Scope, x: Any) -> Column:
    return -num(x)
