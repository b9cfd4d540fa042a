"""Alphas: named signals with shared constraints and an exit, and their evaluation over a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Universe
from ..operators.library import REGISTRY, Scope, boolean, num, truth
from ..sources.panels import universe_mask
from .expr import Call, Expr, Field, Literal, Unary
from .lower import Lowering, evaluate, scope_of


def _named(single: Any, several: Any, stem: str) -> dict[str, Expr]:
    if single is not None and several is not None:
        raise ValueError(f"give {stem} or {stem}s, not both")
    given = single if single is not None else several
    if given is None:
        return {}
    if isinstance(given, Expr):
        given = {stem: given}
    elif isinstance(given, Sequence) and not isinstance(given, str):
        given = {stem: given[0]} if len(given) == 1 else {f"{stem}_{i}": e for i, e in enumerate(given)}
    if not isinstance(given, Mapping) or not all(isinstance(e, Expr) for e in given.values()):
        raise TypeError(f"a {stem} is a formula, a list of formulas or a dict of them")
    return dict(given)


class Alpha:
    """Signals, constraints (all must hold to enter) and an exit condition.

    A signal that is exactly trade_when(trigger, value, exit) is taken apart: the trigger joins the
    constraints, the value is the signal, and the first such exit becomes the exit condition. Both then
    hold for every signal.
    """

    def __init__(self, signal: Any = None, constraint: Any = None, exit_condition: Any = None, *, signals: Any = None, constraints: Any = None) -> None:
        self._signals = _named(signal, signals, "signal")
        self._constraints = _named(constraint, constraints, "constraint")
        self.exit_condition = exit_condition
        self._take_apart()

    @staticmethod
    def signal(name: str) -> Field:
        """A generated signal as part of a later formula."""
        return Field(name)

    @property
    def signals(self) -> dict[str, Expr]:
        return dict(self._signals)

    @property
    def constraints(self) -> dict[str, Expr]:
        return dict(self._constraints)

    @property
    def exit_condition(self) -> Expr | None:
        return self._exit

    @exit_condition.setter
    def exit_condition(self, value: Any) -> None:
        if isinstance(value, Expr):
            self._exit = value
        elif value is None or isinstance(value, (int, float)) and not isinstance(value, bool) and value == -1:
            self._exit = None
        else:
            raise TypeError("an exit condition is a formula, None or -1")

    @property
    def has_exit_condition(self) -> bool:
        return self._exit is not None

    @property
    def generated_fields(self) -> set[str]:
        return set(self._signals)

    @property
    def fields(self) -> list[str]:
        """The panel columns that the alpha needs."""
        exprs = [*self._signals.values(), *self._constraints.values(), *([self._exit] if self._exit is not None else [])]
        return sorted(set().union(*(e.fields for e in exprs)) - self.generated_fields) if exprs else []

    def _take_apart(self) -> None:
        for name, e in list(self._signals.items()):
            if not (isinstance(e, Call) and e.name == "trade_when"):
                continue
            given = dict(zip(("trigger", "signal", "exit"), e.args, strict=False)) | dict(e.kwargs)
            key, n = f"{name}_trigger", 1
            while key in self._constraints:
                key, n = f"{name}_trigger_{n}", n + 1
            self._constraints[key] = given["trigger"]
            self._signals[name] = given["signal"]
            leave = given.get("exit", Literal(-1))
            none = isinstance(leave, Literal) or isinstance(leave, Unary) and isinstance(leave.operand, Literal)
            if not none and self._exit is None:
                self._exit = leave

    def add_signal(self, name: str, e: Expr) -> None:
        self.update_signals({name: e})

    def add_constraint(self, name: str, e: Expr) -> None:
        self.update_constraints({name: e})

    def update_signals(self, new: Any) -> None:
        self._signals |= _named(None, new, "signal")
        self._take_apart()

    def update_constraints(self, new: Any) -> None:
        self._constraints |= _named(None, new, "constraint")

    def replace_signals(self, new: Any) -> None:
        self._signals = _named(None, new, "signal")
        self._take_apart()

    def replace_constraints(self, new: Any) -> None:
        self._constraints = _named(None, new, "constraint")


def compute_signals(df: DataFrame, alpha: Alpha, *, point_in_time: bool = True, universe: int | Universe | None = None) -> DataFrame:
    """df with the alpha's signals as columns: evaluated in order, gated, then blanked outside the universe.

    The universe is df's column in_universe. Where that is missing, ``universe`` makes it, after the formulas: it then shares the
    dates' partitioning with what follows.
    """
    if universe is not None and "in_universe" in alpha.fields and "in_universe" not in df.columns:
        df = universe_mask(df, universe)
    out = apply_constraints(evaluate(df, alpha.signals), alpha)
    if universe is not None and "in_universe" not in out.columns:
        out = universe_mask(out, universe)
    return apply_universe(out, list(alpha.signals)) if point_in_time else out


def apply_constraints(df: DataFrame, alpha: Alpha, fill: float | None = None) -> DataFrame:
    """Signals enter where all constraints are non-zero, are held until the next entry, and end at an exit."""
    if not alpha.constraints and not alpha.has_exit_condition:
        return df
    scope = scope_of(df)
    low = Lowering(df, scope)
    tests = low.columns([*alpha.constraints.values(), *([alpha.exit_condition] if alpha.has_exit_condition else [])])
    n = len(alpha.constraints)
    enter = F.lit(True)
    for c in tests[:n]:
        enter = enter & F.coalesce(num(c) != 0, F.lit(False))
    leave = truth(tests[n]) if alpha.has_exit_condition else -1
    gated = low.df.withColumns({"_enter": enter.cast("double")} | ({"_leave": leave.cast("double")} if alpha.has_exit_condition else {}))
    trade = REGISTRY["trade_when"].build
    exit_ = F.col("_leave") if alpha.has_exit_condition else -1
    held = {s: trade(scope, F.col("_enter"), F.col(f"`{s}`"), exit_) for s in alpha.signals}
    if fill is not None:
        held = {s: F.coalesce(c, F.lit(float(fill))) for s, c in held.items()}
    return gated.withColumns(held).select(*[F.col(f"`{c}`") for c in df.columns])


def constraint_mask(df: DataFrame, alpha: Alpha) -> DataFrame:
    """df with a boolean column ``mask``: whether all constraints hold."""
    low = Lowering(df)
    mask = F.lit(True)
    for c in low.columns(list(alpha.constraints.values())):
        mask = mask & F.coalesce(num(c) != 0, F.lit(False))
    return low.df.withColumn("mask", mask).select(*df.columns, "mask")


def apply_universe(df: DataFrame, signals: list[str], flag: str = "in_universe") -> DataFrame:
    """Signals are missing where the row is not in the universe of its date; ranks have seen all rows."""
    if flag not in df.columns:
        return df
    return df.withColumns({s: F.when(boolean(F.col(flag)), F.col(f"`{s}`")) for s in signals})


def _equal_weight() -> Expr:
    return REGISTRY["if_else"](Field("close") > 0, 1, 0)


def benchmark_alphas() -> dict[str, Alpha]:
    """Equal weights, inverse volatility and market capitalisation."""
    return {"equal_weight": Alpha(_equal_weight()), "inverse_volatility": Alpha(REGISTRY["inverse"](Field("volatility20"))), "market_cap": Alpha(Field("market_cap"))}


__all__ = ["Alpha", "Scope", "Window", "apply_constraints", "apply_universe", "benchmark_alphas", "compute_signals", "constraint_mask"]
