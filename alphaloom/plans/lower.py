"""From formulas to columns of a panel.

A formula alternates between scopes: along a ticker, across a date, within a row. A scope
costs a shuffle each time it is entered, so formulas are lowered together: every windowed
sub-formula becomes one column, shared by all that use it, and columns are added level by level,
those of one level and scope next to each other. Catalyst then runs all windows of a level
over one exchange.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.library import DATE, REGISTRY, ROW, TICKER, Operator, Scope, boolean, col, no_nan, num
from .expr import Binary, Call, Expr, Field, Literal, Method, Unary, walk


def scope_of(df: DataFrame, ticker: str = "ticker", date: str = "date") -> Scope:
    return Scope(ticker if ticker in df.columns else None, date if date in df.columns else None)


def operator_named(name: str) -> Operator:
    if name not in REGISTRY:
        raise ValueError(f"{name!r} is not an operator")
    return REGISTRY[name]


def _row_binary(op: str, x: Any, y: Any) -> Column:
    if op == "&":
        return boolean(x) & boolean(y)
    if op == "|":
        return boolean(x) | boolean(y)
    if op in (">", ">=", "<", "<="):
        a, b = num(x), num(y)
        a, b = no_nan(a), no_nan(b)
        return F.coalesce({">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op], F.lit(False))
    a, b = num(x), num(y)
    if op == "/":
        inf = F.lit(float("inf"))
        return no_nan(F.when(b != 0, a / b).when(a > 0, inf).when(a < 0, -inf))
    if op == "%":
        return no_nan(F.when(b != 0, a - F.floor(a / b) * b))
    if op == "**":
        return no_nan(F.pow(a, b))
    return no_nan({"+": a + b, "-": a - b, "*": a * b}[op])


def _row_method(name: str, x: Column, args: list, kwargs: dict) -> Column:
    if name == "abs":
        return F.abs(num(x))
    if name == "fillna":
        return F.coalesce(x, col(args[0] if args else kwargs["value"]))
    if name == "clip":
        low, high = [*args, None, None][:2] if args else (kwargs.get("lower"), kwargs.get("upper"))
        out = num(x)
        out = F.when(out < num(low), num(low)).otherwise(out) if low is not None else out
        return F.when(out > num(high), num(high)).otherwise(out) if high is not None else out
    if name == "round":
        return F.bround(num(x), int(args[0] if args else kwargs.get("decimals", 0)))
    if name == "isna":
        return x.isNull()
    if name == "notna":
        return x.isNotNull()
    return x.cast({"float": "double", "int": "bigint", "bool": "boolean", "str": "string"}.get(str(args[0]), str(args[0])))


class Lowering:
    """Adds the windowed parts of formulas to a panel as columns and gives Columns for the formulas."""

    def __init__(self, df: DataFrame, scope: Scope | None = None) -> None:
        self.df, self.scope, self.made = df, scope or scope_of(df), {}

    def _windowed(self, e: Expr) -> str | None:
        """The scope of a windowed call, None for what is row-wise."""
        if isinstance(e, Call) and operator_named(e.name).scope != ROW:
            return operator_named(e.name).scope
        return None

    def _level(self, e: Expr) -> int:
        """How many changes of scope lie below a windowed call."""
        own, deepest = self._windowed(e), 0
        for child in e.children():
            for inner in walk(child):
                if s := self._windowed(inner):
                    deepest = max(deepest, self._level(inner) + (s != own))
        return deepest

    def columns(self, exprs: list[Expr]) -> list[Column]:
        parts: dict[str, tuple[Expr, int]] = {}
        for e in exprs:
            for n in walk(e):
                if self._windowed(n) and str(n) not in self.made:
                    parts.setdefault(str(n), (n, self._level(n)))
        for text, (n, _) in sorted(parts.items(), key=lambda p: (p[1][1], self._windowed(p[1][0]), len(p[0]))):
            name = f"_w{len(self.made)}"
            found = operator_named(n.name)
            if hasattr(found, "apply"):
                self.df = found.apply(self.df, self.scope, name, *(self._value(a) for a in n.args))
            else:
                self.df = self.df.withColumn(name, self._build(n))
            self.made[text] = name
        return [col(self._value(e)) for e in exprs]

    def _value(self, e: Expr) -> Any:
        """A Column, or a plain number or string for a literal."""
        if str(e) in self.made:
            return F.col(self.made[str(e)])
        if isinstance(e, Literal):
            return e.value
        if isinstance(e, Field):
            if e.name not in self.df.columns:
                raise KeyError(f"the panel has no column {e.name!r}")
            return F.col(f"`{e.name}`")
        if isinstance(e, Unary):
            v = self._value(e.operand)
            if isinstance(v, (int, float)):
                return -v if e.op == "-" else v
            return -num(v) if e.op == "-" else v
        if isinstance(e, Binary):
            return _row_binary(e.op, self._value(e.left), self._value(e.right))
        if isinstance(e, Method):
            return _row_method(e.name, col(self._value(e.on)), [self._value(a) for a in e.args], {k: self._value(v) for k, v in e.kwargs})
        return self._build(e)

    def _build(self, e: Call) -> Column:
        args = [self._value(a) for a in e.args]
        kwargs = {k: self._value(v) for k, v in e.kwargs}
        found = operator_named(e.name)
        out = found.build(self.scope, *args, **kwargs)
        # rows without the key that groups them are in no group
        key = {TICKER: self.scope.ticker, DATE: self.scope.date}.get(found.scope)
        return F.when(F.col(key).isNotNull(), out) if key else out

    def result(self, named: dict[str, Expr]) -> DataFrame:
        """The panel with a column a formula, without the windowed parts' columns."""
        cols = self.columns(list(named.values()))
        kept = [c for c in self.df.columns if c not in self.made.values() and c not in named]
        return self.df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in zip(named, cols, strict=True)])


def evaluate(df: DataFrame, named: dict[str, Expr], scope: Scope | None = None) -> DataFrame:
    """df with a column for each named formula; later formulas may use earlier ones' names."""
    for group in _independent(named):
        df = Lowering(df, scope).result(group)
    return df


def _independent(named: dict[str, Expr]) -> list[dict[str, Expr]]:
    groups: list[dict[str, Expr]] = [{}]
    for name, e in named.items():
        if e.fields & groups[-1].keys():
            groups.append({})
        groups[-1][name] = e
    return groups
