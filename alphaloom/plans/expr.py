"""Formulas as trees: built with Python operators, read from text, written back as text."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

#: Methods of an expression that work on each row alone.
ROW_METHODS = {"abs", "fillna", "clip", "round", "isna", "notna", "astype"}


class Expr:
    """A formula. ``str`` gives text that ``parse`` reads back to an equal formula."""

    def children(self) -> tuple[Expr, ...]:
        return ()

    @property
    def fields(self) -> set[str]:
        """Names of the columns that the formula refers to."""
        return {n.name for n in walk(self) if isinstance(n, Field)}

    __repr__ = lambda self: str(self)
    __hash__ = lambda self: hash(str(self))
    __eq__ = lambda self, other: isinstance(other, Expr) and str(self) == str(other)

    def __call__(self, *args: Any, **kwargs: Any) -> None:
        raise TypeError("a formula is evaluated over a panel, not called")

    def __bool__(self) -> bool:
        raise TypeError("a formula has no truth value; combine conditions with & and |")

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in ROW_METHODS:
            raise AttributeError(f"{name!r} is no row-wise method of a formula; those are {sorted(ROW_METHODS)}")
        return lambda *args, **kwargs: Method(self, name, _arguments(args), tuple((k, as_expr(v)) for k, v in kwargs.items()))

    def __neg__(self):
        return Unary("-", self)

    def __pos__(self):
        return Unary("+", self)


@dataclass(frozen=True, eq=False, repr=False)
class Field(Expr):
    name: str

    def __str__(self) -> str:
        return self.name

    @property
    def info(self):
        from ..fields import field_info

        return field_info(self.name)

    @property
    def description(self) -> str:
        return self.info.description


@dataclass(frozen=True, eq=False, repr=False)
class Literal(Expr):
    value: Any

    def __str__(self) -> str:
        return repr(self.value)


@dataclass(frozen=True, eq=False, repr=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self) -> tuple[Expr, ...]:
        return self.left, self.right

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True, eq=False, repr=False)
class Unary(Expr):
    op: str
    operand: Expr

    def children(self) -> tuple[Expr, ...]:
        return (self.operand,)

    def __str__(self) -> str:
        return f"({self.op}{self.operand})"


def _listed(args: tuple[Expr, ...], kwargs: tuple[tuple[str, Expr], ...]) -> str:
    return ", ".join([*map(str, args), *(f"{k}={v}" for k, v in kwargs)])


@dataclass(frozen=True, eq=False, repr=False)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()
    kwargs: tuple[tuple[str, Expr], ...] = field(default=())

    def children(self) -> tuple[Expr, ...]:
        return (*self.args, *(v for _, v in self.kwargs))

    def __str__(self) -> str:
        return f"{self.name}({_listed(self.args, self.kwargs)})"


@dataclass(frozen=True, eq=False, repr=False)
class Method(Expr):
    on: Expr
    name: str
    args: tuple[Expr, ...] = ()
    kwargs: tuple[tuple[str, Expr], ...] = field(default=())

    def children(self) -> tuple[Expr, ...]:
        return (self.on, *self.args, *(v for _, v in self.kwargs))

    def __str__(self) -> str:
        return f"{self.on}.{self.name}({_listed(self.args, self.kwargs)})"


def _install(op: str, name: str, reflected: bool) -> None:
    setattr(Expr, f"__{name}__", lambda self, other: Binary(op, self, as_expr(other)))
    if reflected:
        setattr(Expr, f"__r{name}__", lambda self, other: Binary(op, as_expr(other), self))


for _op, _name, _reflected in [
    ("+", "add", True), ("-", "sub", True), ("*", "mul", True), ("/", "truediv", True), ("**", "pow", True), ("%", "mod", True),
    (">", "gt", False), (">=", "ge", False), ("<", "lt", False), ("<=", "le", False), ("&", "and", False), ("|", "or", False),
]:
    _install(_op, _name, _reflected)


def as_expr(value: Any) -> Expr:
    if isinstance(value, Expr):
        return value
    if isinstance(value, (bool, int, float)):
        return Literal(value)
    raise TypeError(f"a {type(value).__name__} cannot be part of a formula")


def _arguments(args: tuple) -> tuple[Expr, ...]:
    return tuple(Literal(a) if isinstance(a, str) else as_expr(a) for a in args)


def walk(expr: Expr) -> Iterator[Expr]:
    """The formula's nodes, arguments before what uses them."""
    for child in expr.children():
        yield from walk(child)
    yield expr


_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**", ast.Mod: "%", ast.BitAnd: "&", ast.BitOr: "|", ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<="}


def parse(text: str) -> Expr:
    """The formula that text stands for; nothing in it is executed."""
    return _read(ast.parse(text.strip(), mode="eval").body)


def _read(node: ast.AST) -> Expr:
    if isinstance(node, ast.Name):
        return Literal(float(node.id)) if node.id in ("nan", "inf") else Field(node.id)
    if isinstance(node, ast.Constant):
        return Literal(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        return Unary("-" if isinstance(node.op, ast.USub) else "+", _read(node.operand))
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return Binary(_BINARY[type(node.op)], _read(node.left), _read(node.right))
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _BINARY:
        return Binary(_BINARY[type(node.ops[0])], _read(node.left), _read(node.comparators[0]))
    if isinstance(node, ast.Call):
        args, kwargs = tuple(map(_read, node.args)), tuple((k.arg, _read(k.value)) for k in node.keywords)
        if isinstance(node.func, ast.Name):
            return Call(node.func.id, args, kwargs)
        if isinstance(node.func, ast.Attribute) and node.func.attr in ROW_METHODS:
            return Method(_read(node.func.value), node.func.attr, args, kwargs)
    raise ValueError(f"not a formula: {ast.unparse(node)}")


class _Fields:
    """``fields.close`` or ``fields["my_signal"]``: a column as a formula."""

    def __getattr__(self, name: str) -> Field:
        if name.startswith("_"):
            raise AttributeError(name)
        return Field(name)

    def __getitem__(self, name: str) -> Field:
        return Field(name)


fields = _Fields()
