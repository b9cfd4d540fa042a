"""Operators against values worked out by hand."""

from __future__ import annotations

import math
from datetime import date, timedelta

import pytest

from alphaloom.operators.library import REGISTRY
from alphaloom.plans.expr import Field, fields, parse
from alphaloom.plans.lower import evaluate

X = [1.0, 2.0, 4.0, 8.0, 7.0, 3.0]
N = None


def number(x):
    return float(x) if isinstance(x, int) else x


def along(spark, text: str, **columns: list) -> list:
    """The formula over one ticker's rows, whose columns are given."""
    n = len(next(iter(columns.values())))
    rows = [(date(2024, 1, 1) + timedelta(days=i), "A", *(number(c[i]) for c in columns.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "date date, ticker string, " + ", ".join(f"{c} double" for c in columns))
    return [r["v"] for r in evaluate(df, {"v": parse(text)}).orderBy("date").collect()]


def across(spark, text: str, **columns: list) -> list:
    """The formula over one date's tickers."""
    n = len(next(iter(columns.values())))
    kinds = {c: "string" if any(isinstance(v, str) for v in vs) else "double" for c, vs in columns.items()}
    df = spark.createDataFrame([(date(2024, 1, 1), f"T{i}", *(number(c[i]) for c in columns.values())) for i in range(n)], "date date, ticker string, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return [r["v"] for r in evaluate(df, {"v": parse(text)}).orderBy("ticker").collect()]


def same(got: list, want: list) -> None:
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-9), (got, want)


DEV = lambda xs: math.sqrt(sum((x - sum(xs) / len(xs)) ** 2 for x in xs) / (len(xs) - 1))


@pytest.mark.parametrize(("text", "want"), [
    ("ts_delay(x, 2)", [N, N, 1, 2, 4, 8]),
    ("ts_delay(x, -1)", [2, 4, 8, 7, 3, N]),
    ("ts_delta(x, 1)", [N, 1, 2, 4, -1, -4]),
    ("ts_mean(x, 3)", [N, N, 7 / 3, 14 / 3, 19 / 3, 6]),
    ("sma(x, 2)", [N, 1.5, 3, 6, 7.5, 5]),
    ("ts_sum(x, 3)", [N, N, 7, 14, 19, 18]),
    ("ts_std(x, 3)", [N, N, DEV([1, 2, 4]), DEV([2, 4, 8]), DEV([4, 8, 7]), DEV([8, 7, 3])]),
    ("ts_min(x, 3)", [N, N, 1, 2, 4, 3]),
    ("ts_max(x, 3)", [N, N, 4, 8, 8, 8]),
    ("product(x, 3)", [N, N, 8, 64, 224, 168]),
    ("ts_zscore(x, 3)", [N, N, (4 - 7 / 3) / DEV([1, 2, 4]), (8 - 14 / 3) / DEV([2, 4, 8]), (7 - 19 / 3) / DEV([4, 8, 7]), (3 - 6) / DEV([8, 7, 3])]),
    ("ts_rank(x, 3)", [N, N, 1, 1, 0.5, 0]),
    ("ts_argmax(x, 3)", [N, N, 3, 3, 2, 1]),
    ("ts_arg_min(x, 3)", [N, N, 1, 1, 1, 3]),
    ("ts_correlation(x, x, 4)", [N, N, N, 1, 1, 1]),
    ("ts_correlation(x, -x, 4)", [N, N, N, -1, -1, -1]),
    ("ts_covariance(x, x, 3)", [N, N, *(DEV(w) ** 2 for w in ([1, 2, 4], [2, 4, 8], [4, 8, 7], [8, 7, 3]))]),
    ("linear_decay(x, 3)", [0, 0, (1 + 4 + 12) / 6, (2 + 8 + 24) / 6, (4 + 16 + 21) / 6, (8 + 14 + 9) / 6]),
    ("hump(x, hump=1)", [1, 2, 3, 5, 7, 6]),
    ("kth_element(x, 3, 1)", X),
    ("kth_element(x, 3, 3)", [N, N, 1, 2, 4, 8]),
    ("kth_element(x, 3, 1, ignore=8)", [1, 2, 4, 4, 7, 3]),
    ("last_diff_value(x, 2)", [N, 1, 2, 4, 8, 7]),
    ("ts_mean(ts_delta(x, 1), 2)", [N, N, 1.5, 3, 1.5, -2.5]),
])
def test_along_a_ticker(spark, text, want):
    same(along(spark, text, x=X), want)


def test_missing_and_infinite_values_in_windows(spark):
    same(along(spark, "ts_mean(x, 2)", x=[1, N, 3, math.inf, 5, 7]), [N, N, N, N, N, 6])
    same(along(spark, "linear_decay(x, 2)", x=[3, N, 6]), [0, 1, 4])
    same(along(spark, "ts_zscore(x, 3)", x=[2, 2, 2]), [N, N, N])
    same(along(spark, "ts_correlation(x, y, 3)", x=[1, 2, 3], y=[5, 5, 5]), [N, N, N])


def test_runs(spark):
    same(along(spark, "days_from_last_change(x)", x=[1, 1, 2, 2, 2]), [1, 2, 1, 2, 3])
    same(along(spark, "days_from_last_change(x)", x=[1, N, N, 2]), [1, 1, 1, 1])
    same(along(spark, "last_diff_value(x, 3)", x=[5, 5, 6, 6, 6]), [N, 5, 5, 6, 6])


def test_trade_when(spark):
    same(along(spark, "trade_when(t, x)", t=[0, 1, 0, 0, 1, 0], x=X), [N, 2, 2, 2, 7, 7])
    same(along(spark, "trade_when(t, x, e)", t=[1, 0, 0, 0], e=[0, 0, 1, 0], x=[1, 2, 3, 4]), [1, 1, N, N])
    same(along(spark, "trade_when(t, x)", t=[1, 1, 0], x=[1, N, 3]), [1, 1, 1])
    same(along(spark, "trade_when(t, x, e)", t=[1, 0, 1, 0], e=[0, 1, 0, 0], x=[1, 2, 3, 4]), [1, N, 3, 3])


@pytest.mark.parametrize(("text", "x", "want"), [
    ("rank(x)", [1, 3, 2], [0, 1, 0.5]),
    ("rank(x)", [2, 2, 1], [0.75, 0.75, 0]),
    ("rank(x)", [5], [0.5]),
    ("rank(x)", [N, 1, 3], [N, 0, 1]),
    ("rank(x)", [N, N], [N, N]),
    ("rank(x)", [math.inf, 1.0, 2.0], [1, 0, 0.5]),
    ("rank(x, 1)", [1.01, 1.02, 2], [0.25, 0.25, 1]),
    ("zscore(x)", [1, 2, 3], [-1, 0, 1]),
    ("zscore(x)", [2, 2, N], [N, N, N]),
    ("cs_mean(x)", [1, 2, 6], [3, 3, 3]),
])
def test_across_a_date(spark, text, x, want):
    same(across(spark, text, x=x), want)


def test_group_zscore(spark):
    r = math.sqrt(0.5)
    same(across(spark, "group_zscore(x, g)", x=[1, 3, 10, 20, 5], g=["a", "a", "b", "b", None]), [-r, r, -r, r, N])


@pytest.mark.parametrize(("text", "x", "y", "want"), [
    ("divide(x, y)", [1, 3], [0, 2], [N, 1.5]),
    ("inverse(x)", [0, 4], [0, 0], [N, 0.25]),
    ("signed_power(x, 0.5)", [-4, 9], [0, 0], [-2, 3]),
    ("power(x, 0.5)", [-8, 9], [0, 0], [N, 3]),
    ("if_else(x, 10, 20)", [1, 0, N], [0, 0, 0], [10, 20, 20]),
    ("subtract(x, y)", [N, 3], [1, N], [-1, 3]),
    ("subtract(x, y, filter=False)", [N, 3], [1, N], [N, N]),
    ("multiply(x, y)", [N, 3], [2, N], [2, 3]),
    ("multiply(x, y, filter=False)", [N, 3], [2, 2], [N, 6]),
    ("reverse(x)", [1, N], [0, 0], [-1, N]),
    ("round_rank(x, 2)", [0.125, 0.375], [0, 0], [0.12, 0.38]),
    ("(x / y)", [1, -1, 0, 6], [0, 0, 0, 3], [math.inf, -math.inf, N, 2]),
    ("(x % y)", [-7, 7, 7], [3, -3, 0], [2, -2, N]),
    ("(x ** y)", [2, -8], [3, 0.5], [8, N]),
    ("(x > y)", [1, N, 3], [0, 1, 3], [True, False, False]),
    ("((x > 0) & (y > 0))", [1, 1, N], [1, 0, 1], [True, False, False]),
    ("x.fillna(7).clip(0, 5)", [N, -1, 3], [0, 0, 0], [5, 0, 3]),
])
def test_within_a_row(spark, text, x, y, want):
    got = across(spark, text, x=x, y=y)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w or (g is not None and w is not None and abs(g - w) < 1e-9), (got, want)


def test_registry_has_every_operator():
    names = "cs_mean rank ts_delay ts_rank ts_delta zscore ts_mean ts_std ts_zscore group_zscore sma ts_sum product ts_min ts_max ts_argmax ts_argmin linear_decay ts_correlation ts_covariance days_from_last_change hump kth_element last_diff_value trade_when if_else logical_and logical_or add subtract divide inverse multiply power reverse signed_power round_rank ts_arg_max ts_arg_min"
    assert set(names.split()) <= set(REGISTRY)


def test_text_of_formulas():
    e = -REGISTRY["rank"](REGISTRY["ts_zscore"](fields.returns, 20))
    assert str(e) == "(-rank(ts_zscore(returns, 20)))" and parse(str(e)) == e and e.fields == {"returns"}
    assert str(2 * fields.close + 1 > fields.open) == "(((2 * close) + 1) > open)"
    for wrong in ("import os", "close.__class__", "close == open", "[close]", "f(x)(y)"):
        with pytest.raises((ValueError, SyntaxError)):
            parse(wrong)
    for wrong in (lambda: fields.close(1), lambda: bool(fields.close > 1), lambda: fields.close + "a"):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(AttributeError):
        Field("close").rolling(3)


def test_shared_windows_use_two_exchanges(walk):
    plan = evaluate(walk, {"v": parse("-rank(ts_zscore(close, 20)) + rank(ts_mean(close, 5))")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
