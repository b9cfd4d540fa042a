"""Signals, weights and simulation: small exact tables, and invariants over a random panel."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from alphaloom.config import Delay, Neutralization, TradingPeriod
from alphaloom.operators.library import REGISTRY
from alphaloom.plans import validate as va
from alphaloom.plans import weights as w
from alphaloom.plans.backtest import Strategy, run_backtest
from alphaloom.plans.expr import fields, parse
from alphaloom.plans.signal import Alpha, apply_universe, compute_signals
from alphaloom.plans.simulate import aggregate_returns
from alphaloom.sources.panels import universe_mask, with_derived

D = date(2024, 1, 1)


def table(spark, columns: str, *rows):
    return spark.createDataFrame(list(rows), columns)


def column(df, name: str, *order: str) -> list:
    return [r[name] for r in df.orderBy(*order).collect()]


def close_to(got: list, want: list) -> None:
    assert got == pytest.approx(want, abs=1e-12, nan_ok=False) if None not in want else [g if g is None else round(g, 12) for g in got] == want


def exit_panel(spark):
    return table(spark, "date date, ticker string, close double, open double, volume double", *[(D + timedelta(days=i), "A", c, 10.0, v) for i, (c, v) in enumerate([(10.0, 200.0), (12.0, 50.0), (20.0, 10.0), (30.0, 50.0)])])


def test_constraint_and_exit(spark):
    ratio = fields.close / fields.open
    both = compute_signals(exit_panel(spark), Alpha(ratio, fields.volume > 100, fields.volume < 25))
    assert column(both, "signal", "date") == [1, 1, None, None]
    leave = compute_signals(exit_panel(spark), Alpha(ratio, exit_condition=fields.volume < 25))
    assert column(leave, "signal", "date") == [1, 1.2, None, 3]


def test_trade_when_is_taken_apart():
    alpha = Alpha(REGISTRY["trade_when"](fields.volume > 100, fields.close, fields.volume < 25))
    assert str(alpha.signals["signal"]) == "close" and [str(c) for c in alpha.constraints.values()] == ["(volume > 100)"] and str(alpha.exit_condition) == "(volume < 25)"
    by_name = Alpha(REGISTRY["trade_when"](trigger=fields.volume > 100, signal=fields.close))
    assert str(by_name.signals["signal"]) == "close" and not by_name.has_exit_condition
    assert alpha.fields == ["close", "volume"]


def test_wrong_alphas():
    for wrong in (lambda: Alpha("close"), lambda: Alpha(fields.close, exit_condition=3), lambda: Alpha(fields.close, exit_condition=True)):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(ValueError):
        Alpha(fields.close, signals=[fields.open])


def test_universe(spark):
    pit = table(spark, "date date, ticker string, close double, open double, in_universe boolean", (D, "A", 12.0, 10.0, True), (D + timedelta(1), "A", 10.0, 5.0, False), (D, "B", 6.0, 3.0, True), (D + timedelta(1), "B", 8.0, 8.0, True))
    out = apply_universe(pit.withColumn("s", F.col("close") / F.col("open")), ["s"])
    assert column(out, "s", "ticker", "date") == [1.2, None, 2, 1]
    liquid = table(spark, "date date, ticker string, adv20 double", *[(D + timedelta(d), t, v) for d, vs in enumerate([(40.0, 30.0, 20.0, 10.0), (10.0, 20.0, 30.0, 40.0)]) for t, v in zip("ABCD", vs, strict=True)])
    assert column(universe_mask(liquid, 2), "in_universe", "date", "ticker") == [True, True, False, False, False, False, True, True]
    missing = table(spark, "date date, ticker string, adv20 double", (D, "A", 40.0), (D, "B", None), (D, "C", 20.0))
    assert column(universe_mask(missing, 3), "in_universe", "ticker") == [True, False, True]


def test_neutralize_and_normalize(spark):
    df = table(spark, "date date, ticker string, sector string, signal double", (D, "A", "x", 1.0), (D, "B", "x", 3.0), (D, "C", "y", 10.0), (D, "D", "y", 20.0), (D, "E", None, 5.0), (D, "F", "x", None))
    assert column(w.group_neutralize(df, Neutralization.SECTOR), "weights", "ticker") == [-1, 1, -5, 5, 0, 0]
    with pytest.raises(ValueError):
        w.group_neutralize(df, Neutralization.INDUSTRY)
    assert w.compute_weights(df, neutralization=Neutralization.SECTOR).count() == 6
    with pytest.raises(Exception, match="more than one row for"):
        w.compute_weights(df.union(df), neutralization=Neutralization.SECTOR).collect()
    near = table(spark, "date date, ticker string, signal double", *[(D, t, 0.1 + 0.2) for t in "AB"], (D, "C", 0.3))
    exact, quiet = (w.group_neutralize(near, Neutralization.MARKET, noise=n) for n in (0.0, 1e-12))
    assert any(column(exact, "weights", "ticker")) and column(quiet, "weights", "ticker") == [0, 0, 0]
    days = table(spark, "date date, ticker string, weights double", (D, "A", 2.0), (D, "B", -1.0), (D, "C", 1.0), (D + timedelta(1), "A", 0.0), (D + timedelta(1), "B", 0.0))
    assert column(w.normalize(days), "weights", "date", "ticker") == [0.5, -0.25, 0.25, 0, 0]


def test_caps(spark):
    df = table(spark, "date date, ticker string, weights double", (D, "A", 0.6), (D, "B", 0.25), (D, "C", 0.15))
    close_to(column(w.truncate_gross(df, 0.4), "weights", "ticker"), [0.4, 0.375, 0.225])
    close_to(column(w.truncate_neutral(df, 0.4, []), "weights", "ticker"), [0.4, 0.25, 0.15])


def loop_fill(v: list[float], total: float, cap: float) -> list[float]:
    """Water-filling round by round."""
    out, open_, left = [0.0] * len(v), [i for i, x in enumerate(v) if x > 0], min(total, cap * sum(x > 0 for x in v))
    while open_:
        scale = left / sum(v[i] for i in open_)
        over = [i for i in open_ if v[i] * scale > cap * (1 + 1e-12)]
        if not over:
            for i in open_:
                out[i] = v[i] * scale
            break
        for i in over:
            out[i] = cap
        left -= cap * len(over)
        open_ = [i for i in open_ if i not in over]
    return out


def test_cap_is_the_loop_of_redistribution(spark):
    import random

    rng, rows, want = random.Random(5), [], []
    for d in range(60):
        v = [rng.choice([0.0, rng.random() ** 4, 0.3, rng.random()]) for _ in range(rng.randint(1, 12))]
        total = sum(v) or 1.0
        v = [x / total for x in v]
        if max(v) > 0.2:
            want += loop_fill(v, 1.0, 0.2)
        else:
            want += v
        rows += [(D + timedelta(days=d), f"{i:02d}", x) for i, x in enumerate(v)]
    got = column(w.truncate_gross(table(spark, "date date, ticker string, weights double", *rows), 0.2), "weights", "date", "ticker")
    assert got == pytest.approx(want, abs=1e-9)


def test_decay(spark):
    df = table(spark, "date date, ticker string, weights double", *[(D + timedelta(i), "A", x) for i, x in enumerate([0.2, 0.5, 0.3])])
    assert column(w.apply_decay(df, 1), "weights", "date") == pytest.approx([0.2, 0.5, 0.3])
    for wrong in (-1, 1.5, True):
        with pytest.raises(ValueError):
            w.apply_decay(df, wrong)


@pytest.mark.parametrize("kind", ["NONE", "MARKET", "SECTOR", "INDUSTRY"])
@pytest.mark.parametrize("cap", [0.0, 0.1])
def test_weights_are_valid(walk, kind, cap):
    df = compute_signals(with_derived(walk, ["returns"]), Alpha(parse("-rank(ts_zscore(returns, 20))")))
    out = w.compute_weights(df, neutralization=Neutralization[kind], decay=5, truncation=cap)
    assert va.are_weights_valid(out, Neutralization[kind], cap), va.are_weights_valid(out, Neutralization[kind], cap)


def test_a_bad_table_of_weights_is_found(spark):
    df = table(spark, "date date, ticker string, weights double", (D, "A", 0.9), (D, "B", 0.4), (D, "C", float("inf")))
    report = va.are_weights_valid(df, Neutralization.MARKET, 0.5)
    assert not report and not report.checks["not_nan"] and not report.checks["under_max_weight"] and not report.checks["group_neutral"] and "failed not_nan, under_max_weight" in str(report)
    assert va.are_weights_valid(df.withColumn("weights", F.lit(0.0))).checks == {"has_active_positions": False}
    with pytest.raises(ValueError):
        va.are_weights_valid(df.limit(0))


def test_look_ahead_and_shift(walk):
    """A signal that knows tomorrow's return pays at delay 0 only, and delay 1 is delay 0 a row later."""
    panel = with_derived(walk, ["returns"]).withColumn("tomorrow", F.expr("lead(returns) over (partition by ticker order by date)"))
    run = {d: run_backtest(Strategy(Alpha(fields.tomorrow), delay=d, neutralization="market"), panel, book_size=1e6, display=False) for d in Delay}
    t = {d: r.portfolio.agg(F.avg("pnl") / F.stddev_samp("pnl") * F.sqrt(F.count("*"))).first()[0] for d, r in run.items()}
    assert t[Delay.ZERO] > 20 and abs(t[Delay.ONE]) < 3.5
    weights = {d: column(r.panel.where("ticker = 'T03'"), "weights", "date") for d, r in run.items()}
    assert weights[Delay.ONE][1:] == weights[Delay.ZERO][:-1]


def test_identities(walk):
    book = 1e6
    run = run_backtest(Strategy(Alpha(parse("-returns")), decay=3, truncation=0.1, neutralization="sector"), with_derived(walk, ["returns"]), book_size=book, display=False)
    p = run.portfolio
    assert p.where(F.abs(F.col("ret") - F.col("pnl") / book) > 1e-12).isEmpty() and p.where(F.abs(F.col("turnover") - F.col("trade_volume") / book) > 1e-12).isEmpty()
    year, total = aggregate_returns(p, "full", book_size=book).first(), p.agg(F.sum("pnl")).first()[0]
    assert year["pnl"] == pytest.approx(total) and run.figures()["Total PnL"] == round(total, 2)
    assert all(map(bool, run.validate().values())) and run.display()
    with pytest.raises(ValueError):
        run_backtest(Alpha(fields.returns), walk, book_size=0)


def test_corporate_actions(spark):
    rows = [(D, "A", 10.0, 0.0, 0.0), (D + timedelta(1), "A", 10.0, 0.0, 0.0), (D + timedelta(2), "A", 5.0, 0.0, 2.0), (D, "B", 20.0, 0.0, 0.0), (D + timedelta(1), "B", 20.0, 0.0, 0.0), (D + timedelta(2), "B", 19.5, 0.5, 0.0)]
    df = with_derived(table(spark, "date date, ticker string, close double, dividends double, splits double", *rows), ["returns"])
    assert column(df, "returns", "ticker", "date") == [None, 0, 0, None, 0, 0]


def test_settings():
    assert Neutralization("sector") is Neutralization.SECTOR and Neutralization("Market").keys == ["date"]
    period = TradingPeriod("2024-01-01", "2024-01-31", "JAN")
    assert period.days == 30 and period.contains("2024-01-31") and not period.overlaps(TradingPeriod("2024-02-01", "2024-02-02"))
    assert period.contains(TradingPeriod("2 Jan 2024", "January 31, 2024")) and not period.contains(TradingPeriod("2024-01-02", "2024-02-01"))
    assert str(period) == "JAN: 2024-01-01 to 2024-01-31 (30 days)" and period.update(name="") != period and hash(period) == hash(TradingPeriod(date(2024, 1, 1), "2024/01/31", "JAN"))
    with pytest.raises(ValueError):
        period.update(end="2023-01-01")
    s = Strategy(Alpha(fields.close))
    for name, wrong in (("delay", 1), ("decay", -1), ("decay", True), ("truncation", 2), ("neutralization", "tribe")):
        with pytest.raises(ValueError):
            setattr(s, name, wrong)
    with pytest.raises(AttributeError):
        s.region = s.region
