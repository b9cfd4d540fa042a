"""The bar store, saved runs, attribution, dashboard tables, streams, and the registered queries."""

from __future__ import annotations

import json
import pathlib
from datetime import date, timedelta

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alphaloom import queries as queries_module
from alphaloom import store_queries as engine
from alphaloom.config import Neutralization, TradingPeriod, Universe
from alphaloom.fields import field_info, with_dependencies
from alphaloom.plans import attribution as at
from alphaloom.plans import dashboard as db
from alphaloom.plans import validate as va
from alphaloom.plans.backtest import Strategy, run_backtest
from alphaloom.plans.expr import fields, parse
from alphaloom.plans.signal import Alpha
from alphaloom.plans.validate import validate_backtest
from alphaloom.sources import provider, runs
from alphaloom.sources.bars import BarStore, build_signals_from_data, get_tickers, requested_names
from alphaloom.sources.provider import by_list
from alphaloom.sources.panels import to_long, with_derived
from alphaloom.sources.runs import load_backtest, read_page, run_name, save_backtest
from alphaloom.queries import weekly
from alphaloom.streaming.stateless import stream_bars, stream_fields, stream_signal

D = date(2024, 1, 1)


def bars_of(spark, tickers, start, end):
    rows = [(start + timedelta(days=i), t, 10.0 + i + n, 11.0, 9.0, 10.0 + i, 100.0, 0.0, 0.0) for n, t in enumerate(tickers) for i in range((end - start).days + 1)]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double, dividends double, splits double")


def test_store(spark, tmp_path):
    asked = []

    def download(tickers, start, end):
        asked.append(tuple(tickers))
        return bars_of(spark, tickers, start, end)

    store = BarStore(spark, str(tmp_path / "bars"), by_list(download), buckets=4)
    end = D + timedelta(days=9)
    assert store.load_bars(["A", "B"], D, end).count() == 20 and asked == [("A", "B")]
    assert store.load_bars(["A", "B", "C"], D, end).count() == 30 and asked[1:] == [("C",)]
    assert store.load_bars(["A"], D + timedelta(days=3), D + timedelta(days=5), offline=True).count() == 3
    with pytest.raises(FileNotFoundError, match="Z"):
        store.load_bars(["A", "Z"], D, end, offline=True)
    store.write_static(spark.createDataFrame([("A", "x", "y", 5.0), ("B", "x", "z", 6.0)], "ticker string, sector string, industry string, shares_outstanding double"))
    store.write_static(spark.createDataFrame([("A", "q", "y", 7.0)], "ticker string, sector string, industry string, shares_outstanding double"))
    out = store.load_variables([fields.market_cap, "returns", "sector"], tickers=["A", "B"], start=D, end=end)
    assert set(out.columns) == {"date", "ticker", "market_cap", "returns", "sector"} and out.where("ticker = 'A'").first()["sector"] == "q"
    n = len(asked)
    part = store.load_variables("returns", tickers=["A"], start=D, end=D + timedelta(days=4))
    assert part.columns == ["date", "ticker", "returns"] and part.count() == 5 and len(asked) == n
    assert "static" not in store.load_variables("returns", tickers=["C"], start=D, end=end)._jdf.queryExecution().toString()
    assert store.benchmark_closes(["A", "B"], D, end).columns == ["date", "A", "B"]
    built = store.build_data(Alpha(parse("rank(close)")), tickers=["A", "B"], start=D, end=end, group="sector", universe=1)
    assert built.where("in_universe").count() == 10
    store.clear_cache()


def test_only_missing_ranges_are_downloaded(spark, tmp_path):
    asked = []

    def download(tickers, start, end):
        asked.append((tuple(tickers), (start - D).days, (end - D).days))
        return bars_of(spark, tickers, start, end)

    day = lambda n: D + timedelta(days=n)
    store = BarStore(spark, str(tmp_path / "bars"), by_list(download), buckets=4)
    store.load_bars(["A"], day(10), day(19))
    assert store.load_bars(["A", "B"], day(0), day(29)).count() == 60
    assert asked == [(("A",), 10, 19), (("A",), 0, 9), (("B",), 0, 29), (("A",), 20, 29)]
    assert store.load_bars(spark.createDataFrame([("B",)], "ticker string"), day(5), day(5), offline=True).count() == 1 and len(asked) == 4
    # a later write replaces what it covers, also in the middle of a range
    store.write_bars(bars_of(spark, ["B"], day(10), day(11)).withColumn("close", F.lit(-1.0)), day(10), day(12))
    got = {r["date"]: r["close"] for r in store.load_bars(["B"], day(0), day(29), offline=True).collect()}
    assert got[day(10)] == got[day(11)] == -1.0 and day(12) not in got and len(got) == 29 and got[day(9)] > 0
    ranges = sorted((r["ticker"], (r["first"] - D).days, (r["last"] - D).days) for r in store.coverage().collect())
    assert ranges == [("A", 0, 9), ("A", 10, 19), ("A", 20, 29), ("B", 0, 9), ("B", 10, 12), ("B", 13, 29)]
    before = sorted(map(tuple, store.load_bars(["A", "B"], day(0), day(29)).collect()))
    store.compact()
    store.tidy()
    assert sorted((r["ticker"], (r["first"] - D).days, (r["last"] - D).days) for r in store.coverage().collect()) == [("A", 0, 29), ("B", 0, 29)]
    assert sorted(map(tuple, BarStore(spark, str(tmp_path / "bars")).load_bars(["A", "B"], day(0), day(29), offline=True).collect())) == before and len(asked) == 4


def test_many_tickers_are_few_files(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"), buckets=4)
    bars = spark.range(2000).select(F.lit(D).alias("date"), F.concat(F.lit("N"), "id").alias("ticker"), F.col("id").cast("double").alias("close"))
    store.write_bars(bars, D, D)
    assert len(list((tmp_path / "bars" / "bars").rglob("*.parquet"))) <= 8
    got = store.load_bars(["N7", "N1999"], D, D, offline=True)
    assert sorted(r["close"] for r in got.collect()) == [7.0, 1999.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and " IN (" not in plan
    with pytest.raises(FileNotFoundError, match="N2000"):
        store.load_bars(["N2000"], D, D)


def test_kept_requests_are_bounded(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"), cached=2)
    store.write_bars(bars_of(spark, ["A", "B", "C"], D, D + timedelta(days=3)), D, D + timedelta(days=3))
    kept = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    ask = lambda tickers: store.load_variables(["close"], tickers=tickers, start=D, end=D + timedelta(days=3), offline=True)
    before = kept()
    for t in ("A", "B", "C"):
        ask([t]).count()
    assert kept() == before + 2
    # B was used last, so the next request displaces C
    assert "InMemory" in ask(["B"])._jdf.queryExecution().executedPlan().toString()
    ask(["A"]).count()
    assert "InMemory" in ask(["B"])._jdf.queryExecution().executedPlan().toString() and kept() == before + 2
    table = spark.createDataFrame([("A",), ("C",)], "ticker string")
    ask(table).count()
    assert "InMemory" in ask(table)._jdf.queryExecution().executedPlan().toString()
    store.clear_cache()
    assert kept() == before


class Flaky:
    """Fails twice for each list of tickers, has nothing for Z."""

    def __init__(self, path):
        self.path = path

    def fetch(self, tickers, start, end):
        mark = pathlib.Path(self.path) / "-".join(tickers)
        tried = len(mark.read_text()) if mark.exists() else 0
        mark.write_text("x" * (tried + 1))
        if tried < 2:
            raise OSError("not now")
        return pa.table({"date": [start, end], "ticker": [tickers[0]] * 2, "close": [1, 2]}).slice(0, 0 if tickers == ["Z"] else 2)


def test_provider(spark, tmp_path):
    one = provider.fetched(Flaky(str(tmp_path)), ["A"], D, D, wait=0.01)
    assert one.num_rows == 2 and one.column_names[:2] == ["date", "ticker"] and one["open"].null_count == 2
    with pytest.raises(OSError):
        provider.fetched(Flaky(str(tmp_path)), ["B"], D, D, retries=1, wait=0.01)
    with pytest.raises(ValueError, match="nothing came"):
        provider.fetched(Flaky(str(tmp_path)), ["Z"], D, D, wait=0.01)
    bars_of(spark, [f"N{i:03d}" for i in range(250)], D, D + timedelta(days=3)).write.parquet(f"{tmp_path}/given")
    spark.dataSource.register(provider.ProviderSource)
    read = spark.read.format("bars").option("provider", "alphaloom.sources.provider:ParquetProvider").option("args", json.dumps([f"{tmp_path}/given"])).option("start", str(D)).option("end", str(D))
    got = read.option("tickers", json.dumps([f"N{i:03d}" for i in range(250)])).load()
    assert got.rdd.getNumPartitions() == 3 and got.count() == 250
    with pytest.raises(Exception, match="nothing came"):
        read.option("tickers", '["none"]').load().count()


def test_requests():
    assert requested_names([fields.close, "open", parse("rank(volume)")]) == ["close", "open", "volume"]
    with pytest.raises(TypeError):
        requested_names(3)
    with pytest.raises(KeyError):
        field_info("nothing")
    with pytest.raises(ValueError):
        get_tickers(Universe.TOP500_PIT)
    assert with_dependencies(["volatility20"]) == ["close", "dividends", "splits", "returns", "volatility20"] and get_tickers(["A", "B", "A"]) == ["A", "B"]


def test_wide_to_long(spark):
    wide = spark.createDataFrame([("2024-01-02 00:00:00", 1.0, 2.0, float("nan"))], "date string, A_Close double, A_Open double, B_Close double")
    assert [tuple(r) for r in to_long(wide, {"Close": "close", "Open": "open"}).select("ticker", "close", "open").collect()] == [("A", 1.0, 2.0)]
    with pytest.raises(ValueError, match="no column"):
        to_long(wide.select("date"), {"Close": "close"})


def test_wide_tables_are_read_once(spark, tmp_path):
    names = [f"N_{i:03d}" for i in range(500)]
    spark.range(3).select(F.date_add(F.lit(D), F.col("id").cast("int")).alias("date"), *(F.when(F.col("id") != i % 4, F.col("id") + float(i)).alias(f"{n}_Close") for i, n in enumerate(names))).write.parquet(f"{tmp_path}/wide")
    long = to_long(spark.read.parquet(f"{tmp_path}/wide"), {"Close": "close", "Volume": "volume"})
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert {(r["ticker"], r["close"]) for r in long.where(F.col("date") == F.lit(D)).collect()} == {(n, float(i)) for i, n in enumerate(names) if i % 4}
    assert long.where("volume is not null").count() == 0


@pytest.fixture(scope="module")
def run(walk):
    return run_backtest(Strategy(Alpha(parse("-rank(ts_zscore(returns, 20))"), fields.volume > 0), decay=5, truncation=0.1, neutralization="sector"), with_derived(walk, ["returns"]), book_size=1e6, cache=True, display=False)


def test_saved_run(spark, run, walk, tmp_path):
    name = run_name(run.strategy, run.book_size)
    path = save_backtest(run, str(tmp_path / name), walk)
    strategy, tables, figures = load_backtest(spark, name, root=str(tmp_path))
    assert set(tables) == {"panel", "portfolio", "yearly", "source_data"} and figures == json.loads(json.dumps(run.figures()))
    assert run_name(strategy, run.book_size) == name and run_name(strategy, 5.0) != name and str(strategy.signal) == str(run.strategy.signal)
    page = read_page(spark, path)
    assert page.count("<svg") == 8 and page.count("<polyline") == 7 and "Expanding Sharpe / Rolling Sharpe" in page and "PnL by sector" in page and "Worst names" in page
    assert sum(f'>T{i:02d}<' in page for i in range(20)) == 20 and all(str(r["date"]) in page for r in run.portfolio.agg(F.min("date").alias("date")).union(run.portfolio.agg(F.max("date"))).collect())


def jobs_of(spark, group):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_killed_save_is_not_there(spark, run, tmp_path, monkeypatch):
    path = str(tmp_path / "run")

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(runs, "report_page", killed)
        with pytest.raises(KeyboardInterrupt):
            save_backtest(run, path)
    with pytest.raises(FileNotFoundError):
        load_backtest(spark, path)
    save_backtest(run, path)
    first = load_backtest(spark, path)[1]["portfolio"]
    with monkeypatch.context() as m:
        m.setattr(runs, "name_totals", killed)
        with pytest.raises(KeyboardInterrupt):
            save_backtest(run, path)
    # the version before is whole, and what the killed ones left can go
    assert first.inputFiles() == load_backtest(spark, path)[1]["portfolio"].inputFiles()
    runs.tidy_run(spark, path)
    assert len(list((tmp_path / "run").glob("data-*"))) == 1 and load_backtest(spark, path)[1]["portfolio"].count() == first.count()
    save_backtest(run, path)
    assert len(list((tmp_path / "run").glob("manifest-0*"))) == 2 and load_backtest(spark, path)[1]["portfolio"].inputFiles() != first.inputFiles()


def test_saving_and_checking_run_the_formulas_once(spark, sf_dir, tmp_path):
    made = queries_module.backtest(spark, sf_dir)
    spark.sparkContext.setJobGroup("panel", "panel")
    made.panel.write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobGroup("save", "save")
    save_backtest(made, str(tmp_path / "run"))
    spark.sparkContext.setJobGroup("check", "check")
    reports = made.validate()
    spark.sparkContext.setJobGroup("", "")
    once = jobs_of(spark, "panel")
    assert jobs_of(spark, "save") <= once + 16 and jobs_of(spark, "check") <= once + 3, (once, jobs_of(spark, "save"), jobs_of(spark, "check"))
    kept = made.written(str(tmp_path / "panel"))
    again = kept.validate()
    assert {k: r.checks for k, r in reports.items()} == {k: r.checks for k, r in again.items()}
    assert kept.observed["n_rows"] == kept.panel.count() and kept.observed["n_signal"] == kept.panel.where("signal is not null").count()


def test_checks_of_poor_tables(spark, run):
    """Empty tables and missing columns fail their checks."""
    check = lambda panel, portfolio: validate_backtest(panel, panel, portfolio, fields=["close"], neutralization=Neutralization.SECTOR, truncation=0.1)
    for panel in (run.panel.limit(0), run.panel.drop("sector"), run.panel.drop("weights"), run.panel.drop("date"), run.panel.select("date", "ticker")):
        reports = check(panel, run.portfolio.limit(0))
        assert not reports["weights"] and not reports["portfolio"]
        assert bool(reports["signal"]) == (len(panel.columns) > 2 and panel.schema != run.panel.schema)
    short = run.panel.withColumn("trade_volume", F.lit(-1.0)).withColumn("pnl", F.lit(float("nan")))
    reports = check(short, run.portfolio)
    assert not reports["allocations"] and not reports["asset_returns"] and reports["signal"] and reports["portfolio"]
    wrong = check(run.panel.withColumn("weights", F.when(F.col("ticker") == "T03", float("inf")).otherwise(F.col("weights") * 3)), run.portfolio)["weights"]
    assert "T03" in wrong.violations["not_nan"] and "first 2023-" in wrong.violations["under_max_weight"] and "2023-" in wrong.violations["not_over_levered"]


def test_attribution_adds_up(run):
    for horizon in ("daily", "monthly", "yearly", "full"):
        shares = at.attribution(run.panel, horizon=horizon, groups=("sector",), book_size=1e6).where("abs(period_pnl) > 1e-6").groupBy("date").agg(F.sum("contribution_pct").alias("s"))
        assert shares.where(F.abs(F.col("s") - 1) > 1e-6).isEmpty()
    total = run.portfolio.agg(F.sum("pnl")).first()[0]
    assert at.side_attribution(run.panel, book_size=1e6).agg(F.sum("contribution_pnl")).first()[0] == pytest.approx(total)
    with pytest.raises(ValueError):
        at.attribution(run.panel, groups=("tribe",), book_size=1e6)
    snap = at.attribution_snapshot(at.attribution(run.panel, horizon="monthly", book_size=1e6), period="2023-03-10", top=3).collect()
    assert len(snap) == 3 and {r["date"] for r in snap} == {date(2023, 2, 28)} or {r["date"] for r in snap} == {date(2023, 3, 31)}
    assert at.group_return_matrix(run.panel, "sector", book_size=1e6).columns == ["date", *(f"sector_{i}" for i in range(4))]
    assert at.group_correlations(run.panel, "sector", book_size=1e6, top=3).count() == 9


def test_tickers_keep_their_zeros(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    rows = [(D + timedelta(days=i), t, 10.0 + i, 11.0, 9.0, 10.5, 100.0, 0.0, 0.0) for t in ("0005", "0700", "5") for i in range(4)]
    store.write_bars(spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double, dividends double, splits double"), D, D + timedelta(days=3))
    got = store.load_bars(["0005", "0700"], D, D + timedelta(days=3), offline=True)
    assert {r["ticker"] for r in got.collect()} == {"0005", "0700"} and got.count() == 8


def test_run_from_a_store(spark, walk, tmp_path):
    first, last = walk.agg(F.min("date"), F.max("date")).first()
    store = BarStore(spark, str(tmp_path / "store"))
    store.write_bars(walk.select("date", "ticker", "open", "high", "low", "close", "volume", "dividends", "splits"), first, last)
    store.write_static(walk.select("ticker", "sector", "industry", "shares_outstanding").distinct())
    names = [f"T{i:02d}" for i in range(8)]
    strategy = Strategy(Alpha(parse("-rank(ts_zscore(returns, 5))")), universe=names, neutralization="sector", decay=3)
    period = TradingPeriod(first + timedelta(days=20), last)
    run = run_backtest(strategy, store=store, trading_period=period, book_size=1e6, weight_col="held", display=False)
    assert {r["ticker"] for r in run.panel.select("ticker").distinct().collect()} == set(names) and "held" in run.panel.columns and "weights" not in run.panel.columns
    assert run.portfolio.agg(F.min("date")).first()[0] >= period.start and run.display() in (True, False)
    # what the strategy lacks, its alpha or its last run has
    assert strategy.fields == strategy.alpha.fields and strategy.sharpe == strategy.aggregate_metrics["sharpe"] == run.summary.first()["sharpe"] and strategy.yearly is run.yearly
    with pytest.raises(AttributeError):
        strategy.tribe
    with pytest.raises(ValueError):
        run_backtest(strategy, store=store)
    signals = build_signals_from_data(store, names, ["adv20"], str(first), last)
    assert signals.columns == ["date", "ticker", "sector", "adv20"] and signals.select("ticker").distinct().count() == 8
    given = run_backtest(strategy, run.source, "signal", trading_period=TradingPeriod(period.start, period.start + timedelta(days=40)), book_size=1e6, display=False)
    assert given.portfolio.agg(F.max("date")).first()[0] <= period.start + timedelta(days=40)


def test_plans_read_their_panel_once(run, spark, sf_dir):
    """Scans and exchanges of the plans that used to repeat their input."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    portfolio = run.portfolio
    first, last = portfolio.agg(F.min("date"), F.max("date")).first()
    one, periods = plan(portfolio), plan(db.period_figures(portfolio, db.split_periods(first, last), book_size=1e6))
    assert periods.count("Exchange hashpartitioning(ticker") == one.count("Exchange hashpartitioning(ticker")
    assert plan(engine.QUERIES["weights_sector_decay_capped"](spark, sf_dir)).count("Scan parquet") <= 4
    changes = plan(va.ticker_changes(run.panel.select("date", "ticker")))
    assert "collect_set" not in changes


def test_dashboard(run):
    first, last = run.portfolio.agg(F.min("date"), F.max("date")).first()
    shared = db.split_periods(first, last)
    assert [a.end == b.start for a, b in zip(shared, shared[1:], strict=False)] == [True, True] and shared[0].start == first and shared[2].end == last
    periods = db.split_periods(first, last, apart=True)
    assert [p.name for p in periods] == ["TRAIN", "VALIDATION", "OOS"] and sum(p.days + 1 for p in periods) == (last - first).days + 1
    figures = {r["period"]: r for r in db.period_figures(run.portfolio, periods, book_size=1e6).collect()}
    assert figures["IS"]["total_pnl"] == pytest.approx(figures["TRAIN"]["total_pnl"] + figures["VALIDATION"]["total_pnl"])
    leaders = db.monthly_leaders(run.panel, book_size=1e6, top=2)
    assert leaders.groupBy("date", "kind").count().where("count <> 2").isEmpty()
    assert db.common_start(run.portfolio, run.panel.where(F.col("date") > F.lit(first))) > first
    assert "drawdown" in db.with_display_columns(run.portfolio.select("date", "pnl"), book_size=1e6).columns
    with pytest.raises(ValueError):
        db.portfolio_beta(run.portfolio, run.panel.select("date", "close"), 5)
    assert TradingPeriod(first, last).contains(first)


def test_listings(spark):
    days = [D + timedelta(days=i) for i in range(4)]
    rows = [(d, t) for t, on in {"A": (0, 1, 2, 3), "B": (0, 2, 3), "C": (1, 2)}.items() for d in (days[i] for i in on)]
    df = spark.createDataFrame(rows, "date date, ticker string")
    got = {(r["date"] - D).days: (r["entered_tickers"], r["exited_tickers"], r["entered"], r["exited"]) for r in va.ticker_changes(df).collect()}
    assert got == {1: (["C"], ["B"], 1, 1), 2: (["B"], [], 1, 0), 3: ([], ["C"], 0, 1)}
    assert [r["ticker"] for r in va.delistings(df).collect()] == ["C"] and [r["ticker"] for r in va.late_listings(df).collect()] == ["C"]
    assert [tuple(r) for r in va.internal_gaps(df).collect()] == [("B", 1)]
    report = va.are_market_changes_valid(df)
    assert set(report.checks) == {"no_mid_sample_delistings", "no_late_listings", "no_internal_gaps"} and not report and report.label == "Market changes (3 days with turnover)"
    assert report.violations["no_internal_gaps"] == "1 names lack dates of their own span: B 1 dates" and "C after" in str(report)
    assert va.are_market_changes_valid(df.where("ticker = 'A'"))
    # names that come and go are told, not judged
    churn = df.where("ticker = 'A' or ticker = 'C'").where("ticker = 'A' or date <> '1900-01-01'")
    assert "turnover" in va.are_market_changes_valid(churn).label
    with pytest.raises(ValueError):
        va.are_market_changes_valid(df.limit(0))
    with pytest.raises(KeyError):
        va.are_market_changes_valid(df.drop("ticker"))


def test_streams(spark, sf_dir, tmp_path):
    static = weekly(spark, sf_dir).select("date", "ticker", "close", "high", "low", "volume")
    static.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))
    out = stream_signal(stream_fields(stream, ["dollar_volume", "typical_price"]), "s", parse("if_else(close - typical_price, 1, 0)"))
    query = out.writeStream.format("memory").queryName("out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("out").count() == static.count()
    for wrong in (lambda: stream_fields(stream, ["returns"]), lambda: stream_signal(stream, "s", parse("rank(close)"))):
        with pytest.raises(ValueError):
            wrong()
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    bars = stream_bars(events).writeStream.format("memory").queryName("bars").outputMode("append").start()
    bars.processAllAvailable()
    bars.stop()
    assert spark.table("bars").count() > 0


SAMPLE = ["op_rank", "op_ts_rank", "op_kth_element", "op_trade_when_exit", "expr_divide", "field_volatility20", "signal_exit", "weights_none_decay_capped", "weights_sector_decay_capped", "daily_portfolio", "agg_yearly", "attr_side_monthly", "dash_period_figures", "dash_correlations", "valid_ticker_changes", "valid_market_changes", "valid_backtest", "store_fields", "run_from_store", "run_headline"]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_agree_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = engine.QUERIES[name](spark, sf_dir)
    theirs = con.execute(engine.ORACLES[name])
    order = [c[0] for c in theirs.description]
    plain = lambda rows: sorted((tuple(str(round(v, 5)) if isinstance(v, float) else str(v) for v in r) for r in rows))
    assert sorted(order) == sorted(got.columns)
    a, b = plain(got.select(*order).collect()), plain(theirs.fetchall())
    assert len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 1e-3 * len(a)


def test_every_query_has_sql():
    assert set(engine.QUERIES) == set(engine.ORACLES)
