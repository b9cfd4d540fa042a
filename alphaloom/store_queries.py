"""More registered queries: the bar store, saved runs, wide tables, checks as tables, and the dashboard's samples.

A store or a run is written to the shared folder first and read again by its own reader.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Neutralization, TradingPeriod
from .functions import metrics as m
from .plans import attribution as at
from .plans import dashboard as db
from .plans import validate as va
from .plans import weights as wt
from .plans.backtest import Strategy, run_backtest
from .plans.expr import parse
from .plans.signal import Alpha, compute_signals
from .queries import BENCHMARKS, BOOK, NOISE, ORACLES, PERIOD, PERIOD_DIGITS, QUERIES, REVERSAL, REVERSAL_SQL, SUMMARY, UNIVERSE, WT, attr_sql, backtest, daily_names, lag, neutral_sql, normal_sql, rank_sql, register, rnd, rounded, simulated_sql, sql, weekly, weights_sql
from .sources.bars import BarStore, build_signals_from_data
from .sources.panels import _suppliers, cells_to_long, trade_panel
from .sources.provider import ParquetProvider, ProviderSource, from_provider, in_order
from .sources.runs import load_backtest, save_backtest

__all__ = ["ORACLES", "QUERIES"]

START, END = date(1993, 1, 1), date(1997, 12, 31)
_local: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or on one machine in a temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = _local[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def named(df: DataFrame) -> DataFrame:
    """Tickers as text with leading zeros, as some exchanges have them."""
    return df.withColumn("ticker", F.lpad(F.col("ticker").cast("string"), 6, "0"))


def filled_store(spark: SparkSession, sf_dir: str) -> tuple[BarStore, DataFrame]:
    """A store of the monthly bars of all suppliers, and its universe as a table."""
    store = BarStore(spark, shared_path(spark, "bars"), buckets=8)
    bars = named(trade_panel(spark, sf_dir, "month"))
    store.write_bars(bars.drop("sector", "industry", "shares_outstanding"), date(1992, 1, 1), date(1999, 12, 31))
    store.write_static(named(_suppliers(spark, sf_dir)))
    return store, bars.select("ticker").distinct()


def store_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, names = filled_store(spark, sf_dir)
    return rounded(store.load_bars(names, START, END, offline=True).select("date", "ticker", "close", "volume", "splits"))


def provided(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder that a provider reads, of monthly bars, and its tickers."""
    path = shared_path(spark, "provider")
    bars = named(trade_panel(spark, sf_dir, "month")).drop("sector", "industry", "shares_outstanding")
    in_order(bars).parquet(path)
    return path, spark.read.schema(bars.schema).parquet(path).select("ticker").distinct()


def store_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that a store downloads from a provider: first of two years, then of five, of which two are there."""
    path, names = provided(spark, sf_dir)
    store = BarStore(spark, shared_path(spark, "bars"), from_provider(ParquetProvider(path)), buckets=8)
    store.load_bars(names, date(1994, 1, 1), date(1995, 12, 31))
    return rounded(store.load_bars(names, START, END).select("date", "ticker", "close", "volume", "splits"))


def store_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose middle years were written again with twice the volume, and that was compacted then."""
    store, names = filled_store(spark, sf_dir)
    again = store.load_bars(names, date(1994, 1, 1), date(1995, 12, 31), offline=True)
    store.write_bars(again.withColumn("volume", F.col("volume") * 2), date(1994, 1, 1), date(1995, 12, 31))
    store.compact()
    return rounded(store.load_bars(names, START, END, offline=True).select("date", "ticker", "close", "volume"))


def provider_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars read from a provider as a data source, a task for every hundred tickers."""
    path, names = provided(spark, sf_dir)
    spark.dataSource.register(ProviderSource)
    listed = json.dumps([r["ticker"] for r in names.collect()])  # an option is a text
    read = spark.read.format("bars").option("provider", "alphaloom.sources.provider:ParquetProvider").option("args", json.dumps([path]))
    return rounded(read.option("tickers", listed).option("start", str(START)).option("end", str(END)).load().select("date", "ticker", "close", "volume", "dividends"))


def store_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived and static fields, asked for twice: the second request is part of the first and answered from it."""
    store, names = filled_store(spark, sf_dir)
    store.load_variables(["close", "market_cap", "returns", "sector"], tickers=names, start=date(1992, 1, 1), end=END, offline=True)
    return rounded(store.load_variables(["returns", "market_cap", "sector"], tickers=names, start=START, end=END, offline=True), {"market_cap": 1})


def store_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, names = filled_store(spark, sf_dir)
    return rounded(build_signals_from_data(store, names, parse("rank(returns) * dollar_volume"), "1993-01-01", "31 Dec 1997"), {"dollar_volume": 2})


def store_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = filled_store(spark, sf_dir)
    return rounded(store.benchmark_closes([f"{b:06d}" for b in BENCHMARKS], START, END, offline=True))


def run_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, names = filled_store(spark, sf_dir)
    # a strategy's universe is a list by definition
    strategy = Strategy(Alpha(parse("-rank(returns)")), universe=[r["ticker"] for r in names.collect()], neutralization="market")
    run = run_backtest(strategy, book_size=BOOK, store=store, trading_period=TradingPeriod(START, END), noise=NOISE, weight_col="held", display=False)
    return rounded(run.portfolio.select("date", "pnl", "trade_volume", "gross_exposure"), 5)


NAME = "lpad(CAST(ticker AS VARCHAR), 6, '0')"
WITHIN = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
register("store_bars", store_bars, sql(f"SELECT date, {NAME} AS ticker, {rnd('close')} AS close, volume, splits FROM panel WHERE {WITHIN}", unit="month"))
STORED = f"SELECT date, {NAME} AS ticker, {rnd('close')} AS close, volume, splits FROM panel WHERE {WITHIN}"
register("store_download", store_download, sql(STORED, unit="month"))
register("store_rewritten", store_rewritten, sql(f"SELECT date, {NAME} AS ticker, {rnd('close')} AS close, CASE WHEN year(date) IN (1994, 1995) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * volume AS volume FROM panel WHERE {WITHIN}", unit="month"))
register("provider_bars", provider_bars, sql(f"SELECT date, {NAME} AS ticker, {rnd('close')} AS close, volume, {rnd('dividends')} AS dividends FROM panel WHERE {WITHIN}", unit="month"))
register("store_fields", store_fields, sql(f"SELECT date, {NAME} AS ticker, sector, {rnd('returns')} AS returns, {rnd('market_cap', 1)} AS market_cap FROM f WHERE {WITHIN}", unit="month"))
CUT = f"c0 AS (SELECT * FROM panel WHERE {WITHIN})"
CUT_RETURNS = f"c1 AS (SELECT *, close * volume AS dv, (close * CASE WHEN splits = 0 THEN 1.0::DOUBLE ELSE splits END + dividends) / nullif({lag('close')}, 0) - 1 AS r FROM c0)"
register("store_signals", store_signals, sql(f"SELECT date, {NAME} AS ticker, sector, {rnd('r')} AS returns, {rnd('dv', 2)} AS dollar_volume FROM c1", CUT, CUT_RETURNS, unit="month"))
register("store_benchmarks", store_benchmarks, sql("SELECT date, " + ", ".join(f'{rnd(f"max(CASE WHEN ticker = {t} THEN close END)")} AS "{t:06d}"' for t in BENCHMARKS) + f" FROM panel WHERE ticker IN (1, 2, 3) AND {WITHIN} GROUP BY date", unit="month"))
register("run_from_store", run_from_store, sql(
    f"SELECT date, {rnd('pnl', 5)} AS pnl, {rnd('trade_volume', 5)} AS trade_volume, {rnd('gross', 5)} AS gross_exposure FROM x2", CUT, CUT_RETURNS,
    f"c2 AS (SELECT *, -({rank_sql('r')}) AS signal FROM c1)", neutral_sql("c2", "signal", "MARKET", "n1"), normal_sql("n1", "n1_w", "m1"),
    f"x0 AS (SELECT date, ticker, r AS ret, coalesce({lag('m1_w', 2)}, 0) AS weights FROM m1)", f"x1 AS (SELECT *, weights * {BOOK} AS exposure, coalesce(lag(weights) OVER ({WT}), 0) * {BOOK} AS before FROM x0)",
    "x2 AS (SELECT date, coalesce(sum(CASE WHEN exposure = 0 THEN 0 ELSE exposure * ret END), 0) AS pnl, sum(abs(exposure - before)) AS trade_volume, sum(abs(weights)) AS gross FROM x1 GROUP BY date)", unit="month"))


def saved(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """A run's tables and figures, saved and read again."""
    strategy = Strategy(Alpha(REVERSAL), decay=5, truncation=0.05, neutralization=Neutralization.SECTOR)
    run = run_backtest(strategy, weekly(spark, sf_dir), book_size=BOOK, universe_size=UNIVERSE, noise=NOISE, display=False)
    path = save_backtest(run, shared_path(spark, "run"))
    _, tables, figures = load_backtest(spark, path)
    return tables, figures


def number_or_null(figure: object) -> float | None:
    """A figure as it is written out: a number, in digits or not, or nothing where there is none, such as the Sharpe of a run without PnL."""
    return None if figure is None or figure in ("", "None") else float(figure)


def saved_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of a saved run that are plain numbers, as they are written out."""
    _, figures = saved(spark, sf_dir)
    return spark.createDataFrame([(k, number_or_null(figures[k])) for k in ("Total PnL", "Sharpe", "Capacity score", "Long", "Short", "Trades per day")], "figure string, value double")


register("saved_run", lambda spark, d: rounded(saved(spark, d)[0]["portfolio"].select("date", "pnl", "turnover", "long_count")), sql(f"SELECT date, {rnd('pnl')} AS pnl, {rnd('turnover')} AS turnover, long_count FROM p", *simulated_sql()))
register("saved_panel", lambda spark, d: rounded(saved(spark, d)[0]["panel"].select("date", "ticker", "weights", "exposure", "pnl")), sql(f"SELECT date, ticker, {rnd('weights')} AS weights, {rnd('exposure')} AS exposure, {rnd('pnl')} AS pnl FROM a", *simulated_sql()))
register("saved_yearly", lambda spark, d: rounded(saved(spark, d)[0]["yearly"].select("date", *PERIOD), PERIOD_DIGITS), ORACLES["agg_yearly"])
register("saved_figures", saved_figures, sql(
    "SELECT figure, round(value, 2) AS value FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS figure, CAST(({SUMMARY[c]}) AS DOUBLE) AS value FROM pp" for k, c in {"Total PnL": "total_pnl", "Sharpe": "sharpe", "Capacity score": "capacity_score", "Long": "long", "Short": "short", "Trades per day": "trades_per_day"}.items()) + ")",
    *simulated_sql(), "pp AS (SELECT *, CASE WHEN i >= 48 THEN pnl END AS post FROM p)"))


REQUEST = 1000  # tickers


def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bars in wide rows, as downloads come, and long again: a row a date and request, with a cell a ticker and field.

    A request is for about ``REQUEST`` tickers, so rows are no longer for more of them; cells are a map, so neither is the plan.
    """
    bars = trade_panel(spark, sf_dir)
    requests = -(-spark.read.parquet(f"{sf_dir}/supplier.parquet").count() // REQUEST)
    columns = ("open", "close", "volume")
    wide = bars.groupBy("date", F.pmod(F.hash("ticker"), F.lit(max(requests, 1))).alias("request")).agg(F.collect_list(F.struct("ticker", *columns)).alias("bars"))
    cells = F.flatten(F.transform("bars", lambda b: F.array(*(F.struct(F.concat(b["ticker"].cast("string"), F.lit(f"_{c.title()}")).alias("column"), b[c].alias("value")) for c in columns))))
    return rounded(cells_to_long(wide.select("date", F.map_from_entries(cells).alias("cells")), {c.title(): c for c in columns}))


register("wide_to_long", wide_to_long, sql(f"SELECT date, CAST(ticker AS VARCHAR) AS ticker, {rnd('open')} AS open, {rnd('close')} AS close, {rnd('volume')} AS volume FROM panel"))


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = wt.compute_weights(compute_signals(weekly(spark, sf_dir), Alpha(REVERSAL), universe=UNIVERSE), neutralization=Neutralization.MARKET, noise=NOISE)
    return rounded(wt.truncate_neutral(held, 0.02, []).select("date", "ticker", "weights"), 9)


_ctes, _last, _col = weights_sql("MARKET", 0, 0.0)
register("weights_clipped", clipped, sql(f"SELECT date, ticker, {rnd(f'least(greatest({_col}, -0.02::DOUBLE), 0.02::DOUBLE)', 9)} AS weights FROM {_last}", *REVERSAL_SQL, *_ctes))
register("metric_long_short", lambda spark, d: backtest(spark, d).panel.groupBy("date").agg(m.count_long(F.col("sign")).alias("n_long"), m.count_short(F.col("sign")).alias("n_short")), sql("SELECT date, count(*) FILTER (weights > 0) AS n_long, count(*) FILTER (weights < 0) AS n_short FROM a GROUP BY date", *simulated_sql()))

# ---- checks as tables


def report_rows(spark: SparkSession, reports: dict[str, va.ValidityReport]) -> DataFrame:
    rows = [(stage, name, bool(good)) for stage, r in reports.items() for name, good in r.checks.items()]
    return spark.createDataFrame(rows, "stage string, name string, passed boolean")


def valid_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_rows(spark, backtest(spark, sf_dir).validate())


register("valid_backtest", valid_backtest, sql(
    "SELECT stage, name, passed FROM v ORDER BY 1, 2", *simulated_sql(),
    "c AS (SELECT count(*) > 0 AS has_rows, min(trade_volume) >= 0 AS volume, count(*) FILTER (pnl IS NULL OR NOT isfinite(pnl)) = 0 AS finite, count(*) FILTER (abs(weights) > 1e-9) > 0 AS active, count(*) FILTER (abs(weights) > 0.05::DOUBLE * (1 + 1e-9)) = 0 AS under FROM a)",
    "gs AS (SELECT date, sector, sum(abs(weights)) AS gross, abs(sum(weights)) AS net, 2 * least(count(*) FILTER (weights > 1e-9), count(*) FILTER (weights < -1e-9)) * 0.05::DOUBLE AS room, count(*) FILTER (abs(weights) > 1e-9) AS n FROM a GROUP BY 1, 2)",
    "gd AS (SELECT date, sum(gross) AS gross, sum(room) FILTER (sector IS NOT NULL) AS room, sum(n) AS n, max(net) FILTER (sector IS NOT NULL) AS net FROM gs GROUP BY 1)",
    "gc AS (SELECT count(*) FILTER (n > 0 AND gross > least(1.0, room) + 1e-9) = 0 AS capacity, count(*) FILTER (gross > 1 + 1e-9) = 0 AS levered, max(net) <= 8 * sum(n) * pow(2.0::DOUBLE, -52) AS neutral FROM gd)",
    "sg AS (SELECT count(signal) > 0 AS there FROM sig)",
    """v AS (SELECT unnest([
  {stage: 'source_data', name: 'not_empty', passed: has_rows}, {stage: 'source_data', name: 'has_keys', passed: true}, {stage: 'source_data', name: 'fields_loaded', passed: true},
  {stage: 'signal', name: 'exists', passed: true}, {stage: 'signal', name: 'numeric', passed: true}, {stage: 'signal', name: 'has_values', passed: there},
  {stage: 'weights', name: 'has_active_positions', passed: active}, {stage: 'weights', name: 'not_nan', passed: true}, {stage: 'weights', name: 'under_max_weight', passed: under},
  {stage: 'weights', name: 'within_gross_capacity', passed: capacity}, {stage: 'weights', name: 'not_over_levered', passed: levered}, {stage: 'weights', name: 'group_neutral', passed: neutral},
  {stage: 'allocations', name: 'has_columns', passed: true}, {stage: 'allocations', name: 'trade_volume_not_negative', passed: volume},
  {stage: 'asset_returns', name: 'has_columns', passed: true}, {stage: 'asset_returns', name: 'pnl_finite', passed: finite},
  {stage: 'portfolio', name: 'not_empty', passed: has_rows}, {stage: 'portfolio', name: 'has_columns', passed: true}], recursive := true) FROM c, gc, sg)"""))


def valid_market_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = va.are_market_changes_valid(daily_names(spark, sf_dir))
    return report_rows(spark, {report.label: report})


register("valid_market_changes", valid_market_changes, sql(
    "SELECT stage, name, passed FROM (SELECT 'Market changes (' || n || ' days with turnover)' AS stage, unnest(['no_mid_sample_delistings', 'no_late_listings', 'no_internal_gaps']) AS name, unnest([dl = 0, ll = 0, ga = 0]) AS passed FROM tc, li)",
    "dy AS (SELECT date, list(DISTINCT ticker) AS now FROM panel GROUP BY date)", "dz AS (SELECT date, now, lag(now) OVER (ORDER BY date) AS b FROM dy)",
    "tc AS (SELECT count(*) FILTER (b IS NOT NULL AND (len(list_filter(now, lambda x: NOT list_contains(b, x))) > 0 OR len(list_filter(b, lambda x: NOT list_contains(now, x))) > 0)) AS n FROM dz)",
    "di AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM panel))", "sp AS (SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n FROM panel GROUP BY ticker)",
    "li AS (SELECT count(*) FILTER (last < e) AS dl, count(*) FILTER (first > s) AS ll, count(*) FILTER (l.i - f.i + 1 - n > 0) AS ga FROM sp JOIN di f ON f.date = first JOIN di l ON l.date = last, (SELECT min(date) AS s, max(date) AS e FROM panel))", unit="day"))

# ---- dashboard


def split_samples(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    days = trade_panel(spark, sf_dir).select("date")
    first, last = days.agg(F.min("date"), F.max("date")).first()
    return days.select("date", F.explode(db.periods_of(db.split_periods(first, last, 0.6, 0.8, apart=apart))).alias("period")).groupBy("period").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


CUTS = "cuts AS (SELECT min(date) AS s, max(date) AS e, min(date) + CAST(floor((max(date) - min(date)) * 0.6::DOUBLE) AS INTEGER) AS a, min(date) + CAST(floor((max(date) - min(date)) * 0.8::DOUBLE) AS INTEGER) AS b FROM panel)"


def split_sql(apart: int) -> str:
    periods = f"SELECT 'TRAIN' AS period, s AS f, a AS t FROM cuts UNION ALL SELECT 'VALIDATION', a + {apart}, b FROM cuts UNION ALL SELECT 'OOS', b + {apart}, e FROM cuts"
    return sql("SELECT period, count(*) AS n, min(date) AS first, max(date) AS last FROM panel JOIN ps ON date BETWEEN f AND t GROUP BY 1", CUTS, f"ps AS ({periods})")


register("dash_split", split_samples, split_sql(0))
register("dash_split_apart", lambda spark, d: split_samples(spark, d, True), split_sql(1))


def common_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio from the first date that a benchmark has a return on."""
    portfolio = backtest(spark, sf_dir).portfolio.select("date", "pnl")
    market = db.benchmark_returns(trade_panel(spark, sf_dir).where("ticker = 1").select("date", "close")).where("b is not null")
    return rounded(db.from_date(portfolio, db.common_start(portfolio, market)))


register("dash_common_start", common_sample, sql(
    f"SELECT date, {rnd('pnl')} AS pnl FROM p WHERE date >= (SELECT greatest(min(date), (SELECT min(date) FROM bm WHERE b IS NOT NULL)) FROM p)", *simulated_sql(),
    "bm AS (SELECT date, close / nullif(lag(close) OVER (ORDER BY date), 0) - 1 AS b FROM panel WHERE ticker = 1)"))
SHOWN = {"ret": 6, "cum_pnl": 4, "ann_ret": 6, "log_ret": 6, "drawdown": 6, "rolling_sharpe": 6, "expanding_capacity_score": 6}
GROWN = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
register(
    "dash_display_columns",
    lambda spark, d: rounded(db.with_display_columns(backtest(spark, d).portfolio.select("date", "pnl", "turnover", "expanding_sharpe"), book_size=BOOK).select("date", *SHOWN), SHOWN),
    sql("SELECT date, " + ", ".join(f"{rnd(c, n)} AS {c}" for c, n in SHOWN.items()) + " FROM dc", *simulated_sql(),
        f"dc AS (SELECT date, ret, cum_pnl, ann_ret, log_ret, drawdown, expanding_sharpe AS rolling_sharpe, CASE WHEN count(ret) {GROWN} >= 2 THEN expanding_sharpe * sqrt(abs(avg(ret) {GROWN} * 252) / greatest(avg(turnover) {GROWN}, 0.125::DOUBLE)) END AS expanding_capacity_score FROM p)"),
)
register("attr_panel_snapshot", lambda spark, d: rounded(at.panel_snapshot(backtest(spark, d).panel, horizon="yearly", book_size=BOOK).select("date", "ticker", "contribution_pnl"), 5), sql(
    f"SELECT date, ticker, {rnd('contribution_pnl', 5)} AS contribution_pnl FROM att WHERE date = (SELECT max(date) FROM att) ORDER BY abs(contribution_pnl) DESC, ticker LIMIT 10", *simulated_sql(), *attr_sql("make_date(year(date), 12, 31)", "ticker")))


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that a strategy has of its last run."""
    strategy = Strategy(Alpha(REVERSAL), decay=5, truncation=0.05, neutralization=Neutralization.SECTOR)
    run_backtest(strategy, weekly(spark, sf_dir), book_size=BOOK, universe_size=UNIVERSE, noise=NOISE, display=False)
    return rounded(spark.createDataFrame([(k, number_or_null(v)) for k, v in strategy.aggregate_metrics.items()], "figure string, value double"), 4)


HEAD = {"pnl": "total_pnl", "ret": "annualised_return", "sharpe": "sharpe", "turnover": "turnover", "capacity_score": "capacity_score", "drawdown": "drawdown", "margin": "margin"}
register("run_headline", headline, sql(
    "SELECT figure, " + rnd("value", 4) + " AS value FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS figure, CAST(({SUMMARY[c]}) AS DOUBLE) AS value FROM pp" for k, c in HEAD.items()) + ")", *simulated_sql(), "pp AS (SELECT *, CASE WHEN i >= 48 THEN pnl END AS post FROM p)"))
