"""Registered queries of aligned closes, attribution in one pass, users' functions, and windows over streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.arrays import cs_mean
from .operators.user import rolling_function, row_function
from .plans import attribution as at
from .plans import simulate as sim
from .plans.expr import parse
from .queries import ATTRIBUTED, BOOK, NOISE, WT, attr_sql, backtest, full, lag, register, rnd, rounded, simulated_sql, sql, value_of, weekly, win
from .sources.panels import trade_panel
from .store_queries import ORACLES, QUERIES, shared_path
from .streaming.stateful import stream_windows

__all__ = ["ORACLES", "QUERIES"]

# ---- aligned closes: the dates are those of the weeks in which the first sector trades


def calendar(panel: DataFrame) -> DataFrame:
    return panel.where("day(date) <= 21").select("date")


HELD = "first_value(close) OVER r AS base, last_value(close IGNORE NULLS) OVER r AS close FROM gd WINDOW r AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
GRID = "gd AS (SELECT d.date, t.ticker, p.close FROM (SELECT DISTINCT date FROM panel WHERE day(date) <= 21) d CROSS JOIN (SELECT DISTINCT ticker FROM panel) t LEFT JOIN panel p ON p.date = d.date AND p.ticker = t.ticker)"
register("aligned_pnl", lambda spark, d: rounded((lambda p: sim.aligned_pnl(calendar(p), p.select("date", "ticker", "close"), BOOK))(trade_panel(spark, d))), sql(
    f"SELECT date, ticker, {rnd(f'(close / nullif(base, 0) - 1) * {BOOK}')} AS cum_pnl FROM h", GRID, f"h AS (SELECT date, ticker, {HELD})"))
register("aligned_closes", lambda spark, d: rounded((lambda p: sim.aligned_closes(calendar(p), p.select("date", "ticker", "close"), between=True))(trade_panel(spark, d))), sql(
    f"SELECT d.date, t.ticker, {rnd('p.close')} AS close FROM (SELECT DISTINCT date FROM panel WHERE day(date) <= 21) d CROSS JOIN (SELECT DISTINCT ticker FROM panel) t ASOF LEFT JOIN panel p ON p.ticker = t.ticker AND p.date <= d.date"))

# ---- attribution of four kinds in one pass

SHOWN = [*ATTRIBUTED, "observations", "side"]
SIDE = "CASE WHEN weights > 1e-12 THEN 'long' WHEN weights < -1e-12 THEN 'short' ELSE 'flat' END"
register(
    "attr_all_monthly",
    lambda spark, d: rounded(at.attribution_sets(backtest(spark, d).panel, horizon="monthly", book_size=BOOK, flat=NOISE).select("date", "kind", "name", *SHOWN), 5),
    "\nUNION ALL\n".join(
        "(" + sql(f"SELECT date, '{kind}' AS kind, CAST({kind} AS VARCHAR) AS name, " + ", ".join(f"{rnd(c, 5)} AS {c}" for c in ATTRIBUTED) + ", observations, side FROM att", *simulated_sql(), *attr_sql("last_day(date)", kind)) + ")"
        for kind in ("ticker", "industry", "sector")
    )
    + "\nUNION ALL\n("
    + sql("SELECT date, 'side' AS kind, rs AS name, " + ", ".join(f"{rnd(c, 5)} AS {c}" for c in ATTRIBUTED) + ", observations, rs AS side FROM att", *simulated_sql(), f"a2 AS (SELECT *, {SIDE} AS rs FROM a)", *attr_sql("last_day(date)", "rs", source="a2"))
    + ")",
)

# ---- users' functions


def rolling_median(window: np.ndarray) -> np.ndarray:
    """Of windows without a gap."""
    return np.where(np.isnan(window).any(axis=1), np.nan, np.median(window, axis=1))


def mid_gap(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    return close - (high + low) / 2


rolling_function(rolling_median)
row_function(mid_gap)
register("user_median", lambda spark, d: value_of(weekly(spark, d), parse("rolling_median(returns, 5)")), sql(
    f"SELECT date, ticker, {rnd(full(5, 'returns', f'median(returns) OVER {win(5)}'))} AS value FROM f"))
register("user_median_ranked", lambda spark, d: value_of(weekly(spark, d), parse("ts_delta(rolling_median(close, 3), 2)")), sql(
    f"SELECT date, ticker, {rnd(f'm - {lag("m", 2)}')} AS value FROM k", f"k AS (SELECT *, {full(3, 'close', f'median(close) OVER {win(3)}')} AS m FROM f)"))
register("user_rows", lambda spark, d: value_of(weekly(spark, d), parse("mid_gap(high, low, close) * 2")), sql(f"SELECT date, ticker, {rnd('(close - (high + low) / 2) * 2')} AS value FROM f"))

# ---- windows over a stream

STREAMED = {
    "delay": "ts_delay(close, 2)", "delta": "ts_delta(close, 3)", "place": "ts_rank(volume, 5)", "mean": "ts_mean(close, 5)", "simple": "sma(close, 3)", "std": "ts_std(close, 5)", "z": "ts_zscore(close, 5)", "total": "ts_sum(volume, 4)",
    "growth": "product(close, 2)", "low": "ts_min(close, 5)", "high": "ts_max(close, 5)", "at_high": "ts_argmax(close, 5)", "at_low": "ts_argmin(close, 5)", "decay": "linear_decay(volume, 4)", "corr": "ts_correlation(close, volume, 6)",
    "cov": "ts_covariance(close, volume, 6)",
}


def replayed(spark: SparkSession, bars: DataFrame, slices: int = 4, late: str = "14 days") -> DataFrame:
    """The windows of STREAMED over bars that a stream reads file by file, each file a slice of time of which the latest bars are in the file before.

    A bar after all others moves the watermark past them.
    """
    path, out = shared_path(spark, "stream"), shared_path(spark, "streamed")
    rows = bars.select("date", F.col("ticker").cast("long").alias("ticker"), "close", "volume")
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    days = (last - first).days + 1
    # a bar on an odd day comes up to a week early
    early = F.when(F.dayofyear("date") % 2 == 1, 7).otherwise(0)
    dealt = rows.withColumn("slice", F.greatest(F.lit(0), F.floor((F.datediff("date", F.lit(first)) - early) * slices / days)))
    for i in range(slices):
        dealt.where(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)
    spark.range(1).select(F.date_add(F.lit(last), 1000).alias("date"), F.lit(-1).cast("long").alias("ticker"), F.lit(1.0).alias("close"), F.lit(1.0).alias("volume")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    made = stream_windows(stream, {k: parse(v) for k, v in STREAMED.items()}, late=late)
    query = made.writeStream.format("parquet").option("checkpointLocation", shared_path(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


C5 = win(5)
STREAM_SQL = {
    "delay": lag("close", 2), "delta": f"close - {lag('close', 3)}", "mean": full(5, "close", f"avg(close) OVER {C5}"), "simple": full(3, "close", f"avg(close) OVER {win(3)}"), "std": full(5, "close", f"stddev_samp(close) OVER {C5}"),
    "z": f"(close - {full(5, 'close', f'avg(close) OVER {C5}')}) / nullif({full(5, 'close', f'stddev_samp(close) OVER {C5}')}, 0)", "total": full(4, "volume", f"sum(volume) OVER {win(4)}"), "growth": full(2, "close", f"product(close) OVER {win(2)}"),
    "low": full(5, "close", f"min(close) OVER {C5}"), "high": full(5, "close", f"max(close) OVER {C5}"), "at_high": full(5, "close", f"list_position(list(close) OVER {C5}, max(close) OVER {C5})"), "at_low": full(5, "close", f"list_position(list(close) OVER {C5}, min(close) OVER {C5})"),
    "place": full(5, "volume", f"(len(list_filter(list(volume) OVER {C5}, lambda y: y < volume)) + (len(list_filter(list(volume) OVER {C5}, lambda y: y = volume)) - 1) / 2.0::DOUBLE) / 4"),
    "decay": f"CASE WHEN row_number() OVER ({WT}) >= 4 THEN (4 * volume + 3 * {lag('volume')} + 2 * {lag('volume', 2)} + {lag('volume', 3)}) / 10 ELSE 0 END",
    "corr": full(6, "close", f"covar_samp(close, volume) OVER {win(6)} / nullif(stddev_samp(close) OVER {win(6)} * stddev_samp(volume) OVER {win(6)}, 0)"), "cov": full(6, "close", f"covar_samp(close, volume) OVER {win(6)}"),
}
register("stream_replayed", lambda spark, d: rounded(replayed(spark, weekly(spark, d)), {"growth": 2, "cov": 3} | {c: 5 for c in STREAMED if c not in ("growth", "cov")}), sql(
    "SELECT date, ticker, " + ", ".join(f"{rnd(f'CAST({STREAM_SQL[c]} AS DOUBLE)', {'growth': 2, 'cov': 3}.get(c, 5))} AS {c}" for c in STREAMED) + " FROM f"))

# ---- means of arrays


def array_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each date's bars as an array of rows (open, high, low, close) by ticker."""
    bars = trade_panel(spark, sf_dir).groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("ticker", F.array("open", "high", "low", "close").alias("bar")))), lambda r: r["bar"]).alias("bars"))
    columns, some = cs_mean(F.col("bars"), axis="column"), cs_mean(F.col("bars"), start=1, end=-1)
    return rounded(bars.select("date", cs_mean(F.col("bars"), row=0).alias("first"), columns[0].alias("open"), columns[3].alias("close"), F.size(some).cast("long").alias("n"), F.try_element_at(some, F.lit(1)).alias("second")))


register("op_cs_mean_array", array_means, sql(
    f"SELECT date, {rnd('max(CASE WHEN k = 1 THEN m END)')} AS first, {rnd('avg(open)')} AS open, {rnd('avg(close)')} AS close, greatest(count(*) - 2, 0)::BIGINT AS n, {rnd('max(CASE WHEN k = 2 AND c > 2 THEN m END)')} AS second FROM k GROUP BY date",
    "k AS (SELECT date, open, close, (open + high + low + close) / 4 AS m, row_number() OVER (PARTITION BY date ORDER BY ticker) AS k, count(*) OVER (PARTITION BY date) AS c FROM panel)"))
register("attr_ordered", lambda spark, d: rounded(at.attribution(backtest(spark, d).panel, horizon="yearly", groups=("sector",), book_size=BOOK, ordered=True).select("date", "sector", "contribution_pnl"), 5), sql(
    f"SELECT date, sector, {rnd('contribution_pnl', 5)} AS contribution_pnl FROM att ORDER BY date, contribution_pnl DESC", *simulated_sql(), *attr_sql("make_date(year(date), 12, 31)", "sector")))
