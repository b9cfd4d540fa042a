"""From weights to trades, PnL and the portfolio: per ticker, per date, per period.

Windows along tickers scale with the tickers. Portfolio windows have no key, but their input is
one row a date: everything is summed by date first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import Delay
from ..functions import metrics as m
from ..operators.library import no_nan, num

SHARPE_WARMUP, SHARPE_WINDOW = 48, 63

def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def running() -> WindowSpec:
    return by_ticker().rowsBetween(Window.unboundedPreceding, 0)


def by_date(*sample: str) -> WindowSpec:
    """All rows in date order, of each sample if there are some: for tables with one row a date."""
    return Window.partitionBy(*sample).orderBy("date")


def allocations(df: DataFrame, *, delay: Delay = Delay.ONE, book_size: float = 1.0, weight: str = "weights") -> DataFrame:
    """Weights as held, delay + 1 rows after they are known (``target_weights`` keeps the known ones), and trades."""
    wait = Delay(delay).value + 1
    out = df.withColumn("target_weights", F.col(weight)).withColumn(weight, F.coalesce(F.lag(weight, wait).over(by_ticker()), F.lit(0.0)))
    out = out.withColumn("exposure", F.col(weight) * float(book_size))
    out = out.withColumns({"previous_exposure": F.coalesce(F.lag("exposure").over(by_ticker()), F.lit(0.0)), "_row": F.row_number().over(by_ticker())})
    out = out.withColumn("trade_size", F.col("exposure") - F.col("previous_exposure"))
    out = out.withColumn("trade_volume", F.abs("trade_size"))
    return out.withColumns({
        "sign": F.signum(F.col(weight)).cast("int"),
        "rebalanced": F.when(F.col("_row") > wait, (F.col("trade_volume") > 1e-8).cast("double")),
    }).drop("_row")


def asset_returns(df: DataFrame, *, returns: str = "returns", ret: str = "ret") -> DataFrame:
    """PnL and running PnL and returns of each ticker; a missing return of a name that is not held makes no PnL."""
    out = df.withColumnRenamed(returns, ret)
    r = F.col(ret)
    out = out.withColumns({
        "pnl": F.when(F.col("exposure") == 0, F.lit(0.0)).otherwise(F.col("exposure") * r),
        "log_ret": F.coalesce(F.when(r > -1, F.log1p(r)), F.lit(0.0)),
    })
    return out.withColumns({
        "cum_pnl": F.when(F.col("pnl").isNotNull(), F.sum("pnl").over(running())),
        "cum_ret": F.when(r.isNotNull(), F.product(1 + r).over(running()) - 1),
        "cum_log_ret": F.sum("log_ret").over(running()),
    })


def _trailing(values: dict[str, Column], frame, days: Column) -> dict[str, Column]:
    n = F.count(values["pnl"]).over(frame)
    ready = n >= days
    mean = F.when(ready, F.avg(values["pnl"]).over(frame))
    vol = F.when(ready, F.stddev_samp(values["pnl"]).over(frame))
    return {"mean": mean, "sharpe": F.when(vol > 0, mean / vol * m.TRADING_DAYS**0.5), "valid": vol > 0, "turnover": F.when(F.count(values["turnover"]).over(frame) >= days, F.avg(values["turnover"]).over(frame))}


def daily_portfolio(df: DataFrame, *, book_size: float = 1.0, weight: str = "weights", warmup: int = SHARPE_WARMUP, window: int = SHARPE_WINDOW) -> DataFrame:
    """One row a date: sums over its names, then returns, turnover, running and rolling figures."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    w = F.col(weight)
    sums = df.groupBy("date").agg(
        total("pnl").alias("pnl"),
        total("trade_volume").alias("trade_volume"),
        total(F.abs(w)).alias("gross_exposure"),
        total(w).alias("net_exposure"),
        total("rebalanced").alias("rebalanced"),
        F.count_if(w > 0).alias("long_count"),
        F.count_if(w < 0).alias("short_count"),
    )
    book = float(book_size)
    out = sums.withColumns({"ret": F.col("pnl") / book, "turnover": F.col("trade_volume") / book, "margin": m.margin(F.col("pnl"), F.col("trade_volume")), "number_of_trades": F.col("long_count") + F.col("short_count")})
    run = by_date().rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"ann_ret": F.col("ret") * m.TRADING_DAYS, "log_ret": F.when(F.col("ret") > -1, F.log1p("ret")), "cum_pnl": F.sum("pnl").over(run), "cum_ret": F.product(1 + F.col("ret")).over(run) - 1})
    days = F.greatest(F.lit(2), F.least(F.lit(warmup), F.count("*").over(Window.partitionBy())))
    values = {"pnl": F.col("pnl"), "turnover": F.col("turnover")}
    grown, rolled = _trailing(values, run, days), _trailing(values, by_date().rowsBetween(-(window - 1), 0), days)
    score = lambda t: F.when(t["valid"], m.capacity_score(t["mean"] * m.TRADING_DAYS / book, t["sharpe"], t["turnover"]))
    return out.withColumns({
        "cum_log_ret": F.when(F.col("log_ret").isNotNull(), F.sum("log_ret").over(run)),
        "expanding_sharpe": grown["sharpe"],
        "rolling_sharpe": rolled["sharpe"],
        "expanding_capacity_score": score(grown),
        "rolling_capacity_score": score(rolled),
        "drawdown": (F.col("cum_pnl") - F.max("cum_pnl").over(run)) / book,
    })


def period_end(horizon: str, date: str = "date", sample: tuple[str, ...] = ()) -> Column:
    """A date's period, named by its last day; the whole sample by its last date."""
    if horizon not in m.HORIZONS:
        raise ValueError(f"a horizon is one of {list(m.HORIZONS)}")
    day = F.col(date).cast("date")
    if horizon == "full":
        return F.max(day).over(Window.partitionBy(*sample))
    return {"daily": day, "monthly": F.last_day(day), "yearly": F.make_date(F.year(day), F.lit(12), F.lit(31))}[horizon]


def aggregate_returns(daily: DataFrame, horizon: str = "daily", *, delay: Delay = Delay.ONE, book_size: float = 1.0, warmup: bool = True, sharpe_warmup: int = SHARPE_WARMUP, sample: tuple[str, ...] = ()) -> DataFrame:
    """One row a period. Exposure, turnover and rebalancing skip the sample's first delay + 1 dates; Sharpe and
    capacity count dates from the sample's 49th on (``warmup``), or all; both kinds are there as well. Rows that differ
    in the columns ``sample`` are samples of their own."""
    book, wait = float(book_size), Delay(delay).value + 1
    rows = daily.withColumns({"_i": F.row_number().over(by_date(*sample)) - 1, "_n": F.count("*").over(Window.partitionBy(*sample)), "_period": period_end(horizon, sample=sample)})
    built = (F.col("_n") <= wait) | (F.col("_i") >= wait)
    post = (F.col("_n") > sharpe_warmup) & (F.col("_i") >= sharpe_warmup) if warmup else F.lit(False)
    restarted = Window.partitionBy(*sample, "_period").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.sum(F.coalesce("pnl", F.lit(0.0))).over(restarted)).withColumn("_dd", F.col("_cum") - F.max("_cum").over(restarted))
    on = lambda c, test: F.when(test, F.col(c))
    pnl, ret = F.col("pnl"), F.col("ret")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    agg = rows.groupBy(*sample, F.col("_period").alias("date")).agg(
        m.annualised_return(pnl, book).alias("ret"),
        (m.get_volatility(ret) * m.TRADING_DAYS**0.5).alias("vol"),
        (m.get_variance(ret) * m.TRADING_DAYS).alias("var"),
        zero("pnl").alias("pnl"),
        m.get_mean(pnl).alias("mean_pnl"),
        zero("log_ret").alias("log_ret"),
        F.avg(on("turnover", built)).alias("turnover"),
        zero("trade_volume").alias("trade_volume"),
        (F.min("_dd") / book).alias("drawdown"),
        m.sharpe(pnl).alias("sharpe_full"),
        m.sharpe(on("pnl", post)).alias("sharpe_warmup"),
        m.annualised_return(on("pnl", post), book).alias("ret_warmup"),
        F.avg(on("turnover", post)).alias("turnover_warmup"),
        F.avg("long_count").alias("long_count"),
        F.avg("short_count").alias("short_count"),
        m.perc_profitable_days(ret).alias("perc_profitable_days"),
        F.avg(on("gross_exposure", built)).alias("avg_gross_exposure"),
        F.avg(on("net_exposure", built)).alias("avg_net_exposure"),
        F.avg(on("rebalanced", built)).alias("avg_rebalanced"),
    )
    c = F.col
    agg = agg.withColumns({
        "capacity_score_full": m.capacity_score(c("ret"), c("sharpe_full"), c("turnover")),
        "capacity_score_warmup": m.capacity_score(c("ret_warmup"), c("sharpe_warmup"), c("turnover_warmup")),
        "margin": F.when(c("trade_volume") > 0, c("pnl") / c("trade_volume")),
        "number_of_trades": c("long_count") + c("short_count"),
    })
    kind = "warmup" if warmup else "full"
    run = by_date(*sample).rowsBetween(Window.unboundedPreceding, 0)
    return agg.withColumns({"sharpe": c(f"sharpe_{kind}"), "capacity_score": c(f"capacity_score_{kind}"), "cum_pnl": F.sum("pnl").over(run), "cum_log_ret": F.sum("log_ret").over(run)})


def summary(daily: DataFrame, *, delay: Delay = Delay.ONE, book_size: float = 1.0, warmup: bool = True, sharpe_warmup: int = SHARPE_WARMUP) -> DataFrame:
    """The sample's figures in one row, as numbers; ``formatted_summary`` writes them out."""
    book, wait = float(book_size), Delay(delay).value + 1
    rows = daily.withColumn("_i", F.row_number().over(by_date()) - 1)
    later = lambda c: F.avg(F.when(F.col("_i") >= wait, F.col(c)))
    post = F.when((F.col("_i") >= sharpe_warmup) if warmup else F.lit(True), F.col("pnl"))
    agg = rows.groupBy().agg(
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"),
        m.annualised_return(F.col("pnl"), book).alias("annualised_return"),
        F.avg("ret").alias("avg_return"),
        (F.stddev_samp("ret") * m.TRADING_DAYS**0.5).alias("volatility"),
        m.sharpe(post).alias("sharpe"),
        later("turnover").alias("turnover"),
        m.annualised_return(post, book).alias("_ret"),
        F.avg(F.when(post.isNotNull(), F.col("turnover"))).alias("_turnover"),
        (-F.min("drawdown")).alias("drawdown"),
        F.sum("trade_volume").alias("_volume"),
        F.avg("long_count").alias("long"),
        F.avg("short_count").alias("short"),
        F.avg("number_of_trades").alias("trades_per_day"),
        m.perc_profitable_days(F.col("ret")).alias("profitable_days"),
        later("gross_exposure").alias("avg_gross_exposure"),
        later("net_exposure").alias("avg_net_exposure"),
        later("rebalanced").alias("avg_rebalances"),
    )
    c = F.col
    return agg.withColumns({"capacity_score": m.capacity_score(c("_ret"), c("sharpe"), c("_turnover")), "margin": F.when(c("_volume") > 0, c("total_pnl") / c("_volume"))}).drop("_ret", "_turnover", "_volume")


def _percent(x: float | None) -> str:
    return "" if x is None else f"{round(x * 100, 2)}%"


def formatted_summary(row: dict) -> dict[str, str | float | None]:
    """The summary's row in words: 16 figures with their names and units."""
    two = lambda x: None if x is None else round(x, 2)
    return {
        "Total PnL": two(row["total_pnl"]), "Annualised return": _percent(row["annualised_return"]), "Avg Return": _percent(row["avg_return"]), "Volatility": _percent(row["volatility"]),
        "Sharpe": two(row["sharpe"]), "Turnover": _percent(row["turnover"]), "Capacity score": two(row["capacity_score"]), "Drawdown": _percent(row["drawdown"]),
        "Margin": "" if row["margin"] is None else f"{round(row['margin'] * 10000, 2)}bps", "Long": f"{two(row['long'])}", "Short": f"{two(row['short'])}", "Trades per day": f"{two(row['trades_per_day'])}",
        "% Profitable Days": _percent(row["profitable_days"]), "Avg Gross Exposure": _percent(row["avg_gross_exposure"]), "Avg Net Exposure": _percent(row["avg_net_exposure"]), "Avg Rebalances": two(row["avg_rebalances"]),
    }


def rolling_beta_alpha(portfolio: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """date, beta, alpha_annualised from (date, p) and (date, b) over ``window`` common dates; none before there are so many."""
    both = portfolio.join(benchmark, "date").where("p is not null and b is not null")
    p, b = no_nan(num(F.col("p"))), no_nan(num(F.col("b")))
    w = by_date().rowsBetween(-(window - 1), 0)
    full = F.count(F.lit(1)).over(w) == window
    var = F.var_samp(b).over(w)
    beta = F.when(full & (var > 0), F.covar_samp(p, b).over(w) / var)
    out = both.select("date", beta.alias("beta"), F.avg(p).over(w).alias("_p"), F.avg(b).over(w).alias("_b"))
    return out.select("date", "beta", ((F.col("_p") - F.col("beta") * F.col("_b")) * m.TRADING_DAYS).alias("alpha_annualised"))


def benchmark_pnl(dates: DataFrame, closes: DataFrame, tickers: list, book_size: float) -> DataFrame:
    """Cumulative PnL of a book held in each of a few benchmark tickers: one column a ticker, on the portfolio's dates.

    ``closes`` has date, ticker, close. A close holds until the next portfolio date that has one; closes
    between portfolio dates are not looked at; the base is the first date's close.
    """
    wide = closes.groupBy("date").pivot("ticker", tickers).agg(F.first("close"))
    run = by_date().rowsBetween(Window.unboundedPreceding, 0)
    out = dates.select("date").distinct().join(wide, "date", "left")
    held = out.select("date", *[F.last(f"`{t}`", ignorenulls=True).over(run).alias(str(t)) for t in tickers], *[F.first(f"`{t}`").over(run).alias(f"_{t}") for t in tickers])
    return held.select("date", *[((F.col(f"`{t}`") / F.col(f"`_{t}`") - 1) * float(book_size)).alias(str(t)) for t in tickers])


def aligned_closes(dates: DataFrame, closes: DataFrame, *, between: bool = False) -> DataFrame:
    """(date, ticker, close) for every ticker on every one of ``dates``: its last close there is until then.

    Closes on other dates count only if those ``between`` shall. Dates and closes are one table sorted within ticker, for any
    number of tickers: no pivot, and no window over all of them.
    """
    days = dates.select(F.col("date").cast("date").alias("date")).distinct()
    held = closes.select(F.col("date").cast("date").alias("date"), "ticker", "close")
    held = held if between else held.join(days, "date", "left_semi")
    # the calendar as one row: a few bytes a date
    calendar = F.broadcast(days.agg(F.sort_array(F.collect_list("date")).alias("days")))
    asked = closes.select("ticker").distinct().crossJoin(calendar).select(F.explode("days").alias("date"), "ticker", F.lit(None).cast("double").alias("close"), F.lit(1).alias("asked"))
    both = held.select("date", "ticker", F.col("close").cast("double").alias("close"), F.lit(0).alias("asked")).unionByName(asked)
    until = Window.partitionBy("ticker").orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("close", F.last("close", ignorenulls=True).over(until)).where("asked = 1").select("date", "ticker", "close")


def aligned_pnl(dates: DataFrame, closes: DataFrame, book_size: float, *, between: bool = False) -> DataFrame:
    """(date, ticker, cum_pnl) of a book held in each ticker, on every one of ``dates``; the base is its close on the first of them, without which there is no PnL."""
    own = Window.partitionBy("ticker").orderBy("date")
    rows = aligned_closes(dates, closes, between=between).withColumn("base", F.first("close").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("date", "ticker", F.when(F.col("base") != 0, (F.col("close") / F.col("base") - 1) * float(book_size)).alias("cum_pnl"))
