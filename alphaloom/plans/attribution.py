"""Where PnL comes from: contributions of tickers, groups and sides by period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import HORIZONS
from .simulate import period_end


def _zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def asset_attribution(df: DataFrame, *, book_size: float, weight: str = "weights") -> DataFrame:
    """df with contribution_pnl (kept if it is there, else from pnl, weighted_ret, or ret and weights) and contribution_return."""
    if "date" not in df.columns:
        raise ValueError("attribution needs a date column")
    if "contribution_pnl" not in df.columns:
        if "pnl" in df.columns:
            value = _zero(F.col("pnl"))
        elif "weighted_ret" in df.columns:
            value = _zero(F.col("weighted_ret")) * float(book_size)
        elif {"ret", weight} <= set(df.columns):
            value = _zero(F.col("ret")) * _zero(F.col(weight)) * float(book_size)
        else:
            raise ValueError("attribution needs pnl, weighted_ret, or ret and weights")
        df = df.withColumn("contribution_pnl", value)
    return df.withColumn("contribution_return", F.col("contribution_pnl") / float(book_size))


def attribution(df: DataFrame, *, horizon: str = "daily", groups: tuple[str, ...] = ("ticker",), book_size: float, weight: str = "weights", flat: float = 0.0, ordered: bool = False) -> DataFrame:
    """Contribution of each group in each period, missing groups among them, and its share of the period's PnL; if ``ordered``, by date and falling PnL.

    ``full`` keeps single dates; sum over them for the sample. Mean weights of a size up to ``flat`` (what rounding leaves) are on no side.
    """
    if horizon not in HORIZONS:
        raise ValueError(f"a horizon is one of {list(HORIZONS)}")
    asset = asset_attribution(df, book_size=book_size, weight=weight)
    if missing := [g for g in groups if g not in asset.columns]:
        raise ValueError(f"no columns {missing} to group by")
    when = F.col("date").cast("date") if horizon == "full" else period_end(horizon)
    sums = [F.sum("contribution_pnl").alias("contribution_pnl"), F.sum("contribution_return").alias("contribution_return"), F.count("*").alias("observations")]
    weighted = weight in asset.columns
    if weighted:
        sums += [F.avg(F.abs(weight)).alias("avg_abs_weight"), F.avg(weight).alias("avg_weight")]
    out = asset.withColumn("_period", when).groupBy(F.col("_period").alias("date"), *groups).agg(*sums)
    out = out.withColumn("period_pnl", F.sum("contribution_pnl").over(Window.partitionBy("date")))
    out = out.withColumn("contribution_pct", F.when(F.col("period_pnl") != 0, F.col("contribution_pnl") / F.col("period_pnl")))
    out = out.withColumn("side", side_of("avg_weight", flat)) if weighted else out
    return out.orderBy("date", F.desc("contribution_pnl")) if ordered else out


def side_of(weight: str, flat: float = 0.0) -> Column:
    return F.when(F.col(weight) > flat, "long").when(F.col(weight) < -flat, "short").otherwise("flat")


def side_attribution(df: DataFrame, *, horizon: str = "daily", book_size: float, weight: str = "weights", flat: float = 0.0) -> DataFrame:
    """Attribution to long, short and flat rows."""
    out = attribution(df.withColumn("row_side", side_of(weight, flat)), horizon=horizon, groups=("row_side",), book_size=book_size, weight=weight)
    return out.withColumn("side", F.col("row_side")).drop("row_side")


def attribution_sets(df: DataFrame, *, horizon: str = "daily", groups: tuple[str, ...] = ("ticker", "industry", "sector"), book_size: float, weight: str = "weights", flat: float = 0.0) -> DataFrame:
    """Attribution to each of several columns and to sides, all from one pass over the panel: kind, name (as text) and the columns of ``attribution``.

    Grouping sets expand a row to one a kind, and those are summed before they move.
    """
    if horizon not in HORIZONS:
        raise ValueError(f"a horizon is one of {list(HORIZONS)}")
    asset = asset_attribution(df, book_size=book_size, weight=weight)
    if missing := [g for g in (*groups, weight) if g not in asset.columns]:
        raise ValueError(f"no columns {missing} to group by")
    when = F.col("date").cast("date") if horizon == "full" else period_end(horizon)
    kinds = [*groups, "side"]
    named = asset.select(when.alias("_period"), *(F.col(g).cast("string").alias(f"_{g}") for g in groups), side_of(weight, flat).alias("_side"), "contribution_pnl", "contribution_return", F.col(weight).alias("_w"))
    period = F.col("_period")
    sums = named.groupingSets([[period, F.col(f"_{k}")] for k in kinds], period, *(F.col(f"_{k}") for k in kinds)).agg(
        *(F.grouping(f"_{k}").alias(f"_is_{k}") for k in kinds),
        F.sum("contribution_pnl").alias("contribution_pnl"), F.sum("contribution_return").alias("contribution_return"), F.count("*").alias("observations"),
        F.avg(F.abs("_w")).alias("avg_abs_weight"), F.avg("_w").alias("avg_weight"),
    )
    of = lambda value: F.coalesce(*(F.when(F.col(f"_is_{k}") == 0, value(k)) for k in kinds))
    out = sums.select(period.alias("date"), of(F.lit).alias("kind"), of(lambda k: F.col(f"_{k}")).alias("name"), "contribution_pnl", "contribution_return", "observations", "avg_abs_weight", "avg_weight")
    out = out.withColumn("period_pnl", F.sum("contribution_pnl").over(Window.partitionBy("date", "kind")))
    out = out.withColumn("contribution_pct", F.when(F.col("period_pnl") != 0, F.col("contribution_pnl") / F.col("period_pnl")))
    return out.withColumn("side", F.when(F.col("kind") == "side", F.col("name")).otherwise(side_of("avg_weight", flat)))


def nearest_period(dates: DataFrame, day: str) -> DataFrame:
    """The one date nearest to day, the earlier of two."""
    return dates.select(F.col("date").cast("date").alias("date")).distinct().orderBy(F.abs(F.datediff("date", F.lit(day).cast("date"))), "date").limit(1)


def attribution_snapshot(table: DataFrame, *, period: str | None = None, top: int = 20, groups: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The largest contributions by size of the newest period, or of the one nearest to a day."""
    at = table.agg(F.max("date").alias("date")) if period is None else nearest_period(table, period)
    return table.join(F.broadcast(at), "date", "left_semi").orderBy(F.desc(F.abs("contribution_pnl")), *groups).limit(top)


def panel_snapshot(df: DataFrame, *, horizon: str = "daily", period: str | None = None, groups: tuple[str, ...] = ("ticker",), limit: int = 10, book_size: float, weight: str = "weights") -> DataFrame:
    """The same from a panel: its attribution by horizon, then the period's largest contributions."""
    return attribution_snapshot(attribution(df, horizon=horizon, groups=groups, book_size=book_size, weight=weight), period=period, top=limit, groups=groups)


def group_labels(groups: tuple[str, ...]) -> Column:
    return F.concat_ws(" / ", *[F.coalesce(F.col(g).cast("string"), F.lit("None")) for g in groups])


def group_returns(df: DataFrame, group: str, *, book_size: float) -> DataFrame:
    """date, group (as text), ret: a group's PnL over the book, in long form."""
    named = df.select("date", F.coalesce(F.col(group).cast("string"), F.lit("None")).alias("group"), "pnl")
    return named.groupBy("date", "group").agg((F.coalesce(F.sum("pnl"), F.lit(0.0)) / float(book_size)).alias("ret"))


def group_return_matrix(df: DataFrame, group: str, *, book_size: float, names: list[str] | None = None) -> DataFrame:
    """One row a date, one column a group, 0 where a group has no rows. Without names the groups are looked up."""
    if group not in df.columns or "pnl" not in df.columns:
        return df.sparkSession.createDataFrame([], "date date")
    returns = group_returns(df, group, book_size=book_size)
    return returns.groupBy("date").pivot("group", *([names] if names else [])).agg(F.sum("ret")).na.fill(0.0)


def group_correlations(df: DataFrame, group: str, *, book_size: float, top: int = 12) -> DataFrame:
    """(a, b, correlation) of the daily returns of the groups with the largest sum of sizes; absent days count as 0.

    The panel is summed once to a row a date and group; ``top`` groups are broadcast. Then each date is one
    row with the returns of its largest groups, and their pairs are explosions of that row, at most ``top`` squared.
    """
    returns = group_returns(df, group, book_size=book_size)
    sized = returns.withColumn("size", F.sum(F.abs("ret")).over(Window.partitionBy("group")))
    largest = sized.groupBy("group", "size").agg(F.count("*").alias("n")).orderBy(F.desc("size"), "group").limit(top).select("group", F.lit(True).alias("large"))
    days = sized.join(F.broadcast(largest), "group", "left").groupBy("date").agg(F.map_from_entries(F.collect_list(F.when(F.col("large"), F.struct("group", "ret")))).alias("held"))
    names = largest.agg(F.sort_array(F.collect_set("group")).alias("names"))
    # one row of at most ``top`` names
    pairs = days.crossJoin(F.broadcast(names)).select("held", "names", F.explode("names").alias("a")).select("held", "a", F.explode("names").alias("b"))
    x, y = (F.coalesce(F.element_at("held", F.col(k)), F.lit(0.0)) for k in ("a", "b"))
    sx, sy = F.stddev_samp("x"), F.stddev_samp("y")
    return pairs.select("a", "b", x.alias("x"), y.alias("y")).groupBy("a", "b").agg(F.when((sx > 0) & (sy > 0), F.covar_samp("x", "y") / (sx * sy)).alias("correlation"))
