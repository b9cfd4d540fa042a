"""Panels: derived fields, the universe, and panels made of order and event tables.

Prices of the made panels are ratios of exact integer sums, so that any engine gets the same
doubles whatever order it sums in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Universe
from ..fields import DERIVED, FIELDS, STATIC, with_dependencies
from ..operators.library import Scope, _full, _window, no_nan

SCOPE = Scope()


def cleaned(df: DataFrame) -> DataFrame:
    """df with null for NaN in every column of doubles."""
    return df.withColumns({n: no_nan(F.col(f"`{n}`")) for n, t in df.dtypes if t in ("double", "float")})


def _returns() -> Column:
    split = F.when(F.col("splits") == 0, 1.0).otherwise(F.col("splits"))
    before = F.lag("close").over(SCOPE.time())
    return F.when(before != 0, (F.col("close") * split + F.col("dividends")) / before - 1)


def _typical() -> Column:
    seen = [F.col(c) for c in ("high", "low", "close")]
    n = sum((c.isNotNull().cast("int") for c in seen[1:]), seen[0].isNotNull().cast("int"))
    return F.when(n > 0, sum((F.coalesce(c, F.lit(0.0)) for c in seen[1:]), F.coalesce(seen[0], F.lit(0.0))) / n)


BUILD = {
    "returns": _returns,
    "typical_price": _typical,
    "dollar_volume": lambda: F.col("close") * F.col("volume"),
    "market_cap": lambda: F.col("close") * F.col("shares_outstanding"),
    "adv20": lambda: F.avg("dollar_volume").over(_window(SCOPE, 20)),
    "volatility20": lambda: _full(SCOPE, 20, F.col("returns"), F.stddev_samp("returns").over(_window(SCOPE, 20))),
}


def with_derived(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the derived fields among ``names`` and those they need, unless it has them."""
    for name in with_dependencies(names):
        if name in DERIVED and name not in df.columns:
            if name not in BUILD:
                raise ValueError(f"no derivation is known for {name!r}")
            df = df.withColumn(name, BUILD[name]())
    return df


def universe_mask(df: DataFrame, size: int | Universe, by: str = "adv20") -> DataFrame:
    """df with in_universe: among the ``size`` largest of its date; missing values never are; ties by ticker."""
    n = size.value if isinstance(size, Universe) else int(size)
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(by), "ticker"))
    return df.withColumn("in_universe", (place <= n) & F.col(by).isNotNull())


def ordered(df: DataFrame, requested: list[str]) -> list[str]:
    """Columns in catalogue order, then as requested, then the rest."""
    first = [c for c in FIELDS if c in df.columns]
    return list(dict.fromkeys(first + [c for c in requested if c in df.columns] + df.columns))


def to_long(wide: DataFrame, fields: dict[str, str], date: str = "date") -> DataFrame:
    """(date, ticker, fields) from columns named ``<ticker>_<source field>``; rows without a close go.

    A row becomes an array with a struct a ticker and that is exploded, so the input is read once for any number of tickers.
    """
    held: dict[str, set[str]] = {}
    for c in wide.columns:
        if c != date:
            ticker, source = c.rsplit("_", 1)
            held.setdefault(ticker, set()).add(source)
    value = lambda t, source: (F.col(f"`{t}_{source}`") if source in held[t] else F.lit(None)).cast("double")
    bars = [F.struct(F.lit(t).alias("ticker"), *(value(t, source).alias(name) for source, name in fields.items())) for t in sorted(held)]
    if not bars:
        raise ValueError("there is no column of a ticker")
    out = wide.select(F.to_date(date).alias("date"), F.explode(F.array(*bars)).alias("_bar")).select("date", "_bar.*")
    return cleaned(out).dropna(subset=["close"])


def cells_to_long(wide: DataFrame, fields: dict[str, str], date: str = "date", cells: str = "cells") -> DataFrame:
    """The same from rows that hold their columns as a map from ``<ticker>_<source field>`` to the value: for more tickers than a plan can have columns.

    A ticker's cells of a date may come in several rows, each of them once.
    """
    if not fields:
        raise ValueError("there is no field")
    source = F.substring_index("_name", "_", -1)
    ticker = F.when(F.contains("_name", F.lit("_")), F.left("_name", F.length("_name") - F.length(source) - 1)).otherwise(F.raise_error(F.concat(F.lit("a column without a ticker: "), "_name")))
    named = wide.select(F.to_date(date).alias("date"), F.explode(cells).alias("_name", "_value"))
    named = named.select("date", ticker.alias("ticker"), source.alias("_source"), no_nan(F.col("_value").cast("double")).alias("_value")).where(F.col("_source").isin(list(fields)))
    held = {name: F.when(F.col("_source") == s, F.col("_value")) for s, name in fields.items()}
    twice = F.greatest(F.lit(0), *(F.count(v) for v in held.values())) > 1
    bars = named.groupBy("date", "ticker").agg(*(F.max(v).alias(name) for name, v in held.items()), twice.alias("_twice"))
    message = F.concat(F.lit("more than one value for "), F.col("ticker"), F.lit(" on "), F.col("date").cast("string"))
    checked = F.when(F.col("_twice"), F.raise_error(message).cast("double")).otherwise(F.col("close"))
    return bars.withColumn("close", checked).drop("_twice").dropna(subset=["close"])


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # nation and region have tens of rows by definition; suppliers are joined by their size
    place = F.broadcast(read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("sector"), F.col("n_name").alias("industry")))
    return read("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("ticker"), "sector", "industry", (F.abs("s_acctbal") * 1000).alias("shares_outstanding"))


def trade_panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """One row a period and supplier that has line items then: a bar of unit prices, with sector and industry.

    Aggregated before the join, so only bars are joined to suppliers.
    """
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    shipped = F.col("l_shipdate").cast("timestamp_ntz").cast("date")
    day = shipped if unit == "day" else F.trunc(shipped, unit)
    bars = item.where("l_quantity > 0").groupBy(day.alias("date"), F.col("l_suppkey").alias("ticker")).agg(
        F.sum(cents).alias("_cents"),
        F.sum(F.round("l_quantity").cast("long")).alias("_units"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max("l_tax").alias("_tax"),
    )
    bars = bars.select(
        "date", "ticker", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low",
        (F.col("_cents") / F.lit(100.0) / F.col("_units")).alias("close"), F.col("_units").cast("double").alias("volume"),
        F.round("_tax", 2).alias("dividends"), F.when(F.weekofyear("date") == 1, 2.0).otherwise(0.0).alias("splits"),
    )
    return bars.join(_suppliers(spark, sf_dir), "ticker", "left").select("date", "ticker", "open", "high", "low", "close", "volume", "dividends", "splits", *STATIC)


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day and user with events: close is the mean value, to the cent, and volume the count."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long")
    return events.where("user_id is not null and value is not null").groupBy(F.to_date("ts").alias("date"), F.col("user_id").alias("ticker")).agg(
        (F.sum(cents) / F.lit(100.0) / F.count("*")).alias("close"), F.count("*").cast("double").alias("volume")
    )
