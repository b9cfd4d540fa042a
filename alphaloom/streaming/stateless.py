"""Row-wise formulas and fields over a stream of bars, and bars made of a stream of trades.

Windows that count rows cannot run on a stream; what each row decides alone can, and so can
sums within time windows under a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.library import REGISTRY, ROW
from ..plans.expr import Call, Expr, walk
from ..plans.lower import Lowering
from ..sources.panels import BUILD

ROW_FIELDS = ("typical_price", "dollar_volume", "market_cap")


def stream_fields(bars: DataFrame, names: list[str]) -> DataFrame:
    """bars with the derived fields that need no other row."""
    if wrong := [n for n in names if n not in ROW_FIELDS]:
        raise ValueError(f"{wrong} look at other rows; over a stream there are {ROW_FIELDS}")
    return bars.withColumns({n: BUILD[n]() for n in names})


def stream_signal(bars: DataFrame, name: str, e: Expr) -> DataFrame:
    """bars with a row-wise formula as a column."""
    if wrong := sorted({n.name for n in walk(e) if isinstance(n, Call) and REGISTRY[n.name].scope != ROW}):
        raise ValueError(f"{wrong} look at other rows, which a stream does not keep")
    return Lowering(bars).result({name: e})


def stream_bars(trades: DataFrame, *, time: str = "ts", ticker: str = "user_id", value: str = "value", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars of a stream of trades: one row a window and ticker, once the watermark has passed it."""
    seen = trades.where(f"{ticker} is not null and {value} is not null").withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = seen.groupBy(F.window(time, every).alias("w"), F.col(ticker).alias("ticker"))
    return window.agg(F.max(value).alias("high"), F.min(value).alias("low"), F.avg(value).alias("close"), F.count("*").cast("double").alias("volume")).select(F.col("w.start").alias("date"), "ticker", "high", "low", "close", "volume")
