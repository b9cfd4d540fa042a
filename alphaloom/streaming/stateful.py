"""Windows that count rows, over a stream of bars.

Each ticker keeps as state its last bars, as many as the longest window looks back, and the bars that have come but that the watermark
has not passed. Once it has, they are taken in the order of their own time, however they arrived, and
each gives one row. A bar that comes when its ticker has already given out a bar of that time or a later one is dropped;
within the allowed lateness that cannot happen. A ticker that is quiet for as long as ``expire`` gives up its state and starts anew.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import NAMES, depth, rolling
from ..plans.expr import Call, Expr, Field, Literal

STATE = "held binary"


def _plan(formulas: dict[str, Expr]) -> dict[str, tuple[str, list[str], int]]:
    """name: (operator, its columns, its window) of formulas that are one operator along a ticker over columns."""
    from ..operators.library import REGISTRY

    out = {}
    for name, e in formulas.items():
        operator = REGISTRY[e.name].name if isinstance(e, Call) and e.name in REGISTRY else None
        args = list(e.args) if isinstance(e, Call) else []
        columns, rest = [a.name for a in args if isinstance(a, Field)], [a.value for a in args if isinstance(a, Literal)]
        if operator not in NAMES or len(rest) != 1 or len(columns) + 1 != len(args):
            raise ValueError(f"{e}: over a stream there are {sorted(NAMES)} of columns, with one number of rows")
        out[name] = (operator, columns, int(rest[0]))
    return out


def stream_windows(bars: DataFrame, formulas: dict[str, Expr], *, late: str = "1 day", expire: str = "400 days", date: str = "date", ticker: str = "ticker") -> DataFrame:
    """date, ticker and the formulas for every bar of the stream, once the watermark (``late`` behind the latest bar) has passed it."""
    plan = _plan(formulas)
    inputs = sorted({c for _, columns, _ in plan.values() for c in columns})
    back = max(depth(op, n) for op, _, n in plan.values())
    quiet = int(pd.Timedelta(expire).total_seconds() * 1000)
    kind = dict(bars.dtypes)[ticker]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        # history and waiting bars: times in milliseconds, and a column an input; how many bars came before the history; the last time given out
        empty = np.zeros((0, len(inputs)))
        tail, times, waiting, seen, last = pickle.loads(state.get[0]) if state.exists else (empty, np.zeros(0, np.int64), empty, 0, None)
        for frame in frames:
            new = frame["_ms"].to_numpy(np.int64)
            timely = np.ones(len(new), bool) if last is None else new > last
            times = np.concatenate([times, new[timely]])
            waiting = np.concatenate([waiting, frame[inputs].to_numpy(float)[timely]])
        order = np.argsort(times, kind="stable")
        times, waiting = times[order], waiting[order]
        passed = state.getCurrentWatermarkMs()
        n = int(np.searchsorted(times, passed, "right"))
        if n:
            rows = np.concatenate([tail, waiting[:n]])
            made = {name: rolling(op, [rows[:, inputs.index(c)] for c in columns], w, before=len(tail), seen=seen) for name, (op, columns, w) in plan.items()}
            yield pd.DataFrame({"_ms": times[:n], ticker: [key[0]] * n} | made)
            seen += len(rows) - len(rows[max(len(rows) - back, 0) :])
            tail, last = rows[max(len(rows) - back, 0) :], int(times[n - 1])
        times, waiting = times[n:], waiting[n:]
        if state.hasTimedOut and not n and not len(times):
            state.remove()
            return
        state.update((pickle.dumps((tail, times, waiting, seen, last)),))
        state.setTimeoutTimestamp(int(times[0]) + 1 if len(times) else max(passed, 0) + quiet)

    columns = ", ".join(f"`{name}` double" for name in plan)
    timed = bars.select(F.col(date).cast("timestamp").alias("_time"), F.col(ticker).alias(ticker), *(F.col(c).cast("double").alias(c) for c in inputs)).withWatermark("_time", late)
    numbered = timed.where(F.col(ticker).isNotNull() & F.col("_time").isNotNull()).withColumn("_ms", F.unix_millis("_time"))
    out = numbered.groupBy(ticker).applyInPandasWithState(step, f"_ms long, `{ticker}` {kind}, {columns}", STATE, "append", "EventTimeTimeout")
    time = F.timestamp_millis("_ms")
    missing = F.lit(None).cast("double")
    return out.select((time.cast("date") if dict(bars.dtypes)[date] == "date" else time).alias(date), ticker, *(F.nanvl(F.col(f"`{n}`"), missing).alias(n) for n in plan))
