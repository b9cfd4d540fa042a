"""Aligned closes, attribution in one pass, users' functions and windows over streams, against plain Python and the batch operators."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from alphaloom import more_queries as mq
from alphaloom.functions import rolling
from alphaloom.functions.arrays import cs_mean
from alphaloom.operators.library import REGISTRY
from alphaloom.operators.user import rolling_function, row_function
from alphaloom.plans import attribution as at
from alphaloom.plans import simulate as sim
from alphaloom.plans.expr import parse
from alphaloom.plans.lower import evaluate
from alphaloom.queries import backtest
from alphaloom.streaming.stateful import stream_windows

D = date(2024, 1, 1)
day = lambda n: D + timedelta(days=n)


def test_aligned_closes(spark):
    closes = spark.createDataFrame([(day(0), "A", 10.0), (day(1), "A", 11.0), (day(3), "A", None), (day(4), "A", 12.0), (day(2), "B", 5.0), (day(9), "C", 1.0)], "date date, ticker string, close double")
    dates = spark.createDataFrame([(day(n),) for n in (0, 2, 3, 4, 4)], "date date")
    got = {(r["ticker"], (r["date"] - D).days): r["close"] for r in sim.aligned_closes(dates, closes).collect()}
    assert [got["A", n] for n in (0, 2, 3, 4)] == [10.0, 10.0, 10.0, 12.0] and [got["B", n] for n in (0, 2, 3, 4)] == [None, 5.0, 5.0, 5.0] and len(got) == 12
    asof = {(r["ticker"], (r["date"] - D).days): r["close"] for r in sim.aligned_closes(dates, closes, between=True).collect()}
    assert asof["A", 2] == 11.0 and asof["C", 4] is None
    pnl = {(r["ticker"], (r["date"] - D).days): r["cum_pnl"] for r in sim.aligned_pnl(dates, closes, 100.0).collect()}
    assert pnl["A", 4] == pytest.approx(20.0) and pnl["A", 0] == 0.0 and pnl["B", 4] is None
    wide = sim.benchmark_pnl(dates, closes, ["A", "B"], 100.0).collect()
    assert all(r[t] == pytest.approx(pnl[t, (r["date"] - D).days]) if r[t] is not None else pnl[t, (r["date"] - D).days] is None for r in wide for t in "AB")
    plan = sim.aligned_pnl(dates, closes, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("Exchange SinglePartition", "", 1) or plan.count("Exchange SinglePartition") <= 1
    assert sim.aligned_closes(dates.limit(0), closes).count() == 0 and sim.aligned_closes(dates, closes.limit(0)).count() == 0


def test_attribution_sets(spark, sf_dir):
    panel = backtest(spark, sf_dir).panel
    sets = at.attribution_sets(panel, horizon="monthly", book_size=1000.0, flat=1e-12)
    assert sets._jdf.queryExecution().executedPlan().toString().count("lineitem") <= 1 or sets.inputFiles()
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_extendedprice")
    assert scans(sets) == scans(at.attribution(panel, horizon="monthly", book_size=1000.0))
    panel = panel.cache()
    sets = at.attribution_sets(panel, horizon="monthly", book_size=1000.0, flat=1e-12)
    for kind in ("ticker", "sector", "side"):
        one = at.side_attribution(panel, horizon="monthly", book_size=1000.0, flat=1e-12) if kind == "side" else at.attribution(panel, horizon="monthly", groups=(kind,), book_size=1000.0, flat=1e-12)
        key = lambda r, c: (r["date"], str(r[c]))
        want = {key(r, kind): r for r in one.collect()}
        got = {key(r, "name"): r for r in sets.where(F.col("kind") == kind).collect()}
        assert want.keys() == got.keys()
        for k, r in want.items():
            assert got[k]["contribution_pnl"] == pytest.approx(r["contribution_pnl"]) and got[k]["observations"] == r["observations"] and got[k]["side"] == r["side"] and got[k]["period_pnl"] == pytest.approx(r["period_pnl"])
    panel.unpersist()
    with pytest.raises(ValueError):
        at.attribution_sets(panel, groups=("nothing",), book_size=1.0)


def test_users_windows_cross_batches(spark, walk):
    rows = walk.select("date", "ticker", "close").withColumn("close", F.when(F.dayofyear("date") % 11 != 0, F.col("close")))
    extra = rows.unionByName(rows.limit(3).withColumn("ticker", F.lit(None).cast("string")))
    seen = []

    def my_range(window):
        seen.append(window.shape)
        return np.where(np.isnan(window).any(axis=1), np.nan, window.max(axis=1) - window.min(axis=1))

    rolling_function(my_range)
    row_function(lambda a, b: a / b, name="my_ratio")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        want = evaluate(rows, {"v": parse("ts_max(close, 7) - ts_min(close, 7)")}).select("date", "ticker", "v").collect()
        for size in ("3", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r["date"], r["ticker"]): r["v"] for r in evaluate(extra, {"v": parse("my_range(close, 7)")}).collect() if r["ticker"]}
            assert len(got) == len(want) and all(got[r["date"], r["ticker"]] == pytest.approx(r["v"]) if r["v"] is not None else got[r["date"], r["ticker"]] is None for r in want)
        assert evaluate(extra, {"v": parse("my_range(close, 7)")}).where("ticker is null and v is not null").count() == 0
        r = evaluate(rows, {"v": parse("my_ratio(close, close * 2)")}).agg(F.min("v"), F.max("v"), F.count("v"), F.count("close")).first()
        assert r[0] == r[1] == 0.5 and r[2] == r[3]
        assert evaluate(rows.limit(0), {"v": parse("my_range(close, 7)")}).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        del REGISTRY["my_range"], REGISTRY["my_ratio"]


@pytest.mark.parametrize("text", list(mq.STREAMED.values()) + ["ts_mean(close, 1)", "ts_argmax(volume, 3)", "ts_correlation(close, close, 3)"])
def test_rolling_is_as_the_batch_operator(spark, walk, text, batch={}):  # noqa: B006
    """In one block, and in blocks with carried history."""
    if not batch:
        rng = np.random.default_rng(1)
        rows = [r.asDict() for r in walk.where("ticker = 'T01'").select("date", "ticker", "close", "volume").orderBy("date").limit(60).collect()]
        for r in rows:
            r["close"] = None if rng.random() < 0.05 else float("inf") if rng.random() < 0.03 else float(round(r["close"]))
        batch["rows"] = rows
        batch["df"] = spark.createDataFrame(rows, "date date, ticker string, close double, volume double").cache()
    e = parse(text)
    want = [r["v"] for r in evaluate(batch["df"], {"v": e}).orderBy("date").collect()]
    arrays = [np.array([np.nan if r[a.name] is None else r[a.name] for r in batch["rows"]]) for a in e.args[:-1]]
    n = int(e.args[-1].value)
    back = rolling.depth(e.name, n)
    for block in (60, 1, 7):
        got = []
        for at_ in range(0, 60, block):
            before = min(back, at_)
            got += rolling.rolling(e.name, [a[at_ - before : at_ + block] for a in arrays], n, before=before, seen=at_ - before).tolist()
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert np.isnan(g) if w is None else g == pytest.approx(w, abs=1e-3 if 'cov' in text else 1e-9), (text, block, g, w)


def streamed(spark, tmp_path, files, **options):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "date timestamp, ticker string, close double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("date timestamp, ticker string, close double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream_windows(stream, {"s": parse("ts_sum(close, 3)"), "d": parse("ts_delay(close, 1)")}, **options)
    query = out.writeStream.format("memory").queryName(f"w{abs(hash(str(tmp_path)))}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table(query.name).collect()
    return sorted(((r["date"].day, r["ticker"], r["s"], r["d"]) for r in got), key=str)


def test_streams_order_bars_and_drop_late_ones(spark, tmp_path):
    from datetime import datetime

    bar = lambda n, t, v: (datetime(2024, 1, n), t, float(v))
    files = [
        [bar(1, "A", 1), bar(3, "A", 3), bar(1, "B", 10)],
        [bar(2, "A", 2), bar(4, "A", 4), bar(6, "A", 6)],
        [bar(5, "A", 5), bar(2, "B", 20), bar(20, "A", 7)],  # B's is late, but B has given out nothing later
        [bar(18, "B", 30)],
        [bar(4, "A", 99), bar(6, "A", 99), bar(19, "B", 40)],  # A's bars up to the sixth are out
        [bar(30, "Z", 0)],
        [bar(31, "Z", 0)],
    ]
    got = streamed(spark, tmp_path, files, late="2 days")
    a = [(1, "A", None, None), (2, "A", None, 1.0), (3, "A", 6.0, 2.0), (4, "A", 9.0, 3.0), (5, "A", 12.0, 4.0), (6, "A", 15.0, 5.0), (20, "A", 18.0, 6.0)]
    assert [r for r in got if r[1] == "A"] == sorted(a, key=str)
    assert [r for r in got if r[1] == "B"] == [(1, "B", None, None), (18, "B", 60.0, 20.0), (19, "B", 90.0, 30.0), (2, "B", None, 10.0)]


def test_streams_forget_quiet_tickers(spark, tmp_path):
    from datetime import datetime

    bar = lambda n, t, v: (datetime(2024, 1, n), t, float(v))
    files = [[bar(1, "A", 1), bar(2, "A", 2)], [bar(8, "Z", 0)], [bar(15, "Z", 0)], [bar(16, "Z", 0)], [bar(16, "A", 3)], [bar(28, "Z", 0)], [bar(29, "Z", 0)]]
    got = streamed(spark, tmp_path, files, late="1 day", expire="3 days")
    assert [r for r in got if r[1] == "A"] == [(1, "A", None, None), (16, "A", None, None), (2, "A", None, 1.0)]


def test_streams_say_what_they_cannot(spark):
    bars = spark.createDataFrame([], "date date, ticker string, close double")
    for text in ("rank(close)", "ts_mean(close + 1, 5)", "ts_mean(close, 5) + 1", "hump(close, 5)"):
        with pytest.raises(ValueError, match="over a stream"):
            stream_windows(bars, {"v": parse(text)})


def test_means_of_arrays(spark):
    table = [[1.0, 2.0, 6.0], [3.0, 5.0, 7.0], [0.0, 0.0, 3.0]]
    df = spark.createDataFrame([(table, [1.0, 4.0]), ([[1.0, None]], []), ([], [None, 1.0])], "x array<array<double>>, v array<double>")
    x = np.array(table)
    for options in ({}, {"row": 1}, {"row": -1}, {"start": 1}, {"start": -2, "end": -1}, {"end": 9}, {"axis": "column"}, {"axis": "column", "row": 2}, {"start": 2, "end": 1}):
        a = x.T if options.get("axis") == "column" else x
        want = a[options["row"]].mean() if "row" in options else a[options.get("start") : options.get("end")].mean(axis=1).tolist()
        assert df.select(cs_mean(F.col("x"), **options).alias("m")).first()["m"] == pytest.approx(want), options
    got = df.select(cs_mean(F.col("v"), dimensions=1).alias("v"), cs_mean(F.col("x")).alias("rows"), cs_mean(F.col("x"), axis="column").alias("columns"), cs_mean(F.col("x"), row=0).alias("row")).collect()
    assert [tuple(r)[0] for r in got] == [2.5, None, None] and got[1]["rows"] == [None] and got[1]["columns"] == [1.0, None] and got[2]["columns"] == [] and got[2]["row"] is None
    with pytest.raises(ValueError, match="axis"):
        cs_mean(F.col("x"), axis="z")
