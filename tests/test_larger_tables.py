"""Queries over tables that are larger than the given ones, or hold what only larger ones do."""

from __future__ import annotations

import pathlib
import uuid
from datetime import date, datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from alphaloom.plans import weights as w
from alphaloom.plans.expr import parse
from alphaloom.plans.lower import evaluate
from alphaloom.sources import provider
from alphaloom.sources.bars import BarStore
from alphaloom.sources.panels import cells_to_long
from alphaloom.store_queries import ORACLES, QUERIES, provided

TABLES = ("lineitem", "supplier", "nation", "region")


def beside_sql(spark, folder, name: str, items: list[tuple], suppliers: int) -> tuple[list, list]:
    """A query's rows and those of its SQL, over line items (supplier, day, quantity, price)."""
    tables = {
        "lineitem": spark.createDataFrame([(s, datetime.fromisoformat(d), float(q), float(p), 0.0) for s, d, q, p in items], "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double, l_tax double"),
        "supplier": spark.createDataFrame([(i, i % 2, 1.0) for i in range(suppliers)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "nation": spark.createDataFrame([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
    }
    con = duckdb.connect()
    for t in TABLES:
        tables[t].write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    return sorted(map(tuple, got.collect()), key=str), sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall(), key=str)


def test_finite_ratios_are_not_clipped(spark, tmp_path):
    items = [(0, "1995-12-26", 50, 1000.0), (0, "1996-01-02", 1, 100000.0), (0, "1996-01-09", 1, 90000.0), (0, "1996-01-16", 1, 95000.0), (1, "1995-12-26", 1, 1000.0), (1, "1996-01-02", 1, 900.0)]
    got, want = beside_sql(spark, tmp_path, "expr_divide", items, 2)
    assert got == want and {r[2] for r in got} == {None, 4999.5, -1000.0, 1000.0, 0.4}


@pytest.mark.parametrize(("cap", "total"), [(lambda df: w.truncate_gross(df, 0.05), 1.0), (lambda df: w.truncate_neutral(df, 0.05, ["date"]), 2.0)], ids=["gross", "neutral"])
def test_a_cap_sums_a_group_once(spark, cap, total):
    """No frame from a row to the group's end, which is summed anew for each row: n * n / 2 additions."""
    names = spark.range(20_000).select(F.lit(date(2024, 1, 1)).alias("date"), F.col("id").alias("ticker"), (F.when(F.col("id") < 40, 1.0 + F.col("id") ** 3) * F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).alias("weights"))
    held = cap(names.fillna(0.0))
    assert "currentrow$(), unboundedfollowing$()" not in held._jdf.queryExecution().executedPlan().toString()
    sides = held.agg(*(F.sum(F.when(test, F.abs("weights"))) for test in (F.col("weights") > 0, F.col("weights") < 0)), F.max(F.abs("weights")), F.count_if(F.col("weights") != 0)).first()
    assert sides[2] == pytest.approx(0.05) and sides[3] == 40 and sides[0] + sides[1] == pytest.approx(total)


def test_a_group_is_sorted_once_for_all_that_one_order_gives(spark):
    names = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), t, "ab"[t % 2], [None, 3.0, 1.0, 3.0, 0.0, -0.0, float("nan")][(t + i) % 7]) for i in range(3) for t in range(9)], "date date, ticker long, sector string, signal double")
    sorts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Sort [")
    ranked = evaluate(names, {"r": parse("rank(signal)")})
    assert sorts(ranked) == 1 and [r.r for r in ranked.where("date = '2024-01-01'").orderBy("ticker").collect()] == [None, 0.8, 0.4, 0.8, 0.1, 0.1, None, None, 0.8]
    assert sorts(w.truncate_gross(names.withColumnRenamed("signal", "weights"), 0.05)) == 2
    decayed = lambda df: w.compute_weights(df, neutralization="sector", decay=2)
    assert decayed(names).count() == 27 and sorts(decayed(names)) == 4
    for twice in (names.union(names.limit(1)), names.union(names.limit(1).withColumn("signal", F.lit(7.0))), names.unionByName(names.limit(2).withColumns({"date": F.lit(None).cast("date"), "ticker": F.lit(1).cast("long")}))):
        with pytest.raises(Exception, match="more than one row for|USER_RAISED_EXCEPTION"):
            decayed(twice).collect()


def test_wide_rows_need_no_column_a_ticker(spark, tmp_path):
    items = [(i, f"1995-12-{25 + i % 3 * 2}", 1 + i % 9, 1000.0 + i) for i in range(2500)]
    got, want = beside_sql(spark, tmp_path, "wide_to_long", items, 2500)
    assert got == want and len(got) == 2500
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        plan = QUERIES["wide_to_long"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(plan) < 20_000


def test_cells_become_bars(spark):
    rows = [("2024-01-02 00:00:00", {"A_Close": 1.0, "A_B_Open": 7.0, "C_Close": float("nan"), "A_Adj": 3.0}), ("2024-01-02 00:00:00", {"A_Open": 2.0, "A_B_Close": 4.0}), ("2024-01-03 00:00:00", {"A_Close": None, "A_Open": 1.0}), ("2024-01-04 00:00:00", None)]
    wide = spark.createDataFrame(rows, "date string, cells map<string, double>")
    long = cells_to_long(wide, {"Close": "close", "Open": "open"})
    assert sorted(map(tuple, long.select("date", "ticker", "close", "open").collect())) == [(date(2024, 1, 2), "A", 1.0, 2.0), (date(2024, 1, 2), "A_B", 4.0, 7.0)]
    for wrong, message in (("A_Close", "more than one value for A on 2024-01-02"), ("Close", "a column without a ticker: Close")):
        more = wide.union(spark.createDataFrame([("2024-01-02", {wrong: 5.0})], wide.schema))
        with pytest.raises(Exception, match=message):
            cells_to_long(more, {"Close": "close"}).collect()


@pytest.mark.parametrize("name", ["saved_figures", "run_headline"])
def test_figures_of_a_run_without_pnl_are_null(spark, tmp_path, name):
    """A universe of copies of one name has no neutral weights, so there is no Sharpe."""
    items = [(s, str(date(1995, 1, 2) + timedelta(days=7 * i)), 1 + i % 3, 1000.0 + 10 * i) for i in range(30) for s in (0, 2)]
    got, want = beside_sql(spark, tmp_path, name, items, 4)
    figures = {k.lower(): v for k, v in got}
    assert got == want and figures["sharpe"] is None and figures["total pnl" if name == "saved_figures" else "pnl"] == 0


def test_a_download_runs_once(spark, tmp_path):
    """Ranges are found by a look at the rows: the calls were made for that look and again for the rows."""

    class Counted:
        """A bar a ticker; each call leaves a file with what it was asked for."""

        def __init__(self, path):
            self.path = path

        def fetch(self, tickers, start, end):
            (pathlib.Path(self.path) / uuid.uuid4().hex).write_text(",".join(tickers))
            return pa.table({"date": [start] * len(tickers), "ticker": tickers, "close": [float(t[1:]) for t in tickers]})

    (tmp_path / "calls").mkdir()
    store = BarStore(spark, str(tmp_path / "bars"), provider.from_provider(Counted(str(tmp_path / "calls"))), buckets=2)
    names = spark.range(2500).select(F.format_string("N%04d", "id").alias("ticker"))
    got = store.load_bars(names, date(2024, 1, 1), date(2024, 1, 5))
    assert got.count() == 2500 and got.agg(F.sum("close")).first()[0] == 2500 * 2499 / 2
    asked = [f.read_text().split(",") for f in (tmp_path / "calls").iterdir()]
    assert max(map(len, asked)) <= 100 and sorted(t for a in asked for t in a) == [f"N{i:04d}" for i in range(2500)]


def test_a_provider_reads_where_its_tickers_are(spark, tmp_path):
    """Files in the order of tickers, so a call does not read the whole folder."""
    items = [(i * 7 % 500, f"{1993 + i % 3 * 2}-03-11", 1 + i % 9, 1000.0 + i) for i in range(1500)]
    got, want = beside_sql(spark, tmp_path, "store_download", items, 500)
    assert got == want and len(got) == 1500
    path, names = provided(spark, str(tmp_path))
    files = [pq.read_table(f, columns=["ticker"])["ticker"].to_pylist() for f in sorted(pathlib.Path(path.removeprefix("file:")).glob("*.parquet"))]
    assert sum(files, []) == sorted(f"{t:06d}" for t in range(500) for _ in range(3)) and names.count() == 500


def test_a_provider_sees_new_files(spark, tmp_path):
    rows = lambda t: pa.table({"date": [date(2024, 1, 2)] * 2, "ticker": [t, None], "close": [1.0, 2.0]})
    one = provider.ParquetProvider(f"file:{tmp_path}")
    fetch = lambda tickers: one.fetch(tickers, date(2024, 1, 1), date(2024, 1, 3)).num_rows
    pq.write_table(rows("A"), tmp_path / "a.parquet")
    assert fetch(["A", "B"]) == 1 and fetch([]) == 0 and fetch(["A", None]) == 2
    pq.write_table(rows("B"), tmp_path / "b.parquet")
    assert fetch(["A", "B"]) == 2 and provider.ParquetProvider(f"{tmp_path}/b.parquet").fetch(["B"], date(2024, 1, 1), date(2024, 1, 3)).num_rows == 1
