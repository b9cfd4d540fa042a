"""One local session for all tests, and small panels."""

from __future__ import annotations

import math
import os
import random
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    out = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


@pytest.fixture(scope="session")
def walk(spark: SparkSession) -> DataFrame:
    """20 tickers on 160 business days: random walks in 4 sectors of two industries each."""
    rng, rows = random.Random(0), []
    days = [d for d in (date(2023, 1, 2) + timedelta(days=i) for i in range(230)) if d.weekday() < 5][:160]
    for i in range(20):
        level = 0.0
        for d in days:
            level += rng.gauss(0, 0.015)
            close = 100 * math.exp(level)
            open_ = close * (1 + rng.gauss(0, 0.002))
            rows.append((d, f"T{i:02d}", open_, max(open_, close) * 1.005, min(open_, close) * 0.995, close, rng.uniform(1e6, 5e6), 0.0, 0.0, f"sector_{i % 4}", f"industry_{i % 4}_{i // 4 % 2}", 1e9))
    columns = "date date, ticker string, open double, high double, low double, close double, volume double, dividends double, splits double, sector string, industry string, shares_outstanding double"
    return spark.createDataFrame(rows, columns).cache()
