"""Bars from outside: a provider's answers as a Spark table, a call for every hundred tickers.

A provider is any object that pickles and has ``fetch(tickers, start, end)``, which gives a pyarrow table of date, ticker and
prices. ``ProviderSource`` reads a list of tickers (``spark.read.format("bars")``); ``from_provider`` answers a
table of requests, as the bar store has them, and never has the tickers in the driver.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import date
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "date date, ticker string, open double, high double, low double, close double, volume double, dividends double, splits double"
_ARROW = {"date": pa.date32(), "string": pa.string(), "double": pa.float64()}
CHUNK = 100


class Provider(Protocol):
    def fetch(self, tickers: list[str], start: date, end: date) -> pa.Table: ...


class ParquetProvider:
    """Bars of a folder of Parquet files that all executors can read.

    A call reads the row groups that can hold its tickers: few, where files are in the order of tickers (``in_order`` writes such), all otherwise.
    """

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file:")

    def fetch(self, tickers: list[str], start: date, end: date) -> pa.Table:
        own = pc.field("ticker").isin(pa.array(tickers, pa.string()))
        if tickers and None not in tickers:
            own &= (pc.field("ticker") >= min(tickers)) & (pc.field("ticker") <= max(tickers))
        # a task has one core
        return _dataset(self.path).to_table(filter=own & (pc.field("date") >= start) & (pc.field("date") <= end), use_threads=False)


_opened: dict[str, tuple[list, ds.Dataset]] = {}


def _dataset(path: str) -> ds.Dataset:
    """The files of a folder. The last one is kept in this process with their footers, until a file is another."""
    local = fs.LocalFileSystem()
    found = [local.get_file_info(path)]
    found += local.get_file_info(fs.FileSelector(path, recursive=True)) if found[0].type == fs.FileType.Directory else []
    files = sorted((f.path, f.size, f.mtime_ns) for f in found)
    if path not in _opened or _opened[path][0] != files:
        _opened.clear()
        _opened[path] = files, ds.dataset(path, format="parquet")
    return _opened[path][1]


def in_order(bars: DataFrame) -> DataFrameWriter:
    """A writer of bars for ``ParquetProvider``: in the order of tickers, in row groups of some hundred to a thousand tickers."""
    return bars.repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.option("parquet.block.size", 4 << 20)


def fetched(provider: Provider, tickers: list[str], start: date, end: date, *, retries: int = 3, wait: float = 1.0, some: bool = True) -> pa.Table:
    """The provider's bars in the order and types of SCHEMA. A failed call is made again ``retries`` times, each after twice the wait; no bars at all are an error if ``some`` are needed."""
    for left in range(retries, -1, -1):
        try:
            got = provider.fetch(tickers, start, end)
            break
        except Exception:
            if not left:
                raise
            time.sleep(wait)
            wait *= 2
    if some and not got.num_rows:
        raise ValueError(f"nothing came from {start} to {end} for {', '.join(tickers[:10])}{'...' if len(tickers) > 10 else ''}")
    fields = [f.split() for f in SCHEMA.split(", ")]
    return pa.table({n: got[n].cast(_ARROW[t]) if n in got.column_names else pa.nulls(got.num_rows, _ARROW[t]) for n, t in fields})


class Chunk(InputPartition):
    def __init__(self, tickers: list[str]) -> None:
        self.tickers = tickers


class ProviderSource(DataSource):
    """``spark.read.format("bars")`` with the options provider (module:class), args (a JSON list for it), tickers (a JSON list), start, end, retries and wait."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: Any) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        names = sorted(set(json.loads(self.options["tickers"])))
        return [Chunk(names[i : i + CHUNK]) for i in range(0, len(names), CHUNK)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        module, kind = self.options["provider"].split(":")
        provider = getattr(importlib.import_module(module), kind)(*json.loads(self.options.get("args", "[]")))
        day = lambda name: date.fromisoformat(self.options[name])
        yield from fetched(provider, partition.tickers, day("start"), day("end"), retries=int(self.options.get("retries", 3)), wait=float(self.options.get("wait", 1))).to_batches()


def from_provider(provider: Provider, *, retries: int = 3, wait: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A download for the bar store: bars for a table of requests (ticker, start, end); a task makes up to ten calls if there are many. Single tickers may have none; the store looks that any came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[str] = []
        span: tuple[date, date] | None = None
        for batch in batches:
            for ticker, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if asked and (span != (start, end) or len(asked) == CHUNK):
                    yield from fetched(provider, asked, *span, retries=retries, wait=wait, some=False).to_batches()
                    asked = []
                asked.append(ticker)
                span = (start, end)
        if asked:
            yield from fetched(provider, asked, *span, retries=retries, wait=wait, some=False).to_batches()

    def download(requests: DataFrame) -> DataFrame:
        calls = max(1, -(-requests.count() // CHUNK))
        parts = min(calls, max(calls // 10, 4 * requests.sparkSession.sparkContext.defaultParallelism))
        dealt = requests.select("ticker", "start", "end").repartitionByRange(parts, "start", "end", "ticker").sortWithinPartitions("start", "end", "ticker")
        return dealt.mapInArrow(run, SCHEMA)

    return download


def by_list(fetch: Callable[[list[str], date, date], DataFrame], chunk: int = CHUNK) -> Callable[[DataFrame], DataFrame]:
    """A download made of a function that the driver calls with lists of tickers: for universes that a list can hold."""

    def download(requests: DataFrame) -> DataFrame:
        spans: dict[tuple[date, date], list[str]] = {}
        for r in requests.orderBy("start", "end", "ticker").select("ticker", "start", "end").collect():
            spans.setdefault((r["start"], r["end"]), []).append(r["ticker"])
        out = None
        for (start, end), names in spans.items():
            for i in range(0, len(names), chunk):
                got = fetch(names[i : i + chunk], start, end)
                if got.isEmpty():
                    raise ValueError(f"nothing was downloaded for {', '.join(names[i : i + chunk])}")
                out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        return out.withColumn("ticker", F.col("ticker").cast("string"))

    return download
