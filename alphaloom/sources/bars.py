"""The bar store: Parquet in hashed buckets of tickers, with the ranges it covers; loading of fields from it."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable
from datetime import date, timedelta

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import Universe, as_day
from ..fields import FIELDS, KEYS, STATIC, with_dependencies
from ..plans.expr import Expr, Field
from .files import commit, manifests, newest, tidy
from .panels import cleaned, ordered, universe_mask, with_derived

#: Bars for a table of requests: ticker, start, end.
Download = Callable[[DataFrame], DataFrame]
#: A list of tickers, or a table with a column ticker.
Tickers = list[str] | DataFrame
COVERAGE = "ticker string, first date, last date, write string, bucket int"


class BarStore:
    """Bars under ``path``/bars in ``buckets`` folders by the ticker's hash, sorted by ticker and date, and the ranges that are covered.

    Coverage is a table of ranges of dates, disjoint for a ticker, each with the write that it came with; rows of bars count only
    within a range of their write. So bars are only ever added, what a killed write leaves is never read, and a later
    write replaces what it covers without rewriting files; ``compact`` does that. A manifest names the valid coverage table.

    ``download(requests)`` gives bars for missing ranges (ticker, start, end); without it, or offline, a missing range is an error.
    Up to ``cached`` requests for fields are kept, those used last, and answer requests that they cover.
    """

    def __init__(self, spark: SparkSession, path: str, download: Download | None = None, *, buckets: int = 64, cached: int = 8) -> None:
        self.spark, self.path, self.download, self.cached = spark, path.rstrip("/"), download, cached
        self.buckets = (newest(spark, self.path) or {"buckets": buckets})["buckets"]
        self._cache: OrderedDict[int, tuple[frozenset | DataFrame, date, date, frozenset, DataFrame]] = OrderedDict()
        self._requests = 0

    # ---- what is there

    def _names(self, tickers: Tickers) -> DataFrame:
        rows = tickers.select(F.col("ticker").cast("string").alias("ticker")) if isinstance(tickers, DataFrame) else self.spark.createDataFrame([(t,) for t in tickers], "ticker string")
        return rows.distinct()

    def coverage(self) -> DataFrame:
        """ticker, first, last, write, bucket: disjoint ranges of a ticker."""
        now = newest(self.spark, self.path)
        if now is None or now.get("coverage") is None:
            return self.spark.createDataFrame([], COVERAGE)
        return self.spark.read.schema(COVERAGE).parquet(f"{self.path}/{now['coverage']}")

    def missing(self, tickers: Tickers, start: date, end: date) -> DataFrame:
        """ticker, start, end: the ranges within start to end that are not covered."""
        names = self._names(tickers)
        day = timedelta(days=1)
        # a covered day before and after the request, so that every gap lies between two ranges
        edges = names.select("ticker", F.explode(F.array(*(F.struct(F.lit(d).alias("first"), F.lit(d).alias("last")) for d in (start - day, end + day)))).alias("e")).select("ticker", "e.*")
        held = self.coverage().where((F.col("last") >= F.lit(start)) & (F.col("first") <= F.lit(end))).select("ticker", "first", "last").join(names, "ticker", "left_semi")
        before = Window.partitionBy("ticker").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
        gaps = edges.unionByName(held).withColumn("reached", F.max("last").over(before)).where(F.col("first") > F.date_add("reached", 1))
        return gaps.select("ticker", F.date_add("reached", 1).alias("start"), F.date_sub("first", 1).alias("end"))

    # ---- writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("ticker"), F.lit(self.buckets)).cast("int")

    def write_bars(self, bars: DataFrame, start: date, end: date) -> None:
        """Adds bars that cover start to end for each of their tickers, instead of what was there."""
        names = bars.select(F.col("ticker").cast("string").alias("ticker")).distinct()
        self._add(bars, names.select("ticker", F.lit(start).alias("first"), F.lit(end).alias("last")))

    def _add(self, bars: DataFrame, ranges: DataFrame, downloaded: bool = False) -> None:
        version, now = len(manifests(self.spark, self.path)), newest(self.spark, self.path) or {}
        write = uuid.uuid4().hex
        rows = cleaned(bars).withColumn("ticker", F.col("ticker").cast("string")).withColumns({"write": F.lit(write), "bucket": self._bucket()})
        # kept, since ranges are found by a look at the rows first: a download runs once
        rows = rows.persist(StorageLevel.DISK_ONLY) if downloaded else rows
        # by range, so that files follow the bytes and neither tickers nor the number of buckets
        try:
            rows.repartitionByRange("bucket", "ticker", "date").sortWithinPartitions("bucket", "ticker", "date").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/bars")
        finally:
            if downloaded:
                rows.unpersist()
        known = StructType.fromJson(now["schema"]) if "schema" in now else StructType()
        schema = StructType(list(known.fields) + [f for f in rows.schema.fields if f.name not in known.fieldNames()])
        # the download is not run again for the tickers that came
        came = self.spark.read.schema(schema).parquet(f"{self.path}/bars").where(F.col("write") == write).select("ticker").distinct()
        if downloaded and came.isEmpty():
            raise ValueError("nothing was downloaded for " + ", ".join(r["ticker"] for r in ranges.limit(10).collect()))
        new = ranges.join(came, "ticker", "left_semi").select("ticker", "first", "last", F.lit(write).alias("write"), self._bucket().alias("bucket"))
        taken = new.groupBy("ticker").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
        self._cover(self.coverage().join(taken, "ticker", "left").transform(_without_cuts).unionByName(new), schema, version)

    def _cover(self, coverage: DataFrame, schema: StructType, version: int) -> None:
        table = f"coverage-{uuid.uuid4().hex}"
        coverage.select("ticker", "first", "last", "write", "bucket").write.parquet(f"{self.path}/{table}")
        commit(self.spark, self.path, {"buckets": self.buckets, "coverage": table, "schema": schema.jsonValue()}, after=version)

    def compact(self) -> None:
        """Writes all valid bars once more as one write, with touching ranges merged. Call ``tidy`` when nothing reads the old ones."""
        version, now = len(manifests(self.spark, self.path)), newest(self.spark, self.path)
        if now is None:
            return
        write, ranges = uuid.uuid4().hex, self.coverage()
        order = Window.partitionBy("ticker").orderBy("first")
        starts = ranges.withColumn("new", F.coalesce(F.col("first") > F.date_add(F.lag("last").over(order), 1), F.lit(True)).cast("int"))
        merged = starts.withColumn("run", F.sum("new").over(order)).groupBy("ticker", "bucket", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        rows = self._live(ranges).withColumn("write", F.lit(write))
        rows.repartitionByRange("bucket", "ticker", "date").sortWithinPartitions("bucket", "ticker", "date").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/bars")
        self._cover(merged.withColumn("write", F.lit(write)), StructType.fromJson(now["schema"]), version)

    def tidy(self) -> None:
        """Removes old manifests and coverage tables."""
        if now := newest(self.spark, self.path):
            tidy(self.spark, self.path, {now["coverage"]}, "coverage-|manifest-")

    # ---- reading

    def _live(self, ranges: DataFrame) -> DataFrame:
        """The bars within the given ranges of coverage, with write and bucket."""
        now = newest(self.spark, self.path)
        bars = self.spark.read.schema(StructType.fromJson(now["schema"])).parquet(f"{self.path}/bars")
        own = ranges.select("ticker", "write", "bucket", F.col("first").alias("_first"), F.col("last").alias("_last"))
        return bars.join(own, ["bucket", "write", "ticker"]).where(F.col("date").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")

    def load_bars(self, tickers: Tickers, start: date, end: date, offline: bool = False) -> DataFrame:
        """Bars of the tickers from start to end, both included. Missing ranges are downloaded; only the tickers' buckets are read."""
        names = self._names(tickers)
        gaps = self.missing(names, start, end)
        some = gaps.limit(10).collect()
        if some and (offline or self.download is None):
            raise FileNotFoundError("no bars for " + ", ".join(f"{r['ticker']} from {r['start']} to {r['end']}" for r in some) + ("..." if len(some) == 10 else ""))
        if some:
            self._add(self.download(gaps), gaps.select("ticker", F.col("start").alias("first"), F.col("end").alias("last")), downloaded=True)
        if newest(self.spark, self.path) is None:
            raise FileNotFoundError("no bars are stored")
        ranges = self.coverage().where((F.col("last") >= F.lit(start)) & (F.col("first") <= F.lit(end))).join(names, "ticker", "left_semi")
        out = self._live(ranges).where(F.col("date").between(F.lit(start), F.lit(end))).drop("write", "bucket")
        return out.select("date", "ticker", *[c for c in out.columns if c not in ("date", "ticker")])

    def write_static(self, static: DataFrame) -> None:
        """Adds sector, industry and shares of tickers; of a ticker's rows the last written counts."""
        static.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/static")

    def load_static(self, tickers: Tickers) -> DataFrame:
        """ticker and its static fields, one row a ticker."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/static")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                raise FileNotFoundError("no static fields are stored") from e
            raise
        last = rows.join(self._names(tickers), "ticker", "left_semi").groupBy("ticker").agg(F.max_by(F.struct(*STATIC), "at").alias("s"))
        return last.select("ticker", "s.*")

    # ---- fields

    def clear_cache(self) -> None:
        while self._cache:
            self._cache.popitem()[1][-1].unpersist()

    def _answered(self, tickers: Tickers, start: date, end: date, wanted: set[str]) -> DataFrame | None:
        """From a kept request for all of these tickers, dates and columns, which then is the one used last."""
        for key in reversed(self._cache):
            have, first, last, columns, df = self._cache[key]
            if not (first <= start and end <= last and wanted <= columns):
                continue
            if isinstance(tickers, DataFrame) or isinstance(have, DataFrame):
                if not (isinstance(tickers, DataFrame) and isinstance(have, DataFrame) and have.sameSemantics(tickers)):
                    continue
            elif not set(tickers) <= have:
                continue
            self._cache.move_to_end(key)
            rows = df.where(F.col("date").between(F.lit(start), F.lit(end)))
            return rows if isinstance(tickers, DataFrame) or set(tickers) == have else rows.join(self._names(tickers), "ticker", "left_semi")
        return None

    def load_variables(self, variables: object, *, tickers: Tickers, start: date, end: date, offline: bool = False, cache: bool = True) -> DataFrame:
        """date, ticker and the requested fields, derived ones built; static fields are joined only if some are asked for."""
        names = requested_names(variables)
        wanted = [*KEYS, *(n for n in names if n not in KEYS)]
        if (kept := self._answered(tickers, start, end, set(wanted))) is not None:
            return kept.select(*wanted)
        bars = self.load_bars(tickers, start, end, offline)
        if set(with_dependencies([n for n in names if n in FIELDS])) & set(STATIC):
            bars = bars.join(self.load_static(tickers), "ticker", "left")
        out = with_derived(bars, [n for n in names if n in FIELDS])
        out = out.select(*[c for c in ordered(out, names) if c in wanted])
        if cache and self.cached:
            out = out.cache()
            self._requests += 1
            self._cache[self._requests] = (tickers if isinstance(tickers, DataFrame) else frozenset(tickers), start, end, frozenset(out.columns), out)
            while len(self._cache) > self.cached:
                self._cache.popitem(last=False)[1][-1].unpersist()
        return out

    def benchmark_closes(self, tickers: list[str], start: date, end: date, offline: bool = False) -> DataFrame:
        """One row a date, one close a ticker."""
        return self.load_bars(tickers, start, end, offline).groupBy("date").pivot("ticker", tickers).agg(F.first("close"))

    def build_data(self, alpha, *, tickers: Tickers, start: date, end: date, group: str | None = None, universe: int | Universe | None = None, offline: bool = False) -> DataFrame:
        """All that an alpha's formulas, its group and the simulation need."""
        names = [n for n in dict.fromkeys([*alpha.fields, "close", "returns", *([group] if group else []), *(["adv20"] if universe else [])]) if n != "in_universe"]
        out = self.load_variables(names, tickers=tickers, start=start, end=end, offline=offline)
        return universe_mask(out, universe) if universe else out


def _without_cuts(coverage: DataFrame) -> DataFrame:
    """Ranges less those in ``cuts`` (an array, or null), each cut leaving up to two pieces of a range."""
    piece = lambda first, last: F.struct(first.alias("first"), last.alias("last"))

    def less(pieces: Column, cut: Column) -> Column:
        sides = F.flatten(F.transform(pieces, lambda p: F.array(
            piece(p["first"], F.least(p["last"], F.date_sub(cut["first"], 1))), piece(F.greatest(p["first"], F.date_add(cut["last"], 1)), p["last"]))))
        return F.filter(sides, lambda p: p["first"] <= p["last"])

    left = F.aggregate(F.coalesce("cuts", F.array().cast("array<struct<first:date,last:date>>")), F.array(piece(F.col("first"), F.col("last"))), less)
    return coverage.select("ticker", "write", "bucket", F.explode(left).alias("p")).select("ticker", "p.first", "p.last", "write", "bucket")


def build_signals_from_data(store: BarStore, universe: Tickers, variables: object = None, start: object = None, end: object = None, *, neutralization_groups: bool = True, offline: bool = False) -> DataFrame:
    """The panel of any catalogue fields for a list of tickers, with their sectors unless told otherwise: what formulas can be tried on."""
    names = requested_names([] if variables is None else variables)
    names += ["sector"] if neutralization_groups and "sector" not in names else []
    return store.load_variables(names, tickers=universe if isinstance(universe, DataFrame) else get_tickers(universe), start=as_day(start), end=as_day(end), offline=offline)


def requested_names(variables: object) -> list[str]:
    """Field names of a request: a name, a formula, or a list of them."""
    if isinstance(variables, str):
        return [variables]
    if isinstance(variables, Field):
        return [variables.name]
    if isinstance(variables, Expr):
        return sorted(variables.fields)
    if isinstance(variables, (list, tuple, set)):
        return list(dict.fromkeys(n for v in variables for n in requested_names(v)))
    raise TypeError(f"a {type(variables).__name__} is no request for fields")


def get_tickers(universe: list[str] | Universe) -> list[str]:
    """The list itself without repeats; a named universe has no list of its own here."""
    if isinstance(universe, Universe):
        raise ValueError("a named universe is a mask over a panel: give the tickers, then use universe_mask")
    return list(dict.fromkeys(universe))
