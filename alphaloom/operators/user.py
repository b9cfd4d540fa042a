"""Users' own functions as operators of the formula language.

``rolling_function`` takes a function of windows along a ticker, ``row_function`` one of rows. They run in Arrow batches. A
ticker's rows stream through in date order and only the last rows that the next window needs are carried from one batch to the
next, so no ticker is ever whole in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.rolling import windows
from .library import REGISTRY, ROW, TICKER, Operator, Scope, no_nan, num


@dataclass(frozen=True)
class FrameOperator(Operator):
    """An operator that makes a column of a whole table, for what no Column can express."""

    def apply(self, df: DataFrame, scope: Scope, name: str, *args: Any) -> DataFrame:
        """df with the column ``name``: the function of windows of the first argument, as long as the second says."""
        x, n = args
        function, n = self.build, int(n)
        named = df.withColumn(name, no_nan(num(x)))
        where = {c: i for i, c in enumerate(named.columns)}
        key, value = where.get(scope.ticker), where[name]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current: Any = None
            carried = np.zeros(0)
            for batch in batches:
                x = batch.column(value).to_numpy(zero_copy_only=False).astype(float)
                keys = batch.column(key).to_pylist() if key is not None else [0] * len(x)
                edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                out = np.full(len(x), np.nan)
                for a, b in zip(edges, edges[1:], strict=False):
                    if keys[a] is None:
                        continue
                    if keys[a] != current:
                        current, carried = keys[a], np.zeros(0)
                    rows = np.concatenate([carried, x[a:b]])
                    out[a:b] = function(windows(rows, n, len(carried)))
                    carried = rows[max(len(rows) - n + 1, 0) :]
                columns = [pa.array(out, from_pandas=True) if i == value else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

        schema = StructType([StructField(name, DoubleType()) if f.name == name else f for f in named.schema.fields])
        dealt = named.repartition(scope.ticker).sortWithinPartitions(scope.ticker, scope.date) if key is not None else named.coalesce(1).sortWithinPartitions(scope.date)
        return dealt.mapInArrow(run, schema)


def rolling_function(function: Callable[[np.ndarray], np.ndarray], *, name: str | None = None) -> Operator:
    """Registers ``name(x, n)``: function gets an array with a row of n values for each of some rows of a ticker, the latest last and NaN where one is missing, and gives a value a row, NaN for none."""
    made = FrameOperator(name or function.__name__, TICKER, function)
    REGISTRY[made.name] = made
    return made


def row_function(function: Callable[..., np.ndarray], *, name: str | None = None) -> Operator:
    """Registers ``name(x, ...)``: function gets an array for each argument, of any rows of a table, NaN where a value is missing, and gives a value a row, NaN for none."""
    # as text, a module's annotations say nothing to Spark
    def batches(*columns):
        import pandas as pd

        return pd.Series(np.asarray(function(*(c.to_numpy(dtype=float, na_value=np.nan) for c in columns)), dtype=float))

    import pandas as pd

    def made_of(n: int):
        # Spark reads the kind of function from the types of its arguments
        wrapped = {1: lambda a: batches(a), 2: lambda a, b: batches(a, b), 3: lambda a, b, c: batches(a, b, c)}[n]
        wrapped.__annotations__ = {k: pd.Series for k in wrapped.__code__.co_varnames[:n]} | {"return": pd.Series}
        return F.pandas_udf(wrapped, "double")

    def build(_: Scope, *args: Any) -> Column:
        return no_nan(made_of(len(args))(*map(num, args)))

    made = Operator(name or function.__name__, ROW, build)
    REGISTRY[made.name] = made
    return made
