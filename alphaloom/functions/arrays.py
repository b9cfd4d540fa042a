"""Means of arrays held in a column: tables within a row, as rows of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(values: Column) -> Column:
    """Of all values; missing if one is, or if there is none."""
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda total, v: total + v.cast("double")) / n)


def cs_mean(value: Column, *, row: int | None = None, start: int | None = None, end: int | None = None, axis: str = "row", dimensions: int = 2) -> Column:
    """The mean of an array of numbers, or of an array of ``dimensions`` 2 the means of its rows from ``start`` to before ``end``, or that of one ``row``.

    With the axis ``column`` its columns are taken as rows. Places count from 0, and from the end if they are below 0.
    """
    if axis not in ("row", "column"):
        raise ValueError("the axis is row or column")
    if dimensions == 1:
        return _mean(value)
    if axis == "column":
        width = F.coalesce(F.size(F.try_element_at(value, F.lit(1))), F.lit(0))
        places = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
        value = F.transform(places, lambda i: F.transform(value, lambda r: F.try_element_at(r, i)))
    n = F.size(value)
    if row is not None:
        return _mean(F.try_element_at(value, F.lit(row + 1 if row >= 0 else row)))
    place = lambda p, default: default if p is None else F.least(F.lit(p), n) if p >= 0 else F.greatest(n + p, F.lit(0))
    first, last = place(start, F.lit(0)), place(end, n)
    return F.transform(F.slice(value, first + 1, F.greatest(last - first, F.lit(0))), _mean)
