"""Portfolio weights: neutralize, normalize, decay, cap.

The cap redistributes what it cuts among the names below it. Done name by name that is a
loop; sorted by size it is closed: with v the sizes of a side in falling order, T the side's
total and c the cap, the i-th name is at the cap if v_i (T - (i - 1) c) exceeds c times the
sum of v from i on. Once false that stays false, so the capped names are counted and the others
share what is left in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Neutralization, number
from ..operators.library import REGISTRY, Scope, finite, num

def unique_keys(df: DataFrame, value: str, along: bool = False) -> DataFrame:
    """df, which fails when it is run if two rows have one (date, ticker). ``along``: by a look at the ticker's row before, for rows that are sorted so."""
    if along:
        time = Scope().time()
        twice = (F.row_number().over(time) > 1) & F.col("date").eqNullSafe(F.lag("date").over(time))
    else:
        twice = F.count(F.lit(1)).over(Window.partitionBy("date", "ticker")) > 1
    message = F.concat(F.lit("more than one row for "), F.col("ticker").cast("string"), F.lit(" on "), F.col("date").cast("string"))
    return df.withColumn(value, F.when(twice, F.raise_error(message).cast(df.schema[value].dataType)).otherwise(F.col(f"`{value}`")))


def group_neutralize(df: DataFrame, neutralization: Neutralization, signal: str = "signal", out: str = "weights", noise: float = 0.0) -> DataFrame:
    """signal less its mean over the finite signals of its date and group; 0 where it is missing or has no group.

    Differences of up to ``noise`` of a signal (or of 1) count as zero: equal signals can leave rounding noise, which
    normalize would blow up to whole weights.
    """
    neutralization = Neutralization(neutralization)
    x = num(F.col(signal))
    if neutralization is Neutralization.NONE:
        return df.withColumn(out, F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0)))
    if missing := [k for k in neutralization.keys if k not in df.columns]:
        raise ValueError(f"neutralization by {neutralization.value} needs {missing}")
    v = F.when(finite(x), x)
    grouped = F.col(neutralization.field).isNotNull() if neutralization.field else F.lit(True)
    value = v - F.avg(v).over(Window.partitionBy(*neutralization.keys))
    value = F.when(grouped & (F.abs(value) > noise * F.greatest(F.lit(1.0), F.abs(v))) if noise else grouped, value)
    return df.withColumn(out, F.coalesce(value, F.lit(0.0)))


def normalize(df: DataFrame, weight: str = "weights") -> DataFrame:
    """Weights over their date's sum of sizes; 0 where that is 0."""
    gross = F.sum(F.abs(F.col(weight))).over(Window.partitionBy("date"))
    return df.withColumn(weight, F.coalesce(F.when(gross != 0, F.col(weight) / gross), F.lit(0.0)))


def apply_decay(df: DataFrame, n: int, weight: str = "weights") -> DataFrame:
    """Linear decay of each ticker's weights over n rows; 0 rows: as they are."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError("decay is a number of rows, 0 or more")
    return df.withColumn(weight, REGISTRY["linear_decay"].build(Scope(), F.col(weight), n)) if n else df


def capped(v: Column, total: Column, cap: float, by: list[Column]) -> Column:
    """v (0 or more, 0 for names not on the side) scaled to total, none above cap: see the module's text."""
    # places and sums are those in falling order, taken in rising order: a frame that runs to the group's end would be summed anew for each row
    # all names are counted in the same order, so a group is sorted once
    order = Window.partitionBy(*by).orderBy(v, F.desc("ticker"))
    up, every = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, rest = F.count(F.lit(1)).over(every) - F.count(F.lit(1)).over(up) + 1, F.sum(v).over(up)
    over = (v > 0) & (v * (total - (i - 1) * cap) > F.lit(cap) * rest * (1 + 1e-12))
    return F.struct(i.alias("i"), over.alias("over"), v.alias("v"))


def _fill(df: DataFrame, v: str, total: str, cap: float, keys: list[str], out: str) -> DataFrame:
    """df with ``out``: column v capped within keys to the total in a column."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_c", capped(F.col(v), F.col(total), cap, [F.col(k) for k in keys]))
    df = df.withColumn("_k", F.sum(F.col("_c.over").cast("int")).over(w))
    below = F.sum(F.when(F.col("_c.i") > F.col("_k"), F.col(v)).otherwise(0.0)).over(w)
    df = df.withColumn("_r", below)
    free = F.greatest(F.col(total) - F.col("_k") * cap, F.lit(0.0))
    value = F.when(F.col(v) <= 0, 0.0).when(F.col("_c.i") <= F.col("_k"), F.lit(cap)).when(F.col("_r") > 0, free * F.col(v) / F.col("_r")).otherwise(0.0)
    return df.withColumn(out, value).drop("_c", "_k", "_r")


def truncate_neutral(df: DataFrame, cap: float, keys: list[str], weight: str = "weights") -> DataFrame:
    """Long and short sides of each group brought to one size that the cap allows, none above the cap.

    Rows without a group have no weight. Without keys, weights are clipped to the cap.
    """
    cap = number(cap)
    if not keys:
        return df.withColumn(weight, F.least(F.greatest(F.col(weight), F.lit(-cap)), F.lit(cap)))
    w = Window.partitionBy(*keys)
    has_group = F.lit(True)
    for k in keys:
        has_group = has_group & F.col(k).isNotNull()
    x = F.when(has_group, F.col(weight)).otherwise(0.0)
    # a name is on one side: both sides are filled in one pass, each as a group of its own
    df = df.withColumns({"_size": F.abs(x), "_side": F.signum(x)})
    side = lambda s, c: F.sum(F.when(F.col("_side") == s, c).otherwise(0.0)).over(w)
    size, one = F.col("_size"), F.lit(cap)
    df = df.withColumn("_total", F.least(side(1, size), side(-1, size), side(1, one), side(-1, one)))
    df = _fill(df, "_size", "_total", cap, [*keys, "_side"], "_new")
    return df.withColumn(weight, F.col("_side") * F.col("_new")).drop("_size", "_side", "_total", "_new")


def truncate_gross(df: DataFrame, cap: float, weight: str = "weights") -> DataFrame:
    """Weights of a date with a name above the cap are brought to a gross of min(1, names x cap), none above the cap, signs kept.

    Dates within the cap stay as they are.
    """
    cap = number(cap)
    w = Window.partitionBy("date")
    df = df.withColumn("_size", F.abs(F.col(weight)))
    df = df.withColumns({"_top": F.max("_size").over(w), "_total": F.least(F.lit(1.0), F.sum((F.col("_size") > 0).cast("double")).over(w) * cap)})
    df = _fill(df, "_size", "_total", cap, ["date"], "_new")
    return df.withColumn(weight, F.when(F.col("_top") > cap, F.signum(F.col(weight)) * F.col("_new")).otherwise(F.col(weight))).drop("_size", "_top", "_total", "_new")


def compute_weights(
    df: DataFrame, *, neutralization: Neutralization = Neutralization.NONE, decay: int = 0, truncation: float = 0.0, signal: str = "signal", check_keys: bool = True, noise: float = 0.0
) -> DataFrame:
    """df with ``weights``: neutral, normalized, decayed (then neutral and normalized again), capped; ``noise`` as in group_neutralize.

    One lazy plan: that keys are unique is checked while it runs.
    """
    neutralization = Neutralization(neutralization)
    check_keys = check_keys and neutralization is not Neutralization.NONE
    if check_keys and not decay:
        df = unique_keys(df, signal)
    out = normalize(group_neutralize(df, neutralization, signal, noise=noise))
    if decay:
        # dealt by date, rows serve all windows from here on: those of a date and those of its groups
        out = apply_decay(out, decay)
        out = unique_keys(out, "weights", along=True) if check_keys else out
        out = normalize(group_neutralize(out.repartition("date"), neutralization, "weights", noise=noise))
    if number(truncation) > 0:
        out = truncate_gross(out, truncation) if neutralization is Neutralization.NONE else truncate_neutral(out, truncation, neutralization.keys)
    return out
