"""Gap filling, classical decomposition (Catalyst windows) and STL (kernel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grouped import by_length, exploded
from ..kernels import stl as kernel
from ..params import DecomposeOptions, StlOptions
from ..sources.series import finite, indexed, to_long, to_wide

UNBOUNDED = (Window.unboundedPreceding, Window.unboundedFollowing)


def interpolate_missing(df: DataFrame, by: list[str], ts: str, y: str, out: str = "filled") -> DataFrame:
    """Null, NaN and infinite values on the line between their neighbours in position;
    before the first and after the last value, the nearest one. A series without any
    value stays null."""
    rows = indexed(df, by, ts)
    own = Window.partitionBy(*by).orderBy("t")
    back, ahead = own.rowsBetween(UNBOUNDED[0], 0), own.rowsBetween(0, UNBOUNDED[1])
    f = finite(F.col(y))
    at = F.when(f.isNotNull(), F.col("t"))
    rows = rows.withColumns({"__y0": F.last(f, True).over(back), "__t0": F.last(at, True).over(back), "__y1": F.first(f, True).over(ahead), "__t1": F.first(at, True).over(ahead)})
    line = F.col("__y0") + (F.col("__y1") - F.col("__y0")) * F.try_divide((F.col("t") - F.col("__t0")).cast("double"), (F.col("__t1") - F.col("__t0")).cast("double"))
    value = F.when(f.isNotNull(), f).when(F.col("__y0").isNull(), F.col("__y1")).when(F.col("__y1").isNull(), F.col("__y0")).otherwise(line)
    return rows.withColumn(out, value).drop("__y0", "__t0", "__y1", "__t1")


def centred_average(y: Column, n_rows: Column, own, period: int) -> Column:
    """Mean over one period around each row, null where the window leaves the series; an
    even period takes half of either end."""
    h = period // 2
    whole = F.sum(y).over(own.rowsBetween(-h, h))
    full = F.count(F.lit(1)).over(own.rowsBetween(-h, h)) == 2 * h + 1
    if period % 2:
        return F.when(full, whole / period)
    return F.when(full, (whole + F.sum(y).over(own.rowsBetween(-(h - 1), h - 1))) / (2 * period))


def seasonal_decompose(df: DataFrame, by: list[str], ts: str, y: str, options: DecomposeOptions, on_error: str = "raise") -> DataFrame:
    """by, ts, t, y, trend, seasonal, residual. Null at the ends of trend and residual,
    and in the residual of values that were filled.

    A series that is too short, has missing values without ``missing="interpolate"``, or
    values not above 0 in the multiplicative mode, raises, or is all null with a text in
    ``error``.
    """
    p, times = options.period, options.mode == "multiplicative"
    rows = df.select(*by, F.col(ts).alias("ts"), F.col(y).cast("double").alias("y"))
    own = Window.partitionBy(*by).orderBy("t")
    whole = Window.partitionBy(*by)
    if options.missing == "interpolate":
        rows = interpolate_missing(rows, by, "ts", "y", "x")
    else:
        rows = indexed(rows, by, "ts").withColumn("x", finite(F.col("y")))
    gaps = F.count(F.when(F.col("x").isNull(), 1)).over(whole)
    problem = F.when(F.count(F.lit(1)).over(whole) < 2 * p, f"SeriesTooShort: at least {2 * p} values are needed").when(gaps > 0, "NonFinite: the series has missing or infinite values")
    if times:
        problem = problem.when(F.min("x").over(whole) <= 0, "NonPositive: multiplicative decomposition needs values above 0")
    rows = rows.withColumn("error", problem)
    if on_error == "raise":
        rows = rows.withColumn("x", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("double")).otherwise(F.col("x")))
    else:
        rows = rows.withColumn("x", F.when(F.col("error").isNull(), F.col("x")))
    rows = rows.withColumn("trend", centred_average(F.col("x"), F.lit(None), own, p))
    rows = rows.withColumn("phase", F.pmod("t", F.lit(p)))
    rest = F.try_divide(F.col("x"), F.col("trend")) if times else F.col("x") - F.col("trend")
    rows = rows.withColumn("rest", rest)
    mean = F.coalesce(F.avg("rest").over(Window.partitionBy(*by, "phase")), F.lit(1.0 if times else 0.0))
    rows = rows.withColumn("pattern", F.when(F.col("x").isNotNull(), mean))
    # the pattern's own mean: each phase once (every phase has one of the first p rows)
    centre = F.avg(F.when(F.col("t") < p, F.col("pattern"))).over(whole)
    seasonal = F.try_divide(F.col("pattern"), centre) if times else F.col("pattern") - centre
    rows = rows.withColumn("seasonal", seasonal)
    residual = F.try_divide(F.col("x"), F.col("trend") * F.col("seasonal")) if times else F.col("x") - F.col("trend") - F.col("seasonal")
    residual = F.when(finite(F.col("y")).isNotNull(), residual)
    extra = ["error"] if on_error == "null" else []
    return rows.select(*by, "ts", "t", "y", "trend", "seasonal", residual.alias("residual"), *extra)


def stl(df: DataFrame, by: list[str], ts: str, y: str, options: StlOptions, on_error: str = "raise") -> DataFrame:
    """by, ts, t, y, trend, seasonal, residual (NaN residuals where y was missing)."""

    def run(series):
        trend, seasonal, residual = kernel.stl_rows(series, options)
        return {"y": series, "trend": trend, "seasonal": seasonal, "residual": residual}

    schema = "y array<double>, trend array<double>, seasonal array<double>, residual array<double>"
    rows = by_length(df.select(*by, ts, F.col(y).alias("y")), by, ts, ["y"], lambda s: {"ok": kernel.prepare(s, options) is not None}, run, schema, on_error)
    return exploded(rows, by, ["y", "trend", "seasonal", "residual"])


def _batch(wide: DataFrame, ts: str, columns: list[str], op) -> dict[str, DataFrame]:
    long = op(to_long(wide, ts, columns))
    return {part: to_wide(long, ts, columns, part) for part in ("trend", "seasonal", "residual")}


def stl_batch(wide: DataFrame, ts: str, columns: list[str], options: StlOptions) -> dict[str, DataFrame]:
    """A frame for each component, with a column for each of ``columns``."""
    return _batch(wide, ts, columns, lambda long: stl(long, ["series"], "ts", "y", options))


def seasonal_decompose_batch(wide: DataFrame, ts: str, columns: list[str], options: DecomposeOptions) -> dict[str, DataFrame]:
    return _batch(wide, ts, columns, lambda long: seasonal_decompose(long, ["series"], "ts", "y", options))
