"""Series from tables: time buckets, a spine without gaps, positions, wide and packed
forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import WrongType

UNITS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}


def finite(y: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    y = y.cast("double")
    return F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)


def bucket(df: DataFrame, ts: str, unit: str, aggregates: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """One row for each key and bucket of time that has rows; ``ts`` is its start."""
    by = by or []
    start = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("ts")
    return df.groupBy(*by, start).agg(*[a.alias(n) for n, a in aggregates.items()])


def on_spine(series: DataFrame, unit: str, by: list[str] | None = None, fill: dict[str, float] | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The series with a row for every bucket from its first to its last (or between
    ``start`` and ``end``); new rows are null or have ``fill``'s values."""
    by = by or []
    values = [c for c in series.columns if c not in (*by, "ts")]
    ends = series.groupBy(*by).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    every = F.explode(F.sequence(F.col("lo") if start is None else start, F.col("hi") if end is None else end, F.expr(UNITS[unit])))
    spine = ends.select(*[F.col(k).alias(f"__{k}") for k in by], every.alias("__ts"))
    on = F.col("__ts") == F.col("ts")
    for k in by:
        on = on & F.col(f"__{k}").eqNullSafe(F.col(k))
    out = spine.join(series, on, "left").select(*[F.col(f"__{k}").alias(k) for k in (*by, "ts")], *values)
    return out.fillna(fill) if fill else out


def indexed(series: DataFrame, by: list[str], ts: str) -> DataFrame:
    """With ``t``, the position from 0 within the key, by time."""
    return series.withColumn("t", (F.row_number().over(Window.partitionBy(*by).orderBy(ts)) - 1).cast("long"))


def pack(df: DataFrame, by: list[str], ts: str, values: list[str]) -> DataFrame:
    """One row a key: ``n`` and the values as arrays in order of ``ts``; null is NaN. Two
    rows of one key and time are an error, as position is time."""
    row = F.struct(F.col(ts).alias("ts"), *[F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(f"v{k}") for k, v in enumerate(values)])
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows")) if by else df.agg(F.sort_array(F.collect_list(row)).alias("rows"))
    times = F.transform("rows", lambda r: r["ts"])
    clash = F.size(F.array_distinct(times)) < F.size(times)
    rows = rows.withColumn("rows", F.when(clash, F.raise_error(F.lit("two rows of a series have the same time"))).otherwise(F.col("rows")))
    return rows.select(*by, F.size("rows").alias("n"), times.alias("ts"), *[F.transform("rows", _field(f"v{k}")).alias(v) for k, v in enumerate(values)])


def _field(name: str):
    return lambda r: r[name]


def to_long(wide: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """(series, ts, y) of a wide frame; every column has to be DOUBLE."""
    kinds = dict(wide.dtypes)
    for c in columns:
        if kinds.get(c) != "double":
            raise WrongType(f"column {c} is {kinds.get(c)}, not double")
    return wide.unpivot([ts], columns, "series", "y").withColumnRenamed(ts, "ts")


def to_wide(long: DataFrame, ts: str, columns: list[str], value: str) -> DataFrame:
    return long.groupBy(F.col("ts").alias(ts)).pivot("series", columns).agg(F.first(value))
