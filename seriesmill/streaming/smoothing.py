"""Exponential smoothing of unbounded series: the recursion's state lives in the stream's
state store, one small row a key, and each micro-batch moves it on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels import holt
from ..kernels.numbers import interpolate
from ..params import HoltWintersOptions

STATE = "started boolean, level double, trend double, season array<double>, phase int, held_ts array<long>, held_y array<double>, last long, late long"


def windowed(events: DataFrame, ts: str, width: str, lateness: str, by: list[str], aggregates: dict) -> DataFrame:
    """Tumbling windows of a stream of events: rows of by, ts (the window's start) and the
    aggregates, final once the watermark has passed; later events are dropped."""
    grouped = events.withWatermark(ts, lateness).groupBy(F.window(ts, width), *by)
    return grouped.agg(*[a.alias(n) for n, a in aggregates.items()]).select(*by, F.col("window.start").alias("ts"), *aggregates)


def holt_winters_stream(df: DataFrame, key: str, ts: str, y: str, options: HoltWintersOptions) -> DataFrame:
    """key, ts, y, fitted, late for a streaming ``df`` whose ``ts`` is a long position in
    time (as a batch frame it works too).

    ``fitted`` is the forecast made before ``y`` was seen. Rows of a micro-batch go by
    time; a value not after the key's last one is late: it comes out with a null forecast
    and changes nothing, and ``late`` counts such rows so far. Missing values come out
    with their forecast and leave the state as if they had been forecast exactly. The
    first values (two periods with a season, two with a trend) are held until the state
    can start.
    """
    o = options
    need = 2 * o.period if o.has_season else 2 if o.has_trend else 1
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *T._parse_datatype_string("ts long, y double, fitted double, late long").fields])

    def run(name, batches, state: GroupState):
        if state.exists:
            started, level, trend, season, phase, held_ts, held_y, last, late = state.get
            held_ts, held_y = list(held_ts), list(held_y)
            season = np.array([season], float)
        else:
            started, level, trend, season, phase, held_ts, held_y, last, late = False, 0.0, 0.0, np.zeros((1, 0)), 0, [], [], -(2**62), 0
        pdf = pd.concat(list(batches)).sort_values(ts, kind="stable")
        rows = []

        def move(at, value):
            nonlocal level, trend, phase
            if not np.isfinite(value):
                base = level + trend
                s = season[0, phase] if o.has_season else 0.0
                told = (base + s if o.mode == "additive" else base * s) if o.has_season else base
                level = base
            else:
                told, new, slope = holt.step(np.array([value]), np.array([level]), np.array([trend]), season, phase, o)
                told, level, trend = float(told[0]), float(new[0]), float(slope[0])
            phase = (phase + 1) % (o.period if o.has_season else 1)
            rows.append((at, value, told))

        for at, value in zip(pdf[ts], pdf[y].astype(float)):
            at = int(at)
            if at <= last:
                late += 1
                rows.append((at, value, None))
                continue
            last = at
            if started:
                move(at, value)
                continue
            held_ts.append(at)
            held_y.append(value)
            if sum(map(np.isfinite, held_y)) >= need and len(held_y) >= need:
                seen = interpolate(np.array(held_y))
                holt.check(seen, o)
                first, slope, season = holt.start(seen[None, :], o)
                level, trend, started = float(first[0]), float(slope[0]), True
                for a, v in zip(held_ts, held_y):
                    move(a, v)
                held_ts, held_y = [], []
        state.update((started, level, trend, season[0].tolist(), phase, held_ts, held_y, last, late))
        yield pd.DataFrame({key: [name[0]] * len(rows), "ts": [r[0] for r in rows], "y": [r[1] for r in rows], "fitted": pd.array([r[2] for r in rows], dtype="Float64"), "late": [late] * len(rows)})

    return df.select(key, ts, y).groupBy(key).applyInPandasWithState(run, out, T._parse_datatype_string(STATE), "append", GroupStateTimeout.NoTimeout)
