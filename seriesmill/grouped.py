"""Runs numpy kernels on packed series: one shuffle by key, then Arrow batches of whole
series. A kernel gets lists of equally long series where it can use that."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DataError, OptionError
from .sources.series import pack


def _check(on_error: str) -> None:
    if on_error not in ("raise", "null"):
        raise OptionError(f"on_error is {on_error!r}; it can be raise, null")


def by_series(df: DataFrame, by: list[str], ts: str, values: list[str], kernel, schema: str, on_error: str = "raise") -> DataFrame:
    """One row a key with what ``kernel(*arrays)`` returns: a dict by the names of
    ``schema``. With ``on_error="null"`` a series that fails has nulls and its error's
    text in ``error``; else the first failure fails the query."""

    def rows(batch: list[tuple[np.ndarray, ...]]):
        return [_attempt(kernel, arrays, on_error) for arrays in batch]

    return _run(df, by, ts, values, rows, schema, on_error)


def by_length(df: DataFrame, by: list[str], ts: str, values: list[str], prepare, kernel, schema: str, on_error: str = "raise") -> DataFrame:
    """As ``by_series``, with ``kernel(list of series)`` on series of one length that
    ``prepare`` (which checks one series) let pass; it returns a dict of matrices."""

    def rows(batch):
        out: list = [None] * len(batch)
        groups = defaultdict(list)
        for k, (y, *_) in enumerate(batch):
            found = _attempt(prepare, (y,), on_error)
            if isinstance(found, Exception):
                out[k] = found
            else:
                groups[len(y)].append(k)
        for members in groups.values():
            got = kernel([batch[k][0] for k in members])
            for i, k in enumerate(members):
                out[k] = {name: matrix[i] for name, matrix in got.items()}
        return out

    return _run(df, by, ts, values, rows, schema, on_error)


def _attempt(kernel, arrays, on_error):
    try:
        return kernel(*arrays)
    except (DataError, np.linalg.LinAlgError, FloatingPointError) as e:
        if on_error == "raise":
            raise
        return e


def _run(df: DataFrame, by, ts, values, rows, schema: str, on_error: str) -> DataFrame:
    _check(on_error)
    packed = pack(df, by, ts, values)
    fields = T._parse_datatype_string(schema).fields
    names = [f.name for f in fields]
    keys = [packed.schema[k] for k in (*by, "ts")]
    out_schema = T.StructType([*keys, *fields, T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            got = []
            for k in range(0, len(pdf), 64):
                part = pdf.iloc[k : k + 64]
                got += rows([tuple(np.array(part[v].iloc[i], float) for v in values) for i in range(len(part))])
            data = {f.name: pdf[f.name] for f in keys}
            for name in names:
                data[name] = pd.Series([None if isinstance(g, Exception) else _plain(g[name]) for g in got], index=pdf.index, dtype=object)
            data["error"] = pd.Series([f"{type(g).__name__}: {g}" if isinstance(g, Exception) else None for g in got], index=pdf.index, dtype=object)
            yield pd.DataFrame(data)

    result = packed.mapInPandas(run, out_schema)
    return result if on_error == "null" else result.drop("error")


def _plain(v):
    return v.tolist() if isinstance(v, np.ndarray) else v.item() if isinstance(v, np.generic) else v


def exploded(rows: DataFrame, by: list[str], arrays: list[str]) -> DataFrame:
    """One row a position: keys, ``ts``, ``t`` and the arrays' elements; of a series that
    failed, its times with nulls."""
    extra = ["error"] if "error" in rows.columns else []
    empty = F.transform("ts", lambda _: F.lit(None).cast("double"))
    filled = rows.withColumns({a: F.coalesce(F.col(a), empty) for a in arrays})
    zipped = F.arrays_zip(F.col("ts"), *[F.col(a) for a in arrays])
    out = filled.select(*by, *extra, F.posexplode(zipped).alias("t", "row"))
    return out.select(*by, F.col("row.ts").alias("ts"), F.col("t").cast("long").alias("t"), *[F.col(f"row.{a}").alias(a) for a in arrays], *extra)
