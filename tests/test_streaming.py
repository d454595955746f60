import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.kernels import holt
from seriesmill.params import HoltWintersOptions
from seriesmill.streaming import smoothing

from .generators import seasonal


def streamed(spark, tmp_path, parts, schema, make):
    """Feeds the parts as micro-batches, one file each, and returns what came out."""
    source = tmp_path / "in"
    for k, rows in enumerate(parts):
        before = set(source.glob("*.parquet")) if source.exists() else set()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        for f in set(source.glob("*.parquet")) - before:  # files come in order of their times
            os.utime(f, (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"out_{abs(hash(str(tmp_path))) % 10**8}"
    query = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


@pytest.mark.parametrize("o", [HoltWintersOptions(0.4), HoltWintersOptions(0.3, 0.1, 0.2, 4)])
def test_stream_equals_the_batch(spark, tmp_path, o):
    a, b = seasonal(40, 4, 1), seasonal(30, 4, 2)
    rows = [("a", t, float(v)) for t, v in enumerate(a)] + [("b", t, float(v)) for t, v in enumerate(b)]
    parts = [[r for r in rows if low <= r[1] < high] for low, high in ((0, 5), (5, 20), (20, 40))]
    got = streamed(spark, tmp_path, parts, "k string, ts long, y double", lambda s: smoothing.holt_winters_stream(s, "k", "ts", "y", o))
    for key, y in (("a", a), ("b", b)):
        mine = sorted((r.ts, r.fitted) for r in got if r.k == key)
        assert np.allclose([f for _, f in mine], holt.run(y[None], o)["fitted"][0])


def test_late_and_missing_values(spark, tmp_path):
    parts = [[("a", 0, 1.0), ("a", 2, 3.0)], [("a", 1, 99.0), ("a", 3, None), ("a", 4, 5.0)]]
    got = streamed(spark, tmp_path, parts, "k string, ts long, y double", lambda s: smoothing.holt_winters_stream(s, "k", "ts", "y", HoltWintersOptions(0.5)))
    by = {r.ts: r for r in got}
    assert by[1].fitted is None and by[4].late == 1
    assert [by[t].fitted for t in (0, 2, 3, 4)] == [1, 1, 2, 2]


def test_windows_close_after_the_watermark(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (1, 2, 12, 13, 14)]
    parts = [rows[:3], rows[3:], [("a", "2024-01-01 02:00:00", 1.0)], [("a", "2024-01-01 02:01:00", 1.0)], [("a", "2024-01-01 00:03:00", 1.0)]]
    make = lambda s: smoothing.windowed(s.withColumn("at", F.to_timestamp("at")), "at", "10 minutes", "5 minutes", ["k"], {"n": F.count("*")})
    got = streamed(spark, tmp_path, parts, "k string, at string, v double", make)
    assert sorted((r.ts.minute, r.n) for r in got) == [(0, 2), (10, 3)]
