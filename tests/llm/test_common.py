import zlib
from types import SimpleNamespace

from pyspark.sql import functions as F

import pytest

from seriesmill.llm.common import drop_scratch, held_out, output_path, scratch_made, shared_dir, stored


def test_tables_go_to_the_shared_folder_and_away(spark):
    drop_scratch(spark)
    df = stored(spark.range(5), "some")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0].replace("file://", "")
    assert drop_scratch(spark) == 1 and drop_scratch(spark) == 0


def test_held_out_rows_follow_the_checksum_of_the_id(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.sql("SELECT cast(null AS long) AS id").select(held_out(F.col("id")).alias("out")).first().out is False


def test_some_scratch_may_stay(spark):
    drop_scratch(spark)
    first = stored(spark.range(3), "first")
    mark = len(scratch_made())
    stored(spark.range(4), "second")
    third = stored(spark.range(5), "third")
    assert output_path(spark, "x") != output_path(spark, "x")
    assert drop_scratch(spark, scratch_made(mark)[:-1]) == 1 and (first.count(), third.count()) == (3, 5)
    assert drop_scratch(spark) == 2


def test_a_cluster_without_a_shared_folder_is_refused():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_dir(cluster)
