import os

import pytest

from factloom import shared


def test_tables_belong_to_the_application_and_can_be_released(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    df = shared.written(spark.range(10).toDF("n"), "numbers")
    assert df.count() == 10 and shared.shared_dir(spark) == base
    (path,) = {os.path.dirname(f)[7:] if f.startswith("file://") else f for f in df.inputFiles()}
    assert path.lstrip("/").startswith(f"{base}/factloom/{spark.sparkContext.applicationId}/numbers-".lstrip("/"))
    assert len(shared.entries(spark, os.path.dirname(path))) >= 1
    shared.release(spark)
    assert not os.path.exists(path)


def test_unfinished_folders_are_no_entries(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "a"))
    os.makedirs(tmp_path / "b")
    assert [os.path.basename(e) for e in shared.entries(spark, str(tmp_path))] == ["a"] and shared.entries(spark, str(tmp_path / "none")) == []


def test_without_a_shared_folder_a_cluster_is_refused():
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Unset())


def test_bounded_rows_raise_beyond_their_bound(spark):
    assert len(shared.bounded_rows(spark.range(3), 3, "rows")) == 3
    with pytest.raises(ValueError, match="more than 2"):
        shared.bounded_rows(spark.range(3), 2, "rows")
