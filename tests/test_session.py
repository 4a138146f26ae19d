from types import SimpleNamespace

import pytest

from vecloom.session import materialise, scratch_root, take_bounded


def session(master, setting=None):
    chosen = []
    context = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: chosen[-1] if chosen else None,
        setCheckpointDir=chosen.append,
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: setting), sparkContext=context)


def test_scratch_folder_comes_from_the_session():
    assert scratch_root(session("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"
    local = session("local[2]")
    assert scratch_root(local) == scratch_root(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(session("spark://host:7077"))


def test_materialised_stage_reads_files(spark):
    kept = materialise(spark.range(10), "test")
    assert kept.count() == 10
    assert "FileScan parquet" in kept._jdf.queryExecution().toString()


def test_size_checks(spark):
    frame = spark.range(5)
    assert take_bounded(frame, 5).num_rows == 5 and take_bounded(frame, 4) is None
