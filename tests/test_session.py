import os
import types

import pytest

from folioscope.session import _MADE, discard, fresh_path, materialize, once, shared_dir


def test_written_frames_are_removed_on_demand(spark):
    df = materialize(spark.range(3), "numbers")
    assert df.count() == 3 and shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]
    folder = fresh_path(spark, "x").rpartition("/")[0].removeprefix("file://")
    assert os.listdir(folder)
    discard(spark)
    assert not os.path.exists(folder)


def test_once_follows_inputs_and_paths(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        spark.range(1).write.parquet(p := fresh_path(spark, "kept"))
        return p

    source = tmp_path / "in"
    source.write_text("a")
    first = once(spark, "n", [str(source)], make)
    assert once(spark, "n", [str(source)], make) == first and len(made) == 1
    source.write_text("ab")
    assert once(spark, "n", [str(source)], make) != first and len(made) == 2
    discard(spark)
    assert once(spark, "n", [str(source), "/no/such"], make) and len(made) == 3 and len(_MADE) == 1


def test_a_cluster_must_name_its_folder():
    conf = types.SimpleNamespace(get=lambda *a: None)
    session = types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)
    with pytest.raises(RuntimeError):
        shared_dir(session)
