from __future__ import annotations

from types import SimpleNamespace

import pytest

from slotwise.session import build_session, delete_path, path_exists, shared_dir, work_path


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    path = work_path(spark, "x")
    assert path.startswith("file:" + shared_dir(spark)) and path_exists(spark, path)
    assert path != work_path(spark, "x")
    assert delete_path(spark, path) and not path_exists(spark, path)


def fake(master):
    known = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: known[-1] if known else None,
                              setCheckpointDir=known.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("yarn"))
    local = fake("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.sparkContext.getCheckpointDir()


def test_sessions_are_utc(spark):
    with pytest.raises(ValueError, match="UTC"):
        build_session("other", spark__sql__session__timeZone="Europe/Berlin")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
