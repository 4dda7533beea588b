"""Scratch tables: where they lie, and that none is left."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tapeline import scratch


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


def _session(master, checkpoint_dir=None, **conf):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint_dir, _jsc=None)
    return SimpleNamespace(conf=_Conf(conf), sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1000]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(_session(master))


def test_the_folder_named_by_the_session_or_context_is_used():
    assert scratch.shared_dir(_session("yarn", **{"spark.checkpoint.dir": "hdfs://x/a/"})).startswith("hdfs://x/a/tapeline-")
    assert scratch.shared_dir(_session("yarn", "hdfs://x/b")).startswith("hdfs://x/b/tapeline-")


def test_tables_are_removed(spark):
    with scratch.Scratch(spark, "t") as held:
        one = held.cut(spark.range(5))
        two = held.cut(spark.range(3).selectExpr("id as k", "1 as one"), "k")
        assert one.count() == 5 and sorted(r.k for r in two.collect()) == [0, 1, 2]
        paths = [p for _, p in held._paths.values()]
        assert all(scratch.exists(spark, p) for p in paths)
        held.drop_all(but=(two,))
        assert [scratch.exists(spark, p) for p in paths] == [False, True]
    assert not any(scratch.exists(spark, p) for p in paths)
