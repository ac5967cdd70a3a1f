"""Where tables are put, names that clash with nothing, joins that split hot keys, hashes of windows."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framespan.llm import storage
from framespan.llm.rolling import windows_of
from framespan.llm.storage import Workspace, join_sized, shared_dir, unused


class _Cluster:
    """A session without a shared folder."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master = self, self, master

    def get(self, *_):
        return None

    def getConf(self):
        return self


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError):
        shared_dir(_Cluster(master))


def test_tables_are_dropped(spark):
    work = Workspace(spark, "test")
    a, b = work.write(spark.range(5), "a"), work.write(spark.range(7), "b")
    folder = work.path.removeprefix("file://")
    assert len(os.listdir(folder)) == 2
    work.drop(a)
    assert len(os.listdir(folder)) == 1 and b.count() == 7


def test_names():
    assert unused(["Score", "x"], "score", "tag", "tag") == ["score_", "tag", "tag_"]


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_joins_with_hot_keys(spark, monkeypatch, how, broadcast):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 1 << 20 if broadcast else 0)
    monkeypatch.setattr(storage, "HOT_ROWS", 50)
    left = spark.createDataFrame([(k if k % 3 else 0, k, "s") for k in range(900)], "k int, v int, salt string")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 900, 2)], "k int, r string")
    got = join_sized(left, right, ["k"], 20, how)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, ["k"], how).collect()))
    assert got.columns == left.join(right, ["k"], how).columns


def test_windows(spark):
    rows = [(None,), ([],), ([3, 1],), ([5, 5, 5, 5, 5, 5],), ([1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1],), (list(range(40)) + list(range(12)),)]
    df = spark.createDataFrame(rows, "x array<int>").select("x", F.transform("x", lambda v: F.xxhash64(v)).alias("hw"))
    for width in (1, 2, 3, 5, 8):
        seen = {}
        for r in df.select("x", windows_of("hw", width).alias("out")).collect():
            if r["x"] is None:
                assert r["out"] is None
                continue
            own = [tuple(r["x"][i : i + width]) for i in range(len(r["x"]) - width + 1)]
            assert len(r["out"]) == len(own)
            for w, h in zip(own, r["out"]):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
