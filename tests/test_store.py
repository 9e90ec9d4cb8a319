import os

import pytest
from pyspark.sql import functions as F

from lekhya.operators import store

POINT = "point_id string, vector array<float>, ord bigint"


def points(spark, rows):
    return spark.createDataFrame([(p, [float(v)], o) for p, v, o in rows], POINT)


def content(c):
    return {r.point_id: r.vector[0] for r in c.read().collect()}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    c = store.Collection(spark, str(tmp_path), "acts", buckets=4)
    assert c.info() == {"name": "acts", "points": 0, "status": "absent"}
    want = {f"p{i}": float(i) for i in range(20)}
    assert c.upsert(points(spark, [(f"p{i}", i, i) for i in range(20)])) == 20 and content(c) == want
    first = c._pointer(1)["paths"]
    assert c.upsert(points(spark, [("p3", 99, 1), ("p3", 100, 2), ("p3", 50, 0)])) == 20
    second = c._pointer(2)["paths"]
    assert sum(first[b] != second[b] for b in first) == 1 and content(c) == want | {"p3": 100.0}
    assert c.upsert(points(spark, [("new", 1, 1)])) == 21
    assert c.upsert(points(spark, []).limit(0)) == 21
    assert content(c) == want | {"p3": 100.0, "new": 1.0} and len(c._pointers()) == 2
    again = store.Collection(spark, str(tmp_path), "acts", buckets=9)  # the number of buckets stays
    assert again.upsert(points(spark, [("p3", 7, 1)])) == 21 and content(again)["p3"] == 7.0
    live = set(again._pointer(5)["paths"].values()) | set(again._pointer(4)["paths"].values())
    have = {f"{v}/{b}" for v in os.listdir(tmp_path / "acts") if v.startswith("v") for b in os.listdir(tmp_path / "acts" / v) if b.startswith("bucket")}
    assert have == live
    c.delete()
    c.delete()
    assert c.read() is None


def test_written_tables_can_be_removed(spark):
    from lekhya import io

    with io.written(spark.range(3)) as df:
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)
    kept = io.materialise(spark.range(2))
    assert f"/lekhya-{spark.sparkContext.applicationId}/" in kept.inputFiles()[0]
    io.remove(spark, io.written_folder(spark) + "/absent")


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from lekhya import io

    def session(master):
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None), conf=SimpleNamespace(get=lambda k, d: d))

    assert io.checkpoint_dir(session("local[4]"))
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError):
            io.checkpoint_dir(session(master))
    assert spark.range(3).select(F.sum("id")).collect()[0][0] == 3
