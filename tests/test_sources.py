"""Scene text round trips, pipe sizes, and readers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pipegrid.functions import scalars as S
from pipegrid.operators import boxes as B
from pipegrid.operators import grid as G
from pipegrid.sources import scene_text as T
from pipegrid.sources.tables import jdbc_options, poc_tasks


def box(**more):
    return {"min_x": 0.1, "min_y": 0.0001, "min_z": 1e-05, "max_x": 1e16, "max_y": 1e15, "max_z": 9999999999999998.0, "ost_type": "OST_Floors", "name": "", "object_id": None, "ddworks_type": None} | more


def scene():
    task = dict.fromkeys(("sx", "sy", "sz", "gx", "gy", "gz"), -0.0) | {"utility": "PA", "utility_group": None, "start_name": "가", "end_name": "//x", "end_instance_guid": ""}
    done = T.Result(True, 2850.0, 3850.0, 2, 22856, 2.5e-10, [(0, 0, 0), (1, 0, 0)], [(0, 0, 0)])
    return T.Scene(50.0, (-125.5, 33.0, 7.25), (20, 20, 20), {"w_tier": {3: 12.5, 1: 250.0}}, [box(), box(name=None)], [task, task], [done, T.Result(False, 0.0, 0.0, 0, 0, 0.0)])


def test_round_trip():
    text = T.dumps(scene())
    again = T.loads(text)
    assert T.dumps(again) == text
    assert again.obstacles[0]["name"] == "" and again.obstacles[1]["name"] is None and again.obstacles[0]["ddworks_type"] is None
    assert "1e+16" in text and "1e-05" in text and "-0.0" in text and again.results[1].path is None


def test_bad_scenes():
    with pytest.raises(ValueError):
        T.loads("@version 2\n")
    with pytest.raises(ValueError):
        T.loads("@version 1\n[grid]\n")
    with pytest.raises(IndexError):
        T.loads("[grid]\ncell_mm\t50.0\n[result]\ttask=3\nsuccess\t1\n")


def test_read_and_write(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.scene.txt").write_text(T.dumps(scene()), encoding="utf-8")
    got = T.read_scenes(spark, str(tmp_path))
    assert {k: v.count() for k, v in got.items()} == {"grid": 2, "obstacles": 4, "tasks": 4, "results": 4}
    assert got["results"].where("success and size(path) = 2").count() == 2
    boxes = spark.createDataFrame([(0, "b", None, *([1.0] * 3), *([2.0] * 3))], "scene_id int, object_id string, name string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    tasks = spark.createDataFrame([(0, 5, *([1.0] * 6), "u")], "scene_id int, task_id long, sx double, sy double, sz double, gx double, gy double, gz double, utility string")
    made = T.loads(T.write_scenes(boxes, tasks, 100.0, (4, 4, 4)).first()["text"])
    assert made.obstacles[0]["object_id"] == "b" and made.obstacles[0]["name"] is None and made.tasks[0]["utility"] == "u"


def test_pipe_sizes(spark):
    want = {"40A": 40, "150A": 150, "1/2B": 12.7, "1B": 25.4, "1/4B": 6.35, "3/8B": 9.525, "1-1/4B": 31.75, "1/4BX1/2B": 6.35, "65": 65, "": 0, "junk": 0, "1/0B": 0, "x": 0}
    rows = spark.createDataFrame([(k,) for k in [*want, None]], "s string").select("s", S.pipe_size_mm(F.col("s")).alias("mm")).collect()
    assert {r["s"]: r["mm"] for r in rows} == pytest.approx(want | {None: 0})


def test_grid_fixtures(spark):
    names = "scene_id int, object_id string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    one = spark.createDataFrame([(0, "a", 100.0, 100.0, 100.0, 300.0, 300.0, 300.0), (0, "b", 300.0, 300.0, 300.0, 300.0, 400.0, 400.0), (0, "c", -500.0, -500.0, -500.0, 400.0, 400.0, 400.0)], names)
    assert G.voxelize(one.where("object_id = 'a'"), (10, 10, 10), 100.0).count() == 8
    assert G.voxelize(one.where("object_id = 'b'"), (10, 10, 10), 100.0).count() == 0
    assert {r["object_id"]: r["newly"] for r in G.newly_blocked(one, (10, 10, 10), 100.0).collect()} == {"a": 8, "c": 56}
    cell = spark.createDataFrame([(0, 5, 5, 5)], "scene_id int, i int, j int, k int")
    corner = spark.createDataFrame([(0, 0, 0, 0)], "scene_id int, i int, j int, k int")
    assert [G.inflate(cell, r, c, (10, 10, 10)).count() for r, c in ((1, 6), (1, 26), (2, 6))] == [7, 27, 25]
    assert G.inflate(corner, 1, 6, (10, 10, 10)).count() == 4
    assert B.box_pairs(one, one, "object_id", 150.0, on=("scene_id",)).where("left_id < right_id").count() == 3
    for bad in ((0, 1, 1), (1000, 1000, 1000)):
        with pytest.raises(ValueError):
            G.check_grid(bad, 50.0)


def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("PGHOST", "db")
    assert jdbc_options(database="x")["url"] == "jdbc:postgresql://db:5432/x" and jdbc_options(host="h")["url"].startswith("jdbc:postgresql://h")
    assert jdbc_options()["password"] == ""


def test_poc_json(spark):
    rows = [(1, 0, '[{"name":"p","isConnected":true,"size":"40A","endPocs":[{"endName":"e","isConnected":true},{"endName":"f"}]},{"name":"q"}]'), (2, 0, "not json"), (3, 0, None)]
    got = poc_tasks(spark.createDataFrame(rows, "eq_id int, scene_id int, poc_list string")).collect()
    assert [(r["eq_id"], r["end_name"], r["sx"], r["label"]) for r in got] == [(1, "e", 0.0, "[?] ?")]
