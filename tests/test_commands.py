"""Scenes by program, the command line, sparse and world searches, traces and the detail table."""

from __future__ import annotations

import random

from pipegrid.operators import grid as G
from pipegrid.operators import routing as R
from pipegrid.sources import commands as C
from pipegrid.sources import reports
from pipegrid.sources import scene_text as ST


def test_demo(tmp_path, capsys):
    out = tmp_path / "demo.txt"
    assert C.main(["demo", "--out", str(out)]) == 0
    scene = ST.loads(out.read_text(encoding="utf-8"))
    assert [r.success for r in scene.results] == [True] * 5 and sum(r.length_mm for r in scene.results) == 28050
    assert C.main(["summary", "--in", str(out)]) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[1] == "5 of 5 routed, 28050 mm in all" and said[2].endswith("5 tasks, 5 of 5 routed")
    again = tmp_path / "single.txt"
    assert C.main(["route", "--in", str(out), "--out", str(again), "--mode", "single"]) == 0
    assert all(r.length_mm == 5450 for r in ST.loads(again.read_text(encoding="utf-8")).results)


def test_build_and_trace():
    scene = C.add_box(ST.Scene(100.0, shape=(9, 9, 1)), (0, 400, 0), (700, 500, 100), "OST_GenericModel", name="wall")
    C.add_box(scene, (0, 0, 0), (0, 100, 100))
    C.add_task(scene, (50, 50, 50), (50, 850, 50), utility="U", utility_group="G")
    assert int(C.occupancy(scene).blocked[1:-1, 1:-1, 1:-1].sum()) == 7
    done = C.route_scene(scene, "single", trace=True)
    (r,) = done.results
    assert r.success and len(r.visited) == r.expanded_nodes and r.visited[0] == (0, 0, 0) and r.visited[-1] == (0, 8, 0)
    assert C.route_summary(r).startswith(f"{len(r.path)} cells, {r.length_mm:.0f} mm long")
    assert ST.loads(ST.dumps(done)).results[0].visited == r.visited
    moved = C.move_task(done, 0, (850, 50, 50), (850, 850, 50))
    assert moved.results == [None] and C.route_scene(moved, "multi").results[0].length_mm == 800


def test_sparse_equals_dense():
    r = random.Random(7)
    for _ in range(40):
        shape = (r.randint(3, 12), r.randint(3, 12), r.randint(1, 5))
        blocked = {(r.randrange(shape[0]), r.randrange(shape[1]), r.randrange(shape[2])) for _ in range(r.randint(0, 60))}
        a, b = (tuple(r.randrange(n) for n in shape) for _ in range(2))
        seen = []
        dense, sparse = R.search(R.Grid(shape, list(blocked)), a, b, 50.0, trace=seen), R.search_sparse(shape, blocked, a, b, 50.0)
        assert (dense.success, dense.path, dense.length_mm, dense.turns, dense.expanded) == (sparse.success, sparse.path, sparse.length_mm, sparse.turns, sparse.expanded)
        assert a == b or a in blocked or b in blocked or len(seen) == dense.expanded
        fine, _ = R.route_tube(R.Grid(shape, list(blocked)), a, b, 50.0, 2, 1)
        assert R.route_tube_sparse(shape, blocked, a, b, 50.0, 2, 1)[0].path == fine.path
        world = R.search_world(R.Grid(shape, list(blocked)), [x * 50 + 7 for x in a], [x * 50 + 20 for x in b], 50.0)
        assert world.path == dense.path


def test_huge_grid():
    """160,000 cells a side: only the cells that are reached cost anything."""
    wall = {(80_000, j, k) for j in range(79_990, 80_011) for k in range(5)}
    got = R.search_sparse((160_000,) * 3, wall, (79_990, 80_000, 0), (80_010, 80_000, 0), 50.0)
    assert got.success and got.length_mm >= 20 * 50


def test_growth_equals_the_kernel(spark):
    shape, path = (9, 9, 3), [(4, j, 1) for j in range(1, 7)]
    blocked = [(5, j, 1) for j in range(9)] + [(3, 3, 1), (4, 4, 2)]
    for radius in (0, 1, 3):
        dense = R.Grid(shape, blocked)
        R.mark_pipe(dense, path, radius)
        rows = lambda cells: spark.createDataFrame([(0, *c) for c in cells], "scene_id int, i int, j int, k int")
        got = {tuple(x)[1:] for x in G.mark_pipe(rows(blocked), rows(path), radius, shape).collect()}
        assert got == {(i, j, k) for i in range(9) for j in range(9) for k in range(3) if dense.is_blocked((i, j, k))}
        corridor = {(2, 2, 1), (3, 4, 1)}
        got = {tuple(x)[1:] for x in G.add_corridor(rows(corridor), rows(path), radius, shape).collect()}
        R.add_corridor(R.Grid(shape), corridor, path, radius)
        assert got == corridor


def test_detail_table(spark, tmp_path):
    kinds = "guid string, group string, utility string, size string, straight_mm double, pr_len double, our_len double, pr_bend double, our_turns int, pr_eff double, our_eff double, ok boolean, fail string"
    made = [("a", "G", "U", "40A", 1000.0, 3000.0, 2000.4, 3.0, 2, 3.0, 2.0004, True, None), ("b", None, "U", None, 900.0, 0.0, 0.0, 1.0, 0, 1.5, 0.0, False, "no path")]
    df = spark.createDataFrame(made, kinds)
    assert [tuple(r) for r in reports.validation_detail(df).orderBy("guid").collect()] == [
        ("a", "G", "U", "40A", "1000", "3000", "2000", "0.6668", "3", "2", "3.000", "2.000", "1", ""),
        ("b", "", "U", "", "900", "0", "0", "", "1", "0", "1.500", "", "0", "no path"),
    ]
    reports.write_detail(df.coalesce(1), str(tmp_path / "detail"))
    (file,) = (tmp_path / "detail").glob("*.csv")
    raw = file.read_bytes()
    assert raw.startswith("﻿guid,group,".encode()) and b"b,,U,,900,0,0,,1,0,1.500,,0,no path" in raw.replace(b'""', b"")
    cells = spark.createDataFrame([(1, [(0, 0, 0), (1, 0, 0)])], "task_id long, path array<struct<i:int,j:int,k:int>>")
    assert [tuple(r) for r in reports.result_cells(cells).orderBy("pos").collect()] == [(1, 0, 0, 0, 0), (1, 1, 1, 0, 0)]
