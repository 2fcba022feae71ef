"""The search and its drivers against published results and invariants."""

from __future__ import annotations

from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pipegrid.operators import routing as R
from pipegrid.sources import scenario as SC


def scenario(**more):
    import json

    base = {"cell_mm": 50, "params": {"w_turn": 500, "w_clear": 10, "clearance_radius": 2, "clearance_connectivity": 6}}
    return SC.load(json.dumps(base | more))


def test_empty_grid():
    got = SC.run(scenario(shape=[20, 20, 20], tasks=[{"start": [25, 25, 25], "end": [975, 975, 975]}]))
    assert all(ok for _, ok in SC.check(got, {"success": True, "length_mm": 2850, "turns": 2, "path_hits_obstacle": 0, "max_expanded_nodes": 30000}))
    assert got["expanded_nodes"] == 22856


def test_wall():
    got = SC.run(scenario(shape=[80, 80, 80], obstacles=[{"min": [1900, 0, 0], "max": [2150, 2250, 4000]}], tasks=[{"start": [275, 2025, 2025], "end": [3725, 2025, 2025]}]))
    assert (got["length_mm"], got["turns"], got["expanded_nodes"], got["path_hits_obstacle"]) == (3950, 2, 9036, 0)
    assert got["detour_ratio"] <= 1.2


def test_five_pipes():
    same = [{"start": [275, 3025, 1525], "end": [5725, 3025, 1525], "utility": u} for u in ("UPW_S", "NFW", "PA", "NW", "ACID")]
    got = SC.run(scenario(shape=[120, 120, 60], mode="multi", obstacles=[{"min": [0, 0, 0], "max": [6000, 6000, 250]}], tasks=same))
    assert got == {"success_count": 5, "failure_count": 0, "success_rate": 1.0, "collisions": 0, "total_length_mm": 28050.0}


def test_ripup():
    grid = R.Grid((9, 9, 1), [(i, 4, 0) for i in range(9) if i not in (2, 6)])
    tasks = [R.Task(0, (6, 0, 0), (4, 8, 0), "", 1000), R.Task(1, (7, 0, 0), (6, 8, 0), "", 900)]
    plan = R.Plan(R.Params(cell_mm=100.0))
    before = grid.blocked.copy()
    assert [r.success for _, r in R.route_sequential(grid, tasks, plan)] == [True, False]
    assert {t.key: r.length_mm for t, r in R.route_ripup(grid, tasks, plan)} == {0: 1300.0, 1: 900.0}
    assert (grid.blocked == before).all()


def test_tube():
    grid = R.Grid((200, 200, 4), [(100, j, k) for j in range(160) for k in range(4)])
    fine, _ = R.route_tube(grid, (10, 10, 1), (190, 10, 1), 50.0, 8, 2)
    whole = R.search(grid, (10, 10, 1), (190, 10, 1), 50.0)
    assert fine.length_mm == whole.length_mm and fine.expanded <= whole.expanded


def test_corridor_bundles():
    params = R.Params(cell_mm=100.0, w_turn=0.0, w_clear=0.0, w_corridor=1000.0)
    tasks = [R.Task(0, (1, 5, 0), (28, 5, 0), "", 2), R.Task(1, (1, 15, 0), (28, 15, 0), "", 1)]
    (_, a), (_, b) = R.route_sequential(R.Grid((30, 30, 1)), tasks, R.Plan(params))
    near = [any(abs(c[1] - d[1]) <= 2 and abs(c[0] - d[0]) <= 2 for d in a.path) for c in b.path]
    assert sum(near) > len(near) / 2 and b.length_mm >= 2700


def test_limits_and_errors():
    grid = R.Grid((50, 50, 1))
    r = R.search(grid, (0, 0, 0), (49, 49, 0), 100.0, most=5)
    assert not r.success and r.expanded <= 5 and r.path is None
    assert R.search(grid, (0, 0, 0), (0, 0, 0), 100.0).path == [(0, 0, 0)]
    assert not R.search(R.Grid((7, 5, 3), [(3, j, k) for j in range(5) for k in range(3)]), (0, 0, 0), (6, 0, 0), 1.0).success
    for bad in ({"w_turn": -1.0}, {"connectivity": 8}, {"cell_mm": 0.0}):
        with pytest.raises(ValueError):
            R.Params(**bad)
    with pytest.raises(ValueError):
        R.order_tasks([], "nonsense")
    assert R.search_weighted(R.Grid((4, 4, 1)), (0, 0, 0), (3, 0, 0), R.Params(cell_mm=100.0)).length_mm == 300


def test_clearance_and_marks():
    grid = R.Grid((9, 9, 1), [(4, 4, 0)])
    d = grid.clearance(2, 6)
    assert [int(d[c]) for c in ((4, 4, 0), (4, 5, 0), (4, 6, 0), (0, 0, 0))] == [0, 1, 2, 2]
    assert (grid.clearance(0, 6) == 0).all()
    R.mark_pipe(grid, [(1, 1, 0)], 1)
    assert int(grid.blocked[1:-1, 1:-1, 1:-1].sum()) == 6
    assert R.snap(grid, (4, 4, 0), 1) == (3, 4, 0) and R.snap(grid, (9, 9, 9), 0, keep=False) is None
    plan = R.Plan(R.Params(cell_mm=100.0), pipe_radius=2, by_diameter=True)
    assert [plan.radius(R.Task(0, (0, 0, 0), (0, 0, 0), diameter_mm=d)) for d in (0, 50, 600)] == [2, 2, 3]


def _steps(shape, cells, start, goal):
    seen, queue = {start: 0}, deque([start])
    while queue:
        c = queue.popleft()
        for d in R.NEIGHBOURS:
            x = tuple(a + b for a, b in zip(c, d, strict=True))
            if all(0 <= a < n for a, n in zip(x, shape, strict=True)) and x not in cells and x not in seen:
                seen[x] = seen[c] + 1
                queue.append(x)
    return seen.get(goal)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 2)), max_size=50), st.integers(0, 2), st.integers(0, 2))
def test_shortest_equals_breadth_first(cells, a, b):
    start, goal, shape = (0, a, 0), (5, 5 - b, 2), (6, 6, 3)
    cells = cells - {start, goal}
    r = R.search(R.Grid(shape, np.array(sorted(cells))), start, goal, 1.0)
    want = _steps(shape, cells, start, goal)
    assert r.success == (want is not None)
    if r.success:
        assert r.length_mm == want and not cells.intersection(r.path)
        assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for p, q in zip(r.path, r.path[1:], strict=False))
        w = R.search_weighted(R.Grid(shape, np.array(sorted(cells))), start, goal, R.Params(cell_mm=1.0, w_turn=0.0, w_clear=0.0))
        assert w.length_mm == want
