"""Every routing query on its whole scenes of the smallest tables, against searches that share no code with the kernel."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pytest

from pipegrid.plans import registry, routes
from pipegrid.sources import derived as D

FOLDER = "/root/testdata/sf0.001"
NI, NJ, NK = D.ROUTED_SHAPE
MM, STEPS = 100.0, [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def inside(c):
    return 0 <= c[0] < NI and 0 <= c[1] < NJ and 0 <= c[2] < NK


def near(c):
    return [(c[0] + a, c[1] + b, c[2] + d) for a, b, d in STEPS]


def shortest(blocked, start, goal, allowed=lambda c: True):
    """The number of steps by breadth-first search, or None."""
    if start in blocked or goal in blocked:
        return None
    far, queue = {start: 0}, deque([start])
    while queue:
        c = queue.popleft()
        if c == goal:
            return far[c]
        for y in near(c):
            if inside(y) and y not in blocked and y not in far and allowed(y):
                far[y] = far[c] + 1
                queue.append(y)
    return None


def penalty(blocked, c):
    """10 for each cell that the nearest blocked one is closer than 2 steps."""
    return 0.0 if not any(y in blocked for y in near(c)) else 10.0


def cheapest(blocked, start, goal):
    """The least cost by Dijkstra's algorithm over cells and directions, or None."""
    if start in blocked or goal in blocked:
        return None
    best, queue = {(start, None): 0.0}, [(0.0, 0, start, None)]
    n = 1
    while queue:
        cost, _, c, way = heapq.heappop(queue)
        if cost > best[c, way]:
            continue
        if c == goal:
            return cost
        for d, y in zip(STEPS, near(c), strict=True):
            if inside(y) and y not in blocked:
                total = cost + MM + (500.0 if way not in (None, d) else 0.0) + penalty(blocked, y)
                if total < best.get((y, d), float("inf")):
                    best[y, d] = total
                    heapq.heappush(queue, (total, n, y, d))
                    n += 1
    return None


def snapped(blocked, c, radius):
    if c not in blocked:
        return c
    offsets = sorted((abs(a) + abs(b) + abs(d), a, b, d) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) for d in range(-radius, radius + 1))
    return next(((c[0] + a, c[1] + b, c[2] + d) for _, a, b, d in offsets if inside(y := (c[0] + a, c[1] + b, c[2] + d)) and y not in blocked), c)


def cells_of(path):
    return [tuple(map(int, x.split(","))) for x in path.split(" ")] if path else []


def price(blocked, path):
    """A path's cost by its own cells."""
    moves = [tuple(y - x for x, y in zip(a, b, strict=True)) for a, b in zip(path, path[1:], strict=False)]
    turns = sum(a != b for a, b in zip(moves, moves[1:], strict=False))
    assert all(m in STEPS for m in moves) and not set(path) & blocked and all(map(inside, path))
    return len(moves) * MM + 500.0 * turns + sum(penalty(blocked, c) for c in path[1:]), turns


@pytest.fixture(scope="module")
def world(spark):
    def blocked(without):
        found = defaultdict(set)
        for r in routes._occupied(spark, FOLDER, without).collect():
            found[r["scene_id"]].add((r["i"], r["j"], r["k"]))
        return found

    tasks = {r["task_id"]: r for r in D.routed_tasks(spark, FOLDER).collect()}
    ends = {n: ((r["si"], r["sj"], r["sk"]), (r["gi"], r["gj"], r["gk"])) for n, r in tasks.items()}
    return tasks, ends, blocked(False), blocked(True)


def results(spark, name):
    return {r["task_id"]: r for r in registry.queries()[name](spark, FOLDER).collect()}


def test_occupied(spark, world):
    tasks, _, blocked, _ = world
    want = defaultdict(set)
    for r in D.routed_obstacles(spark, FOLDER).collect():
        low, high = ([int(r[f"{e}_{a}"] // 100) for a in "xyz"] for e in ("min", "max"))
        want[r["scene_id"]] |= {c for i in range(low[0], high[0]) for j in range(low[1], high[1]) for k in range(low[2], high[2]) if inside(c := (i, j, k))}
    assert blocked == want and len(tasks) == 10


def test_single(spark, world):
    tasks, ends, blocked, _ = world
    got = results(spark, "rt_single")
    assert set(got) == set(tasks)
    for n, r in got.items():
        own = blocked[tasks[n]["scene_id"]]
        steps = shortest(own, *ends[n])
        assert r["success"] == (steps is not None)
        if steps is not None:
            path = cells_of(r["path"])
            assert r["length_mm"] == steps * MM == (len(path) - 1) * MM and (path[0], path[-1]) == ends[n]
            assert price(own, path)[1] == r["turns"]
    assert any(r["success"] for r in got.values())


def test_independent(spark, world):
    tasks, ends, blocked, _ = world
    for n, r in results(spark, "rt_independent").items():
        own = blocked[tasks[n]["scene_id"]]
        a, b = (snapped(own, c, 2) for c in ends[n])
        least = cheapest(own, a, b)
        assert r["success"] == (least is not None)
        if least is not None:
            path = cells_of(r["path"])
            assert r["cost_mm"] == pytest.approx(least) and price(own, path) == (pytest.approx(least), r["turns"]) and (path[0], path[-1]) == (a, b)


def test_tube(spark, world):
    tasks, ends, blocked, _ = world
    for n, r in results(spark, "rt_tube").items():
        own, path = blocked[tasks[n]["scene_id"]], cells_of(r["path"])
        if r["success"]:
            price(own, path)
            assert (path[0], path[-1]) == ends[n] and len(path) - 1 >= shortest(own, *ends[n])


def replayed(world, got):
    """The routes in order, each the cheapest among those placed before; the grid at the end."""
    tasks, ends, blocked, _ = world
    work = {s: set(c) for s, c in blocked.items()}
    order = sorted(got.values(), key=lambda r: (r["scene_id"], r["order_index"]))
    far = {n: sum(abs(x - y) for x, y in zip(*e, strict=True)) for n, e in ends.items()}
    assert all(far[a["task_id"]] >= far[b["task_id"]] for a, b in zip(order, order[1:], strict=False) if a["scene_id"] == b["scene_id"])
    for r in order:
        own = work.setdefault(tasks[r["task_id"]]["scene_id"], set())
        a, b = (snapped(own, c, 2) for c in ends[r["task_id"]])
        least = cheapest(own, a, b)
        assert r["success"] == (least is not None)
        if least is not None:
            path = cells_of(r["path"])
            assert r["cost_mm"] == pytest.approx(least) == price(own, path)[0]
            own.update(path)


def test_sequential(spark, world):
    replayed(world, results(spark, "rt_sequential"))


def test_ripup(spark, world):
    """No two pipes share a cell, none that sequential routing placed is lost, and with no failures the two agree."""
    before, after = results(spark, "rt_sequential"), results(spark, "rt_ripup")
    tasks, _, blocked, _ = world
    used = set()
    for n, r in after.items():
        assert r["success"] or not before[n]["success"]
        path = {(r["scene_id"], c) for c in cells_of(r["path"])}
        assert not used & path and not {c for _, c in path} & blocked[tasks[n]["scene_id"]]
        used |= path
    if all(r["success"] for r in before.values()):
        assert {n: r["path"] for n, r in after.items()} == {n: r["path"] for n, r in before.items()}


def test_subset_metrics_and_polylines(spark, world):
    tasks, ends, blocked, _ = world
    steps = {n: shortest(blocked[t["scene_id"]], *ends[n]) for n, t in tasks.items()}
    for n, r in results(spark, "rt_subset").items():
        fresh = tasks[n]["utility_group"] == "P"
        straight = sum(abs(x - y) for x, y in zip(*ends[n], strict=True)) * MM
        assert r["routed"] == fresh and r["length_mm"] == ((steps[n] or 0) * MM if fresh else straight)
    single = results(spark, "rt_independent")
    for r in registry.queries()["rt_metrics"](spark, FOLDER).collect():
        own = [x for x in single.values() if x["scene_id"] == r["scene_id"]]
        good = [x["length_mm"] for x in own if x["success"]]
        assert (r["n"], r["ok"], r["length_mm"]) == (len(own), len(good), sum(good)) and r["rate"] == len(good) / len(own)
    lines = defaultdict(list)
    for r in registry.queries()["rt_polylines"](spark, FOLDER).orderBy("task_id", "pos").collect():
        lines[r["task_id"]].append((r["x"], r["y"], r["z"]))
    for n, line in lines.items():
        assert len(line) == (steps[n] + 1 if steps[n] is not None else 2)
        assert (line[0], line[-1]) == tuple(tuple(x * MM + 50 for x in e) for e in ends[n])


def test_comparison(spark, world):
    tasks, ends, _, blocked = world
    got = {r["utility_group"]: r for r in registry.queries()["compare_by_group"](spark, FOLDER).collect()}
    for group, r in got.items():
        own = [n for n, t in tasks.items() if t["utility_group"] == group]
        free = lambda n, c: snapped(blocked[tasks[n]["scene_id"]], c, 3)
        least = [cheapest(blocked[tasks[n]["scene_id"]], free(n, ends[n][0]), free(n, ends[n][1])) for n in own]
        assert (r["n"], r["ok"]) == (len(own), sum(x is not None for x in least))
