"""Path search on an occupancy grid, and its distribution over scenes and tasks.

The search itself is a Python kernel: its result depends on the order of a heap, which no relational operator keeps. All else
(scenes, snapping, metrics) is relational. Independent routes are dealt by scene and share of its tasks, routes that see each
other by scene. A kernel works on a grid padded by one blocked cell on every side, with cells as flat numbers.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.operators.grid import ball, check_grid

#: The order in which neighbours are tried: +X, -X, +Y, -Y, +Z, -Z.
NEIGHBOURS = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


@dataclass
class Params:
    """Cost weights in mm. Every weight must be at least 0, so that the distance left never overestimates."""

    cell_mm: float = 50.0
    w_turn: float = 500.0
    w_clear: float = 10.0
    clearance_radius: int = 2
    connectivity: int = 6
    w_tier: dict[int, float] = field(default_factory=dict)
    w_corridor: float = 0.0
    rack_levels: tuple[int, ...] = ()

    def __post_init__(self):
        if min(self.cell_mm, self.w_turn, self.w_clear, self.clearance_radius, self.w_corridor, *self.w_tier.values(), 0) < 0 or self.cell_mm <= 0:
            raise ValueError("weights must not be negative and cell_mm must be positive")
        if self.connectivity not in (6, 26):
            raise ValueError("connectivity is 6 or 26")


@dataclass
class Route:
    """A search's outcome; path holds cells (i, j, k)."""

    success: bool
    path: list[tuple[int, int, int]] | None = None
    length_mm: float = 0.0
    cost_mm: float = 0.0
    turns: int = 0
    expanded: int = 0


class Grid:
    """Which cells are blocked; everything outside is."""

    def __init__(self, shape: tuple[int, int, int], cells=()):
        check_grid(shape, 1.0)
        self.shape = tuple(shape)
        self.blocked = np.ones([n + 2 for n in shape], bool)
        self.blocked[1:-1, 1:-1, 1:-1] = False
        cells = np.asarray(list(cells) if not isinstance(cells, np.ndarray) else cells, dtype=np.int64).reshape(-1, 3)
        if len(cells):
            cells = cells[((cells >= 0) & (cells < np.array(shape))).all(axis=1)]
            self.blocked[tuple((cells + 1).T)] = True

    def copy(self) -> Grid:
        out = Grid.__new__(Grid)
        out.shape, out.blocked = self.shape, self.blocked.copy()
        return out

    def is_blocked(self, cell) -> bool:
        return any(not 0 <= c < n for c, n in zip(cell, self.shape, strict=True)) or bool(self.blocked[cell[0] + 1, cell[1] + 1, cell[2] + 1])

    def block(self, cell) -> None:
        if all(0 <= c < n for c, n in zip(cell, self.shape, strict=True)):
            self.blocked[cell[0] + 1, cell[1] + 1, cell[2] + 1] = True

    def clearance(self, radius: int, connectivity: int) -> np.ndarray:
        """The distance to the nearest blocked cell of the grid, at most radius, for every cell."""
        inner = self.blocked[1:-1, 1:-1, 1:-1]
        out = np.full(self.shape, radius, np.int64)
        for di, dj, dk, d in sorted(ball(radius, connectivity), key=lambda o: -o[3]):
            if d < radius or radius == 0:
                to = tuple(slice(max(0, x), n + min(0, x)) for x, n in zip((di, dj, dk), self.shape, strict=True))
                of = tuple(slice(max(0, -x), n + min(0, -x)) for x, n in zip((di, dj, dk), self.shape, strict=True))
                part = out[to]
                part[inner[of]] = np.minimum(part[inner[of]], d)
        return out


def count_turns(path) -> int:
    """Changes of direction along a path."""
    moves = [tuple(b - a for a, b in zip(p, q, strict=True)) for p, q in zip(path, path[1:], strict=False)]
    return sum(a != b for a, b in zip(moves, moves[1:], strict=False))


def _field(grid: Grid, goal, cell_mm: float) -> list[float]:
    """The least distance left from every padded cell."""
    axes = [np.abs(np.arange(-1, n + 1) - g) for n, g in zip(grid.shape, goal, strict=True)]
    return ((axes[0][:, None, None] + axes[1][None, :, None] + axes[2][None, None, :]) * cell_mm).ravel().tolist()


def _strides(grid: Grid) -> tuple[int, int]:
    return (grid.shape[1] + 2) * (grid.shape[2] + 2), grid.shape[2] + 2


def _flat(grid: Grid, cell) -> int:
    a, b = _strides(grid)
    return (cell[0] + 1) * a + (cell[1] + 1) * b + cell[2] + 1


def _cell(grid: Grid, x: int) -> tuple[int, int, int]:
    a, b = _strides(grid)
    return x // a - 1, x % a // b - 1, x % b - 1


def _offsets(grid: Grid) -> list[int]:
    a, b = _strides(grid)
    return [di * a + dj * b + dk for di, dj, dk in NEIGHBOURS]


def search(grid: Grid, start, goal, cell_mm: float, most: int | None = None, allowed: np.ndarray | None = None, trace: list | None = None) -> Route:
    """The shortest path (A*, equal cost per step); of equal estimates the one found first goes on.

    most: expansions after which to give up (None: never). allowed: the cells to search in (None: all free cells). trace: gets
    the cells in the order of their expansion.
    """
    if grid.is_blocked(start) or grid.is_blocked(goal):
        return Route(False)
    if tuple(start) == tuple(goal):
        return Route(True, [tuple(start)], expanded=1)
    shut = grid.blocked.copy()
    if allowed is not None:
        shut[1:-1, 1:-1, 1:-1] |= ~allowed
    shut = bytearray(shut.ravel().tobytes())
    left, steps = _field(grid, goal, cell_mm), _offsets(grid)
    first, last = _flat(grid, start), _flat(grid, goal)
    cost, came, queue, n, expanded = {first: 0.0}, {}, [(left[first], 0, first)], 1, 0
    closed = set()
    while queue:
        x = heapq.heappop(queue)[2]
        if x in closed:
            continue
        closed.add(x)
        expanded += 1
        if trace is not None:
            trace.append(_cell(grid, x))
        if x == last:
            path = [x]
            while path[-1] != first:
                path.append(came[path[-1]])
            path = [_cell(grid, y) for y in reversed(path)]
            length = (len(path) - 1) * cell_mm
            return Route(True, path, length, length, count_turns(path), expanded)
        if most is not None and expanded >= most:
            break
        reach = cost[x] + cell_mm
        for step in steps:
            y = x + step
            if not shut[y] and y not in closed and reach < cost.get(y, math.inf):
                cost[y], came[y] = reach, x
                heapq.heappush(queue, (reach + left[y], n, y))
                n += 1
    return Route(False, expanded=expanded)


def search_world(grid: Grid, start_mm, goal_mm, cell_mm: float, origin=(0.0, 0.0, 0.0), most: int | None = None, params: Params | None = None) -> Route:
    """A search between two points in mm: the shortest path, or with params the one of least cost."""
    a, b = (tuple(math.floor((x - o) / cell_mm) for x, o in zip(p, origin, strict=True)) for p in (start_mm, goal_mm))
    return search(grid, a, b, cell_mm, most) if params is None else search_weighted(grid, a, b, params, most)


def search_sparse(shape, blocked, start, goal, cell_mm: float, most: int | None = None, allowed=None) -> Route:
    """search without arrays over the grid: blocked is a set of cells, allowed a test of a cell (None: any).

    Time and memory follow the cells that are reached, so grids of any size (shape: any three numbers) can be searched.
    """
    free = lambda c: all(0 <= x < n for x, n in zip(c, shape, strict=True)) and c not in blocked
    start, goal = tuple(start), tuple(goal)
    if not (free(start) and free(goal)):
        return Route(False)
    left = lambda c: sum(abs(x - y) for x, y in zip(c, goal, strict=True)) * cell_mm
    cost, came, closed, queue, n, expanded = {start: 0.0}, {}, set(), [(left(start), 0, start)], 1, 0
    while queue:
        c = heapq.heappop(queue)[2]
        if c in closed:
            continue
        closed.add(c)
        expanded += 1
        if c == goal:
            path = [c]
            while path[-1] in came:
                path.append(came[path[-1]])
            path.reverse()
            length = (len(path) - 1) * cell_mm
            return Route(True, path, length, length, count_turns(path), expanded)
        if most is not None and expanded >= most:
            break
        reach = cost[c] + cell_mm
        for d in NEIGHBOURS:
            y = (c[0] + d[0], c[1] + d[1], c[2] + d[2])
            if y not in closed and free(y) and (allowed is None or allowed(y)) and reach < cost.get(y, math.inf):
                cost[y], came[y] = reach, c
                heapq.heappush(queue, (reach + left(y), n, y))
                n += 1
    return Route(False, expanded=expanded)


def route_tube_sparse(shape, blocked, start, goal, cell_mm: float, factor: int, radius: int, most: int | None = None) -> tuple[Route, Route]:
    """route_tube without arrays over the grid; fine, coarse."""
    coarse = {tuple(x // factor for x in c) for c in blocked}
    small = tuple(-(-n // factor) for n in shape)
    rough = search_sparse(small, coarse, tuple(x // factor for x in start), tuple(x // factor for x in goal), cell_mm * factor, most)
    if not rough.success:
        return Route(False), rough
    near = range(-radius, radius + 1)
    tube = {(i + a, j + b, k + c) for i, j, k in rough.path for a in near for b in near for c in near}
    return search_sparse(shape, blocked, start, goal, cell_mm, most, lambda c: (c[0] // factor, c[1] // factor, c[2] // factor) in tube), rough


def penalties(grid: Grid, params: Params, corridor: set | None = None) -> list[float]:
    """What entering each padded cell costs beyond its length: nearness to obstacles, its level, being off the corridor."""
    out = np.zeros(grid.shape)
    if params.w_clear > 0 and params.clearance_radius > 0:
        out += params.w_clear * (params.clearance_radius - grid.clearance(params.clearance_radius, params.connectivity))
    for level, mm in params.w_tier.items():
        if 0 <= level < grid.shape[2]:
            out[:, :, level] += mm
    if params.w_corridor > 0 and (corridor is not None or params.rack_levels):
        off = np.ones(grid.shape, bool)
        for level in params.rack_levels:
            if 0 <= level < grid.shape[2]:
                off[:, :, level] = False
        for c in corridor or ():
            off[c] = False
        out[off] += params.w_corridor
    return np.pad(out, 1).ravel().tolist()


def search_weighted(grid: Grid, start, goal, params: Params, most: int | None = None, corridor: set | None = None, trace: list | None = None) -> Route:
    """The path of least cost, with a state per cell and direction of entry, so that turns cost w_turn.

    trace: gets the cells in the order of their expansion, a cell as often as states of it are expanded.
    """
    if grid.is_blocked(start) or grid.is_blocked(goal):
        return Route(False)
    if tuple(start) == tuple(goal):
        return Route(True, [tuple(start)], expanded=1)
    shut = bytearray(grid.blocked.ravel().tobytes())
    left, extra, steps = _field(grid, goal, params.cell_mm), penalties(grid, params, corridor), list(enumerate(_offsets(grid)))
    first, last, mm, turn = _flat(grid, start), _flat(grid, goal), params.cell_mm, params.w_turn
    # a state is 7 * cell + direction, 6 for none
    cost, came, queue, n, expanded = {7 * first + 6: 0.0}, {}, [(left[first], 0, 7 * first + 6)], 1, 0
    closed, push, pop, far = set(), heapq.heappush, heapq.heappop, math.inf
    while queue:
        s = pop(queue)[2]
        if s in closed:
            continue
        closed.add(s)
        expanded += 1
        x, way = divmod(s, 7)
        if trace is not None:
            trace.append(_cell(grid, x))
        if x == last:
            total, path = cost[s], [x]
            while s in came:
                s = came[s]
                path.append(s // 7)
            path = [_cell(grid, y) for y in reversed(path)]
            return Route(True, path, (len(path) - 1) * mm, total, count_turns(path), expanded)
        if most is not None and expanded >= most:
            break
        here = cost[s]
        for d, step in steps:
            y = x + step
            if shut[y]:
                continue
            t = 7 * y + d
            if t in closed:
                continue
            reach = here + ((mm if d == way or way == 6 else mm + turn) + extra[y])
            if reach < cost.get(t, far):
                cost[t], came[t] = reach, s
                push(queue, (reach + left[y], n, t))
                n += 1
    return Route(False, expanded=expanded)


def snap(grid: Grid, cell, radius: int, keep: bool = True):
    """The nearest free cell within radius of a blocked one (by manhattan distance, then offset); else itself, or None."""
    if not grid.is_blocked(cell):
        return tuple(cell)
    best = min(
        ((abs(a) + abs(b) + abs(c), a, b, c) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) for c in range(-radius, radius + 1) if not grid.is_blocked((cell[0] + a, cell[1] + b, cell[2] + c))),
        default=None,
    )
    return tuple(x + d for x, d in zip(cell, best[1:], strict=True)) if best else tuple(cell) if keep else None


def _spread(path, radius: int, take) -> None:
    """Grow a path by its six neighbours radius times; take tells whether a new cell joins, and only those grow on."""
    edge = list(path)
    for _ in range(radius):
        edge = [c for i, j, k in edge for a, b, d in NEIGHBOURS if take(c := (i + a, j + b, k + d))]


def mark_pipe(grid: Grid, path, radius: int) -> None:
    """Block a path, and radius steps of free cells around it."""
    for c in path:
        grid.block(c)

    def take(c) -> bool:
        if grid.is_blocked(c):
            return False
        grid.block(c)
        return True

    _spread(path, radius, take)


def add_corridor(grid: Grid, corridor: set, path, radius: int) -> None:
    """Add a path and radius steps around it, through any cells of the grid, to a corridor."""
    corridor.update(path)

    def take(c) -> bool:
        if c in corridor or any(not 0 <= x < n for x, n in zip(c, grid.shape, strict=True)):
            return False
        corridor.add(c)
        return True

    _spread(path, radius, take)


@dataclass
class Task:
    """A connection between two cells, with what orders it and how wide it is."""

    key: int
    start: tuple[int, int, int]
    goal: tuple[int, int, int]
    label: str = ""
    distance: float = 0.0
    diameter_mm: float = 0.0


def order_tasks(tasks: list[Task], priority: str) -> list[Task]:
    """Tasks in a priority's order; equal ones keep their order."""
    keys = {"original": lambda t: 0, "shortest": lambda t: t.distance, "longest": lambda t: -t.distance, "utility": lambda t: (t.label, -t.distance), "diameter": lambda t: (-t.diameter_mm, -t.distance)}
    if priority not in keys:
        raise ValueError(f"unknown priority {priority}")
    return sorted(tasks, key=keys[priority])


@dataclass
class Plan:
    """How a scene is routed."""

    params: Params
    priority: str = "longest"
    pipe_radius: int = 0
    snap_radius: int = 2
    by_diameter: bool = False
    clearance_mm: float = 0.0
    most: int | None = None
    corridor_radius: int = 1
    seed_corridor: frozenset | None = None
    rounds: int = 3
    most_blockers: int = 8

    def radius(self, t: Task) -> int:
        if not self.by_diameter or t.diameter_mm <= 0:
            return self.pipe_radius
        return max(self.pipe_radius, math.ceil((t.diameter_mm / 2 + self.clearance_mm) / self.params.cell_mm))

    def corridor(self) -> set | None:
        return set(self.seed_corridor or ()) if self.params.w_corridor > 0 else None

    def route(self, grid: Grid, t: Task, corridor: set | None) -> Route:
        return search_weighted(grid, snap(grid, t.start, self.snap_radius), snap(grid, t.goal, self.snap_radius), self.params, self.most, corridor)


def route_sequential(grid: Grid, tasks: list[Task], plan: Plan) -> list[tuple[Task, Route]]:
    """Tasks one after the other in order of priority; each placed path is an obstacle for the next."""
    work, corridor, out = grid.copy(), plan.corridor(), []
    for t in order_tasks(tasks, plan.priority):
        found = plan.route(work, t, corridor)
        if found.success:
            mark_pipe(work, found.path, plan.radius(t))
            if corridor is not None:
                add_corridor(work, corridor, found.path, plan.corridor_radius)
        out.append((t, found))
    return out


def route_ripup(grid: Grid, tasks: list[Task], plan: Plan) -> list[tuple[Task, Route]]:
    """Sequential routing, then rounds in which a failed task may displace others, if all of them find new paths."""
    done = route_sequential(grid, tasks, plan)
    ordered, results = [t for t, _ in done], [r for _, r in done]
    placed = {n: r.path for n, r in enumerate(results) if r.success}

    def with_paths(paths: dict) -> Grid:
        out = grid.copy()
        for n, path in paths.items():
            mark_pipe(out, path, plan.radius(ordered[n]))
        return out

    for _ in range(plan.rounds):
        changed = False
        for n in [n for n in range(len(ordered)) if n not in placed]:
            corridor = plan.corridor()
            if corridor is not None:
                for path in placed.values():
                    add_corridor(grid, corridor, path, plan.corridor_radius)
            ideal = plan.route(grid, ordered[n], corridor)
            if not ideal.success:
                continue
            own = set(ideal.path)
            blockers = sorted(b for b, path in placed.items() if not own.isdisjoint(path))
            if not blockers or len(blockers) > plan.most_blockers:
                continue
            trial = {b: path for b, path in placed.items() if b not in blockers}
            work, moved = with_paths(trial), {}
            for b in [n, *blockers]:
                moved[b] = plan.route(work, ordered[b], corridor)
                if not moved[b].success:
                    break
                trial[b] = moved[b].path
                mark_pipe(work, moved[b].path, plan.radius(ordered[b]))
            else:
                placed, changed = trial, True
                for b, r in moved.items():
                    results[b] = r
        if not changed:
            break
    return list(zip(ordered, results, strict=True))


def route_tube(grid: Grid, start, goal, cell_mm: float, factor: int, radius: int, coarse_cells=None, most: int | None = None) -> tuple[Route, Route]:
    """A search on a grid coarser by factor, then a search in the tube within radius of the coarse path; fine, coarse."""
    shape = tuple(-(-n // factor) for n in grid.shape)
    if coarse_cells is None:
        coarse_cells = np.unique((np.argwhere(grid.blocked[1:-1, 1:-1, 1:-1]) // factor), axis=0)
    rough = search(Grid(shape, coarse_cells), tuple(c // factor for c in start), tuple(c // factor for c in goal), cell_mm * factor, most)
    if not rough.success:
        return Route(False), rough
    tube = np.zeros(shape, bool)
    for i, j, k in rough.path:
        tube[max(0, i - radius) : i + radius + 1, max(0, j - radius) : j + radius + 1, max(0, k - radius) : k + radius + 1] = True
    allowed = tube.repeat(factor, 0).repeat(factor, 1).repeat(factor, 2)[tuple(slice(n) for n in grid.shape)]
    return search(grid, start, goal, cell_mm, most, allowed), rough


RESULT = "scene_id int, task_id long, order_index int, success boolean, length_mm double, cost_mm double, turns int, expanded long, path array<struct<i:int,j:int,k:int>>"


def _tasks(rows: pd.DataFrame, cell_mm: float) -> list[Task]:
    out = []
    for r in rows.sort_values("task_id").itertuples():
        a, b = (int(r.si), int(r.sj), int(r.sk)), (int(r.gi), int(r.gj), int(r.gk))
        out.append(Task(int(r.task_id), a, b, r.label, sum(abs(x - y) for x, y in zip(a, b, strict=True)) * cell_mm, float(r.diameter_mm or 0)))
    return out


def _frame(scene, done: list[tuple[int, Task, Route]]) -> pd.DataFrame:
    columns = ["scene_id", "task_id", "order_index", "success", "length_mm", "cost_mm", "turns", "expanded", "path"]
    rows = [(scene, t.key, n, r.success, r.length_mm, r.cost_mm, r.turns, r.expanded, None if r.path is None else [dict(zip("ijk", c, strict=True)) for c in r.path]) for n, t, r in done]
    return pd.DataFrame(rows, columns=columns)


def route_scenes(tasks: DataFrame, cells: DataFrame, shape, plan: Plan, mode: str = "independent", share: int = 64, tube: tuple[int, int] = (8, 2)) -> DataFrame:
    """A result per task. mode: independent, single (no snapping, shortest), tube, sequential or ripup.

    Modes in which tasks don't see each other are dealt in shares of a scene's tasks, each with the scene's cells once; the
    others need a whole scene in order, so they run in parallel by scene alone.
    """
    alone = mode in ("independent", "single", "tube")
    if not alone and mode not in ("sequential", "ripup"):
        raise ValueError(f"unknown mode {mode}")
    shares = tasks.groupBy("scene_id").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares") if alone else F.lit(1).alias("shares"))
    dealt = tasks.join(shares, "scene_id").withColumn("share", F.pmod(F.xxhash64("task_id"), F.col("shares")).cast("int"))
    dealt = dealt.select("scene_id", "share", "task_id", "si", "sj", "sk", "gi", "gj", "gk", "label", "diameter_mm")
    copies = cells.join(shares, "scene_id").select(F.col("scene_id").alias("of"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("copy"), "i", "j", "k")
    mm = plan.params.cell_mm

    def run(own: pd.DataFrame, occupied: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return _frame(0, [])
        grid, todo = Grid(shape, occupied[["i", "j", "k"]].to_numpy()), _tasks(own, mm)
        if mode == "sequential":
            done = route_sequential(grid, todo, plan)
        elif mode == "ripup":
            done = route_ripup(grid, todo, plan)
        elif mode == "single":
            done = [(t, search(grid, t.start, t.goal, mm, plan.most)) for t in todo]
        elif mode == "tube":
            done = [(t, route_tube(grid, t.start, t.goal, mm, *tube, most=plan.most)[0]) for t in todo]
        else:
            done = [(t, plan.route(grid, t, plan.corridor())) for t in todo]
        return _frame(int(own["scene_id"].iloc[0]), [(n if not alone else -1, t, r) for n, (t, r) in enumerate(done)])

    return dealt.groupBy("scene_id", "share").cogroup(copies.groupBy("of", "copy")).applyInPandas(run, RESULT)
