"""Scenario files (JSON): reading, routing one, and checking its metrics against what is expected."""

from __future__ import annotations

import json
import math

import numpy as np

from pipegrid.operators import routing as R

#: How a metric is checked, by its name's ending or name; everything else must be equal.
_NEAR = ("length_mm", "total_length_mm", "cost_mm")


def load(text: str) -> dict:
    """A scenario with its defaults filled in."""
    given = json.loads(text)
    return {"name": "", "description": "", "cell_mm": 50.0, "origin": [0.0, 0.0, 0.0], "obstacles": [], "params": {}, "mode": "single", "priority": "longest", "tasks": []} | given


def grid_of(scenario: dict) -> R.Grid:
    """The occupancy of a scenario's boxes, cells half-open and clipped."""
    out, mm, origin = R.Grid(tuple(scenario["shape"])), scenario["cell_mm"], scenario["origin"]
    for box in scenario["obstacles"]:
        low = [max(0, math.floor((x - o) / mm)) for x, o in zip(box["min"], origin, strict=True)]
        high = [min(n, math.ceil((x - o) / mm)) for x, o, n in zip(box["max"], origin, scenario["shape"], strict=True)]
        if all(a < b for a, b in zip(low, high, strict=True)) and all(a < b for a, b in zip(box["min"], box["max"], strict=True)):
            out.blocked[tuple(slice(a + 1, b + 1) for a, b in zip(low, high, strict=True))] = True
    return out


def run(scenario: dict) -> dict:
    """The metrics of a scenario: of its one route (mode single) or of all of them in sequence (mode multi)."""
    grid, mm, origin = grid_of(scenario), scenario["cell_mm"], scenario["origin"]
    given = {k: v for k, v in scenario["params"].items() if k in R.Params.__dataclass_fields__}
    if "clearance_connectivity" in scenario["params"]:
        given["connectivity"] = scenario["params"]["clearance_connectivity"]
    params = R.Params(**({"cell_mm": mm} | given))
    cell = lambda p: tuple(math.floor((x - o) / mm) for x, o in zip(p, origin, strict=True))
    tasks = [R.Task(n, cell(t["start"]), cell(t["end"]), f"[{t.get('group') or '?'}] {t.get('utility') or '?'}", math.dist(t["start"], t["end"])) for n, t in enumerate(scenario["tasks"])]
    if scenario["mode"] == "single":
        r = R.search_weighted(grid, tasks[0].start, tasks[0].goal, params)
        hits = sum(grid.is_blocked(c) for c in r.path or [])
        least = sum(abs(a - b) for a, b in zip(tasks[0].start, tasks[0].goal, strict=True)) * mm
        return {"success": r.success, "length_mm": r.length_mm, "turns": r.turns, "cost_mm": r.cost_mm, "expanded_nodes": r.expanded, "path_hits_obstacle": hits, "detour_ratio": r.length_mm / least if least else 1.0}
    done = R.route_sequential(grid, tasks, R.Plan(params, scenario["priority"]))
    paths = [set(r.path) for _, r in done if r.success]
    pairs = sum(not a.isdisjoint(b) for n, a in enumerate(paths) for b in paths[:n])
    return {"success_count": len(paths), "failure_count": len(done) - len(paths), "success_rate": len(paths) / len(done) if done else 0.0, "collisions": pairs, "total_length_mm": float(np.sum([r.length_mm for _, r in done if r.success]))}


def check(actual: dict, expected: dict) -> list[tuple[str, bool]]:
    """Whether each expected metric holds: max_x bounds x from above, lengths are near, all else is equal."""
    out = []
    for name, want in expected.items():
        if name.startswith("max_"):
            ok = actual[name[4:]] <= want
        elif name in _NEAR:
            ok = math.isclose(actual[name], want, rel_tol=1e-6, abs_tol=1e-6)
        else:
            ok = actual[name] == want
        out.append((name, ok))
    return out
