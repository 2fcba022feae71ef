"""Scenes by program, the demo scene, routing a scene, summaries, and the command line (python -m pipegrid)."""

from __future__ import annotations

import argparse
import math
import time
from pathlib import Path

from pipegrid.operators import routing as R
from pipegrid.sources import scene_text as ST

_XYZ = ("x", "y", "z")


def add_box(scene: ST.Scene, low, high, ost_type: str | None = None, **names: str | None) -> ST.Scene:
    """Add a box by its corners, with ost_type, name, object_id and ddworks_type."""
    scene.obstacles.append({f"min_{a}": float(v) for a, v in zip(_XYZ, low, strict=True)} | {f"max_{a}": float(v) for a, v in zip(_XYZ, high, strict=True)} | {"ost_type": ost_type} | names)
    return scene


def add_task(scene: ST.Scene, start, goal, **names: str | None) -> ST.Scene:
    """Add a task by its end points, with utility, utility_group and more."""
    scene.tasks.append({f"s{a}": float(v) for a, v in zip(_XYZ, start, strict=True)} | {f"g{a}": float(v) for a, v in zip(_XYZ, goal, strict=True)} | names)
    scene.results.append(None)
    return scene


def move_task(scene: ST.Scene, n: int, start, goal) -> ST.Scene:
    """Give a task other end points; its result goes."""
    scene.tasks[n] |= {f"s{a}": float(v) for a, v in zip(_XYZ, start, strict=True)} | {f"g{a}": float(v) for a, v in zip(_XYZ, goal, strict=True)}
    scene.results[n] = None
    return scene


# The utilities and groups of the demo scene's five pipes.
_DEMO = (("UPW_S", "UPW"), ("NFW", "Waste Liquid"), ("PA", "Gas"), ("NW", "Water"), ("ACID", "Exhaust"))


def demo_scene() -> ST.Scene:
    """Five pipes that want the same way over a floor, on 120 x 120 x 60 cells of 50 mm."""
    scene = add_box(ST.Scene(50.0, shape=(120, 120, 60)), (0, 0, 0), (6000, 6000, 250), "OST_Floors")
    for utility, group in _DEMO:
        add_task(scene, (275, 3025, 1525), (5725, 3025, 1525), utility=utility, utility_group=group)
    return scene


def occupancy(scene: ST.Scene) -> R.Grid:
    """The grid of a scene's boxes; boxes without extent are left out."""
    out = R.Grid(scene.shape)
    for o in scene.obstacles:
        low, high = ([o[f"{e}_{a}"] for a in _XYZ] for e in ("min", "max"))
        a = [max(0, math.floor((x - w) / scene.cell_mm)) for x, w in zip(low, scene.origin, strict=True)]
        b = [min(n, math.ceil((x - w) / scene.cell_mm)) for x, w, n in zip(high, scene.origin, scene.shape, strict=True)]
        if all(x < y for x, y in zip(low, high, strict=True)) and all(x < y for x, y in zip(a, b, strict=True)):
            out.blocked[tuple(slice(x + 1, y + 1) for x, y in zip(a, b, strict=True))] = True
    return out


def _params(scene: ST.Scene) -> R.Params:
    given = {"cell_mm": scene.cell_mm} | {k: v for k, v in scene.params.items() if k in R.Params.__dataclass_fields__}
    return R.Params(**given | ({"connectivity": scene.params["clearance_connectivity"]} if "clearance_connectivity" in scene.params else {}))


def route_scene(scene: ST.Scene, mode: str = "multi", priority: str = "longest", trace: bool = False) -> ST.Scene:
    """The scene with results: each task by itself (single), in sequence (multi), or with rip-up.

    In sequence tasks and results are in the order of routing. trace: single routes keep the cells that the search expanded.
    """
    grid, params = occupancy(scene), _params(scene)
    cell = lambda t, e: tuple(math.floor((t[f"{e}{a}"] - o) / scene.cell_mm) for a, o in zip(_XYZ, scene.origin, strict=True))
    ends = lambda t: ([t[f"{e}{a}"] for a in _XYZ] for e in "sg")
    own = [R.Task(n, cell(t, "s"), cell(t, "g"), f"[{t.get('utility_group') or '?'}] {t.get('utility') or '?'}", math.dist(*ends(t))) for n, t in enumerate(scene.tasks)]
    began, seen = time.perf_counter(), {}
    if mode == "single":
        done = [(t, R.search_weighted(grid, t.start, t.goal, params, trace=seen.setdefault(t.key, []) if trace else None)) for t in own]
    elif mode in ("multi", "ripup"):
        done = (R.route_sequential if mode == "multi" else R.route_ripup)(grid, own, R.Plan(params, priority))
    else:
        raise ValueError(f"unknown mode {mode}")
    each = (time.perf_counter() - began) * 1000 / max(1, len(done))
    results = [ST.Result(r.success, r.length_mm, r.cost_mm, r.turns, r.expanded, each, r.path, seen.get(t.key)) for t, r in done]
    return ST.Scene(scene.cell_mm, scene.origin, scene.shape, scene.params, scene.obstacles, [scene.tasks[t.key] for t, _ in done], results)


def route_summary(r: R.Route | ST.Result) -> str:
    """One line about a route."""
    expanded = getattr(r, "expanded", None) if hasattr(r, "expanded") else r.expanded_nodes
    if not r.success:
        return f"no path, {expanded} expanded"
    return f"{len(r.path)} cells, {r.length_mm:.0f} mm long, cost {r.cost_mm:.0f} mm, {r.turns} turns, {expanded} expanded"


def scene_summary(scene: ST.Scene) -> str:
    """One line about a scene."""
    known = [r for r in scene.results if r is not None]
    blocked = int(occupancy(scene).blocked[1:-1, 1:-1, 1:-1].sum())
    return f"grid {scene.shape[0]} x {scene.shape[1]} x {scene.shape[2]} of {scene.cell_mm:.0f} mm, {len(scene.obstacles)} boxes in {blocked} cells, {len(scene.tasks)} tasks, {sum(r.success for r in known)} of {len(known)} routed"


def results_summary(scene: ST.Scene) -> str:
    """One line about all routes of a scene."""
    good = [r for r in scene.results if r is not None and r.success]
    return f"{len(good)} of {len(scene.tasks)} routed, {sum(r.length_mm for r in good):.0f} mm in all"


def main(given: list[str] | None = None) -> int:
    """demo, route and summary; prints summaries and writes scene text where --out says so."""
    parser = argparse.ArgumentParser(prog="pipegrid")
    verbs = parser.add_subparsers(dest="verb", required=True)
    demo, route, summary = (verbs.add_parser(v) for v in ("demo", "route", "summary"))
    for p in (route, summary):
        p.add_argument("--in", dest="source", required=True)
    for p in (demo, route):
        p.add_argument("--out")
    route.add_argument("--mode", choices=("multi", "single", "ripup"), default="multi")
    route.add_argument("--priority", default="longest")
    args = parser.parse_args(given)
    scene = demo_scene() if args.verb == "demo" else ST.loads(Path(args.source).read_text(encoding="utf-8"))
    print(scene_summary(scene))
    if args.verb != "summary":
        scene = route_scene(scene, getattr(args, "mode", "multi"), getattr(args, "priority", "longest"))
        print(results_summary(scene))
        if args.out:
            Path(args.out).write_text(ST.dumps(scene), encoding="utf-8", newline="\n")
    return 0
