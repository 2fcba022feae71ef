"""The registered routing queries search to the end, and rip-up has the reference's rounds and blockers."""

from __future__ import annotations

import pytest

from pipegrid.plans import registry, routes


class Planned(Exception):
    pass


@pytest.mark.parametrize("name", ["rt_single", "rt_independent", "rt_tube", "rt_sequential", "rt_ripup", "rt_subset", "rt_metrics", "rt_polylines", "compare_by_group"])
def test_no_route_is_given_up(spark, monkeypatch, name):
    def planned(tasks, cells, shape, plan, *args, **more):
        raise Planned(plan)

    monkeypatch.setattr(routes, "route_scenes", planned)
    with pytest.raises(Planned) as told:
        registry.queries()[name](spark, "/root/testdata/sf0.001")
    (plan,) = told.value.args
    assert plan.most is None
    if name == "rt_ripup":
        assert (plan.rounds, plan.most_blockers) == (10, 4)
