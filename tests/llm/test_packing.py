"""Room that a run of sequences leaves is offered again whatever the run's length."""

from __future__ import annotations

from pipegrid.llm import packing


def test_as_many_sequences_as_room():
    slots = packing.plan({1500: 2048, 500: 2048}, 2048)
    assert {k: v.tolist() for k, v in slots.items()} == {1500: [[0, 0, 1, 0]], 500: [[0, 0, 1, 1500]]}
