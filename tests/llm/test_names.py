"""The registered training-data queries are the ten operators."""

from __future__ import annotations

import __spark_entry__
from pipegrid.llm import queries


def test_the_ten_operators():
    named = sorted(queries.queries(), key=lambda x: int(x[2:].split("_")[0]))
    assert [x.split("_")[0] for x in named] == [f"op{n}" for n in range(1, 11)]
    assert {x for x in __spark_entry__.queries() if x.startswith(("op", "pipe"))} == {*named, "pipeline"}
