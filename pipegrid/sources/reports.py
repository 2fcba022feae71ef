"""What a design comparison leaves behind: the detail table as CSV, and cells of results as plain rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.functions.scalars import CELL

#: The columns of the detail table, in order; fixed values.
DETAIL = ("guid", "group", "utility", "size", "straight_mm", "pr_len", "our_len", "len_ratio", "pr_bend", "our_turns", "pr_eff", "our_eff", "ok", "fail")


def validation_detail(routes: DataFrame) -> DataFrame:
    """The detail table as text: lengths without, ratios with four, efficiencies with three decimals, blank where a route failed.

    routes: guid, group, utility, size, straight_mm, pr_len, our_len, pr_bend, our_turns, pr_eff, our_eff, ok, fail.
    """
    shown = lambda c, places: F.format_string(f"%.{places}f", c)
    ok, blank = F.col("ok"), F.lit("")
    made = {c: shown(F.col(c), 0) for c in ("straight_mm", "pr_len", "our_len", "pr_bend")}
    made |= {
        "len_ratio": F.when(ok & (F.col("pr_len") > 0), shown(F.col("our_len") / F.col("pr_len"), 4)).otherwise(blank),
        "our_turns": F.col("our_turns").cast("string"), "pr_eff": shown(F.col("pr_eff"), 3), "our_eff": F.when(ok, shown(F.col("our_eff"), 3)).otherwise(blank), "ok": ok.cast("int").cast("string"),
    }
    return routes.select(*(made.get(c, F.coalesce(F.col(c), blank)).alias(c) for c in DETAIL))


def write_detail(routes: DataFrame, path: str) -> None:
    """The detail table as CSV with a header and the byte order mark, a file per partition."""
    validation_detail(routes).withColumnRenamed(DETAIL[0], "﻿" + DETAIL[0]).write.csv(path, header=True, emptyValue="")


def result_cells(results: DataFrame, column: str = "path") -> DataFrame:
    """task_id, pos, i, j and k of the cells in a column of results (path or visited), in order."""
    return results.select("task_id", F.posexplode(column).alias("pos", "c")).select("task_id", "pos", *(F.col(f"c.{x}").alias(x) for x in CELL))
