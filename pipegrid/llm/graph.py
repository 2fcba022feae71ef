"""Connected components of links in a logarithmic number of rounds.

Every partition first replaces its own links by a spanning forest (union-find over at most about ``share`` links, each node
linked with its component's root), which keeps what is connected and drops all cycles. If that was the only partition, the
forest is the answer. Otherwise each node picks its smallest link in one total order of links (Boruvka's rule, so that at
least half of the labels go), pointers are doubled until all end at a root, and the links between different roots are the next
round's smaller graph. Every round is written to the shared folder and read back, so that plans and size estimates start afresh.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.common import stored

_SHARE = 100_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b) but the roots, and its root, the smallest node that it is connected with."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # hook the larger root under the smaller one, then shorten all paths fully
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forest(batches):
    got = [(np.asarray(x.column("a"), np.int64), np.asarray(x.column("b"), np.int64)) for x in batches]
    if got:
        a, b = forest(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _tidy(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")


def _hooked(edges: DataFrame) -> DataFrame:
    """node and up, the root of the tree of chosen links that the node lies in, for every node of edges (a, b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = F.min(F.struct(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))).alias("link")
    picked = both.groupBy(F.col("a").alias("node")).agg(least)
    up = stored(picked.select("node", F.when(F.col("node") == F.col("link.low"), F.col("link.high")).otherwise(F.col("link.low")).alias("up")))
    # links are totally ordered, so the only circles are two nodes that picked the same link: the smaller is the root
    above = lambda t: t.select(F.col("node").alias("up"), F.col("up").alias("top"))
    up = stored(up.join(above(up), "up").select("node", F.when((F.col("top") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up")))
    while True:
        further = stored(up.join(above(up), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        up = further.select("node", "up")
        if further.where("moved").isEmpty():
            return up


def components(links: DataFrame, share: int = _SHARE) -> DataFrame:
    """node and label for every node of links (a, b); a component's nodes share one label, one of its nodes.

    Null and circular links have no effect. share: the links that one task gets at once.
    """
    edges = stored(_tidy(links))
    label = None
    while True:
        parts = 1 + edges.count() // share
        edges = stored(edges.repartition(parts).mapInArrow(_forest, "a long, b long"))
        up = edges if parts == 1 else _hooked(stored(edges.distinct()))
        up = up.toDF("node", "up")
        if label is None:
            label = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
        label = label.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        label = stored(label)
        if parts == 1:
            return label
        for c in ("a", "b"):
            edges = edges.join(up.withColumnRenamed("node", c), c).drop(c).withColumnRenamed("up", c)
        edges = stored(_tidy(edges))
