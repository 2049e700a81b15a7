"""Connected components of an edge table, by contraction rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.storage import stored


def _hooked(edges: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour or itself; three pointer jumps shorten chains."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    parent = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("p"))
    parent = stored(parent, "cc-parent")
    for _ in range(3):
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = parent.join(up, "p").select("node", F.col("pp").alias("p"))
    return stored(parent, "cc-jumped")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge; component is the smallest node reached.

    Every round hooks each node to its smallest neighbour, contracts, and keeps only edges between
    different contracted nodes, so the edge table shrinks geometrically and no node's neighbours are
    ever gathered in one task. Null end points, self loops and repeated edges are ignored; an empty
    table gives an empty result.
    """
    e = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"))
    e = stored(e.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "cc-edges")
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        parent = _hooked(e)
        if labels is None:
            labels = parent.select("node", F.col("p").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), "p")
            labels = labels.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            labels = stored(labels, "cc-labels")
        pu = parent.select(F.col("node").alias("u"), F.col("p").alias("pu"))
        pv = parent.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        e = e.join(pu, "u").join(pv, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        e = stored(e.filter("u <> v").distinct(), "cc-edges")
    else:
        raise RuntimeError("components did not converge")
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
