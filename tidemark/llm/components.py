"""Connected components of a distributed edge list by hash-min contraction.

Each round every node takes the smallest of itself and its neighbours as parent,
follows parents twice, and edges are contracted to parents.  Only edges that still
join different nodes survive a round, so the work falls geometrically and nothing
goes to the driver but counts.  Minima are map-side combined; a node with very many
neighbours is a row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import drop, is_empty, materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) -> (node, component): the smallest node reachable; nodes without an edge to another are absent."""
    live = materialize(edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    kind = live.schema["u"].dataType.simpleString()
    label = None
    while not is_empty(live):
        ends = live.select(F.col("u").alias("node"), F.col("v").alias("other")).union(live.select("v", "u"))
        parent = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("parent"))
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = materialize(parent.join(up, "parent").select("node", F.col("grand").alias("parent")), "parents")
        a, b = (jumped.select(F.col("node").alias(x), F.col("parent").alias(f"{x}p")) for x in ("u", "v"))
        nxt = materialize(live.join(a, "u").join(b, "v").where("up != vp").select(F.least("up", "vp").alias("u"), F.greatest("up", "vp").alias("v")).distinct(), "edges")
        if label is None:
            label = jumped.select("node", F.col("parent").alias("component"))
        else:
            step = jumped.select(F.col("node").alias("component"), F.col("parent").alias("next"))
            old = label
            label = materialize(old.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
        drop(live)
        live = nxt
    return label if label is not None else live.select(F.col("u").cast(kind).alias("node"), F.col("v").alias("component"))
