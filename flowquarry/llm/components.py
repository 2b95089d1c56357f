"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import discard, staged


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node long, label long`` for every end of an edge; nodes share a label exactly if they are connected.

    Random-mate contraction: each round every node joins the neighbour (or itself)
    of least random priority, edges are rewritten to the joined nodes, and loops
    and repeats go. The expected number of nodes falls by a constant factor a
    round whatever the shape, so chains take logarithmically many rounds. Every
    step is an aggregate or a join of plain tables, which the adaptive plan can
    split at a hot node; nothing reaches the driver but counts. Loops and rows
    with a null end are ignored; an empty table has no nodes.
    """
    pair = F.array_sort(F.array(F.col(a).cast("long"), F.col(b).cast("long")))
    links = edges.where(F.col(a) != F.col(b)).select(pair[0].alias("u"), pair[1].alias("v")).distinct()
    links = staged(links, "links")
    both = links.select("u").union(links.select("v"))
    labels = staged(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    step = 0
    while not links.isEmpty():
        step += 1

        def rank(c: str, salt: int = step) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("p"), F.col(c).alias("n"))

        seen = links.select("u", F.least(rank("u"), rank("v")).alias("m")).union(
            links.select("v", F.least(rank("u"), rank("v")).alias("m"))
        )
        joins = staged(seen.groupBy("u").agg(F.min("m")["n"].alias("to")), "joins")
        u, v = joins.toDF("u", "x"), joins.toDF("v", "y")
        moved = links.join(u, "u").join(v, "v").where("x != y")
        old = links, labels, joins
        links = staged(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
        labels = staged(
            labels.join(joins.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")),
            "labels",
        )
        discard(*old)
    discard(links)
    return labels


def spanning(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a small graph on 0 to n - 1: every node but the least of its component, and that one."""
    root = np.arange(n)
    while len(left):  # least label of the neighbours, then of the label, until nothing changes
        before = root.copy()
        np.minimum.at(root, left, before[right])
        np.minimum.at(root, right, before[left])
        root = root[root]
        if (root == before).all():
            break
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]
