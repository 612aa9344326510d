"""Iterative operators on pair tables: components and the lexicographically first independent set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut, ship

#: Edges that one task contracts (16 MB of ids): fewer jobs, whose plans and threads are what fills the driver.
FEW_EDGES = 1 << 20


def _ends(batches):
    """``a, m``: the smallest node of each node's component, of all edges of one task."""
    batches = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not batches:
        return
    a, b = (np.concatenate(x) for x in zip(*batches, strict=True))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    (x, y), label = np.split(at, 2), np.arange(len(ids))
    while True:
        new, p, q = label.copy(), label[x], label[y]
        np.minimum.at(new, p, q)
        np.minimum.at(new, q, p)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["a", "m"])


def min_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64, few: int = FEW_EDGES) -> DataFrame:
    """``id, label``: the smallest id of each component. ``edges``: ``a, b`` (bigint) in both directions.

    In each round every node hooks to its least neighbour if that is smaller; hooks are followed to their ends and
    the edges contracted to these, so that a round works on what the one before has left. Ends are local minima, so
    the last end of a component is its smallest id. Once ``few`` edges are left, one task contracts them to the end.
    """
    labels = nodes.select("id", F.col("id").alias("label"))
    e = cut(edges.where("a <> b").select("a", "b"))
    for _ in range(max_rounds):
        left = e.count()
        if not left:
            return cut(labels)
        if left <= few:
            ship(e.sparkSession)
            to = e.coalesce(1).select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_ends, "a bigint, m bigint").where("a <> m")
            to = to.withColumnRenamed("a", "label")
            return cut(labels.join(to, "label", "left").select("id", F.coalesce("m", "label").alias("label")))
        hook = cut(e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        for _ in range(max_rounds):
            step = lambda d: d.join(hook.select(F.col("a").alias("__a"), F.col("m").alias("__m")), F.col("m") == F.col("__a")).select("a", F.col("__m").alias("m"), "was")  # noqa: B023, E731
            hook = cut(step(step(step(hook.withColumn("was", F.col("m"))))))  # four times as far
            moved = not hook.where("m <> was").isEmpty()
            hook = hook.select("a", "m")
            if not moved:
                break
        else:
            raise RuntimeError(f"hooks did not end in {max_rounds} rounds")
        e = e.join(hook, "a").select(F.col("m").alias("__m"), F.col("b").alias("a")).join(hook, "a").select(F.col("__m").alias("a"), F.col("m").alias("b"))
        e = cut(e.where("a <> b").distinct())
        to = hook.where("a <> m").select(F.col("a").alias("label"), "m")
        labels = cut(labels.join(to, "label", "left").select("id", F.coalesce("m", "label").alias("label")))
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def first_independent_set(nodes: DataFrame, conflicts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``id`` of what a sequential pass in order of (``priority``, ``id``) would select.

    ``nodes``: ``id, priority``; ``conflicts``: ``a, b`` in both directions. In each round every live node that comes before all its
    live neighbours is selected and its neighbours go, which gives the sequential result for the same priorities.
    """
    order = lambda p, i: F.struct(F.col(p), F.col(i))
    live = cut(nodes.select("id", "priority"))
    e = conflicts.where("a <> b").join(live.select(F.col("id").alias("a"), F.col("priority").alias("pa")), "a")
    e = cut(e.join(live.select(F.col("id").alias("b"), F.col("priority").alias("pb")), "b"))
    chosen = None
    for _ in range(max_rounds):
        beaten = e.where(order("pb", "b") < order("pa", "a")).select(F.col("a").alias("id")).distinct()
        win = cut(live.join(beaten, "id", "left_anti").select("id"))
        chosen = win if chosen is None else chosen.unionByName(win)
        gone = e.join(win.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).union(win).distinct()
        live = cut(live.join(gone, "id", "left_anti"))
        if not live.limit(1).count():
            return chosen
        e = e.join(live.select(F.col("id").alias("a")), "a", "left_semi").join(live.select(F.col("id").alias("b")), "b", "left_semi")
        e = cut(e)
    raise RuntimeError(f"thinning did not settle in {max_rounds} rounds")
