"""Connected components of an edge table by alternating large and small stars, never on the driver; and what the
similarity joins share: units of work of bounded size, spanning forests, and counts and groups per row.

Every round pre-aggregates the smallest neighbour of each node before the shuffle and joins it back from a
materialised table, so that a node with a third of all edges is split like any skewed join. Rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, shuffle_partitions


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of an edge between different nodes; root is the smallest node reachable.

    Nulls and loops are no edges; an empty table gives an empty table; repeated edges do no harm.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v")
    e = cut(e.distinct())
    was = _signature(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = cut(both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _signature(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(e.select("v", "v").distinct())


def forest(m: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join different trees: a spanning forest of the links."""
    up = list(range(m))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def runs_of(batches, keys: int):
    """Whole runs of rows with equal leading key columns, from sorted batches."""
    held: list[pa.RecordBatch] = []

    def key_of(b, r):
        return tuple(b.column(k)[r].as_py() for k in range(keys))

    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        at = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for x, y in zip(at, at[1:], strict=False):
            part = b.slice(x, y - x)
            if held and key_of(held[0], 0) != key_of(part, 0):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def unit_rows(members: DataFrame, group: str, node: str, block: int) -> DataFrame:
    """``unit, side`` and the columns of ``members``: each row once for a small group; for a group of more than
    ``block`` rows once for every pair of blocks that its block is in. ``unit`` is a string that sorts by group."""
    counts = members.groupBy(group).agg(F.count("*").alias("__n"))
    counts = cut(counts.select(F.col(group).alias("__g"), F.ceil(F.col("__n") / block).cast("int").alias("__blocks")))
    d = members.join(counts, F.col(group) == F.col("__g")).drop("__g")
    d = d.withColumn("__block", F.pmod(F.xxhash64(node), F.col("__blocks")).cast("int"))
    d = d.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    lo, hi = F.least("__block", "__other"), F.greatest("__block", "__other")
    unit = F.concat_ws(":", F.col(group).cast("string"), lo, hi)
    side = F.when(lo == hi, F.lit(-1)).otherwise(F.when(F.col("__block") == lo, 0).otherwise(1))
    return d.select(unit.alias("unit"), side.cast("int").alias("side"), *members.columns)


def spread(units: DataFrame) -> DataFrame:
    """Whole units to tasks of even size: by ranges of a hash of the unit, sorted."""
    p = max(shuffle_partitions(units.sparkSession), 8)
    d = units.withColumn("__u", F.xxhash64("unit"))
    return d.repartitionByRange(p, "__u", "unit").sortWithinPartitions("__u", "unit").drop("__u")


def settle(rows: DataFrame, id_col: str, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with a class ``h1``, null for none) and ``n_links``, ``component_id``, ``group_id``, ``kept``.

    ``group_id`` is the smallest class of the group, null without a class; it tells groups apart whose ids are all null.

    ``classes``: ``h1, rep`` (smallest id), ``n`` (rows). ``found``: ``h1, links`` rows with the rows of linked
    classes, to be summed, and ``h1, other`` rows, a forest of the links.
    """
    trees = components(found.where("other is not null"), "h1", "other")
    links = found.where("links is not null").groupBy("h1").agg(F.sum("links").alias("links"))
    c = classes.join(links, "h1", "left").join(trees.withColumnRenamed("node", "h1"), "h1", "left")
    c = cut(c.select("h1", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "h1").alias("root")))
    least = cut(c.groupBy("root").agg(F.min("rep").alias("component_id")))
    c = cut(c.join(least, "root").select("h1", "n_links", "component_id", F.col("root").alias("group_id")))  # a plain table: a hot class is split
    some = rows.where("h1 is not null").join(c, "h1")
    none = rows.where("h1 is null").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col(id_col)).withColumn("group_id", F.lit(None).cast("long"))
    out = some.select(*none.columns).unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col(id_col).eqNullSafe(F.col("component_id")), F.lit(False)))
