"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are compared inside their label (and dimension) by cosine in double precision. On unit vectors the cosine
limit is a distance limit r, and a pair of tree nodes can only hold linked vectors if the distance of their centres
is at most the sum of their covering radii plus r; every other pair of nodes is pruned whole.

Equal vectors of a label are one class. The top level of the tree is distributed: classes of a large label go to the
nearest of a bounded number of pivots, and two cells meet only if their covering radii allow a link. Cells are cut
into blocks of at most about ``block`` classes, two blocks are a unit of work, and in each unit both blocks get a
cover tree (nested levels, radii halving) that is traversed in pairs. No pair of rows is ever emitted: units return
link counts and a spanning forest.

Defined results: a null label, a null or empty vector, a zero vector, or one with a null or non-finite component links
with nothing; null ids take part and rank after every other id; repeated rows are separate vectors; an empty table
gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, require
from .components import forest, runs_of, settle, spread

THRESHOLD, BLOCK = 0.93, 1024
#: Pivots of one label and labels with pivots, at most: 2 MB of pivots at 64 dimensions. Other labels have one cell.
PIVOTS, PIVOT_LABELS = 64, 64
#: Vectors among which a node's next centres are sought at a time; children of two nodes from which their distances are one product.
CENTERS, WIDE = 64, 4096


class CoverTree:
    """Cover tree over unit vectors: ``center``, ``radius`` (largest distance to a descendant) and children of each node.

    Levels have radii 2, 1, 1/2, ...; a node's centre is among its children's (nesting), its children lie further apart than their
    level's radius and cover what is below. A node of one vector, or of vectors closer than ``least``, is a leaf.
    """

    def __init__(self, x: np.ndarray, least: float = 1e-3):
        self.x, self.order = x, np.arange(len(x))
        center, radius, first, last, begin, end = [0], [0.0], [0], [0], [0], [len(x)]
        todo, level = [0], 2.0
        while todo:
            down = []
            limit = 1 - level * level / 8  # cosine at half the level's radius
            for node in todo:
                at = self.order[begin[node] : end[node]]
                if len(at) == 1:
                    continue
                g = x[at] @ x[center[node]]
                radius[node] = math.sqrt(max(0.0, 2 - 2 * float(g.min())))
                if radius[node] <= least:
                    continue
                first[node] = len(center)
                near = (g >= limit) | (at == center[node])
                parts, rest = [at[near]], at[~near]
                center.append(center[node])
                while len(rest):  # the next centres are sought among some vectors at a time
                    some = rest[:CENTERS]
                    g = x[rest] @ x[some].T
                    owner = np.full(len(rest), -1)
                    for k, c in enumerate(some):
                        if owner[k] < 0:
                            owner[(owner < 0) & (g[:, k] >= limit)] = k
                            owner[k] = k
                            center.append(int(c))
                    parts += [rest[owner == k] for k in np.unique(owner[owner >= 0])]
                    rest = rest[owner < 0]
                last[node] = len(center)
                a = begin[node]
                for p in parts:
                    begin.append(a)
                    a += len(p)
                    end.append(a)
                    radius.append(0.0), first.append(0), last.append(0)
                self.order[begin[node] : end[node]] = np.concatenate(parts)
                down += range(first[node], last[node])
            todo, level = down, level / 2
        self.center, self.radius = np.array(center), np.array(radius)
        self.first, self.last, self.begin, self.end = (np.array(v) for v in (first, last, begin, end))


def _expand(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of a with every number of its range."""
    n = hi - lo
    who = np.repeat(np.arange(len(a)), n)
    return who, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[who]


def _grid(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every number of a's k-th range with every number of b's k-th range, for all k."""
    w, i = _expand(a[0], *a)
    v, j = _expand(w, b[0][w], b[1][w])
    return i[v], j


def dual_pairs(s: CoverTree, t: CoverTree, threshold: float, same: bool, most: int = 1 << 18, seen: list[int] | None = None):
    """(i, j) of vectors of s and t with cosine at or above the threshold; i < j if both are the same tree.

    Only pairs of nodes whose parents were not pruned are measured; ``seen`` is told how many distances that took."""
    r = math.sqrt(2 - 2 * threshold) + 1e-9
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen = [] if seen is None else seen

    def dots(i, j):
        seen.append(len(i))
        parts = [np.einsum("ij,ij->i", s.x[i[k : k + 65536]], t.x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def close(a, b, g):
        return np.sqrt(np.maximum(0, 2 - 2 * g)) <= s.radius[a] + t.radius[b] + r + 1e-7

    def children(tree, nodes):
        """The nodes below, or the node itself if it is a leaf."""
        leaf = tree.first[nodes] == tree.last[nodes]
        return np.where(leaf, nodes, tree.first[nodes]), np.where(leaf, nodes + 1, tree.last[nodes])

    def ordered(x, y):
        """In one tree a pair of nodes is looked at once, the one whose vectors lie first in front."""
        if same:
            ok = s.begin[x] <= s.begin[y]
            return x[ok], y[ok]
        return x, y

    zero = np.zeros(1, int)
    todo = [(zero, zero)]
    while todo:
        a, b = todo.pop()
        if len(a) > most:
            h = len(a) // 2
            todo += [(a[:h], b[:h]), (a[h:], b[h:])]
            continue
        done = (s.first[a] == s.last[a]) & (t.first[b] == t.last[b])
        if done.any():
            i, j = _grid((s.begin[a[done]], s.end[a[done]]), (t.begin[b[done]], t.end[b[done]]))
            if same:  # leaves are runs of the order, so this is each pair once
                i, j = i[i < j], j[i < j]
            i, j = s.order[i], t.order[j]
            g = dots(i, j)
            ok = g >= threshold - 1e-12
            out.append((i[ok], j[ok], g[ok]))
        a, b = a[~done], b[~done]
        (al, ah), (bl, bh) = children(s, a), children(t, b)
        wide = (ah - al) * (bh - bl) >= WIDE
        for k in np.flatnonzero(wide):  # many children each: one product of two matrices
            for lo in range(al[k], ah[k], 128):
                x, y = np.arange(lo, min(lo + 128, ah[k])), np.arange(max(lo, bl[k]) if same and a[k] == b[k] else bl[k], bh[k])
                g = s.x[s.center[x]] @ t.x[t.center[y]].T
                seen.append(g.size)
                u, v = np.nonzero(close(x[:, None], y[None, :], g))
                todo.append(ordered(x[u], y[v]))
        for k in range(0, len(a), 1 << 14):
            n = np.flatnonzero(~wide[k : k + (1 << 14)]) + k
            if len(n):
                x, y = ordered(*_grid((al[n], ah[n]), (bl[n], bh[n])))
                ok = close(x, y, dots(s.center[x], t.center[y]))
                todo.append((x[ok], y[ok]))
    i, j, g = (np.concatenate(v) if v else np.zeros(0, int) for v in (list(c) for c in zip(*out, strict=True))) if out else (np.zeros(0, int),) * 3
    edge = np.abs(g - threshold) < 1e-12  # a tie with the limit is decided by a plain double sum
    if edge.any():
        keep = np.ones(len(i), bool)
        keep[edge] = [float(np.sum(s.x[p] * t.x[q])) >= threshold for p, q in zip(i[edge], j[edge], strict=True)]
        i, j = i[keep], j[keep]
    return (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, grp, vec``: the vector as little-endian doubles and its label with dimension; nulls if it links with nothing."""
    src = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    schema = f"vec_id {src.schema['vec_id'].dataType.simpleString()}, grp string, vec binary"

    def run(batches):
        for b in batches:
            vec, grp = [], []
            for e, label in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                good = label is not None and e.is_valid and len(e.values) and not e.values.null_count
                if good:
                    x = e.values.to_numpy()
                    good = np.isfinite(x).all() and x.any()
                if good:  # scaled by a power of two, which is exact, so that no square over- or underflows
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
                vec.append(np.ascontiguousarray(x).tobytes() if good else None)
                grp.append(f"{label}/{len(x)}" if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grp, pa.string()), pa.array(vec, pa.binary())], ["vec_id", "grp", "vec"])

    return src.mapInArrow(run, schema)


def cells(classes: DataFrame, block: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(classes with ``cell``; ``grp, cell, other`` for every two cells that may hold a link, both ways and with itself)."""
    spark = classes.sparkSession
    counts = classes.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") > block)
    big = counts.orderBy(F.desc("size"), "grp").limit(PIVOT_LABELS)
    # about 2 x PIVOTS rows of each large label, by hash; the first PIVOTS of them are the pivots
    some = classes.join(F.broadcast(big), "grp").where(F.pmod(F.xxhash64("h1", F.lit(3)), F.col("size")) < F.least(F.lit(2 * PIVOTS), 2 * F.ceil(F.col("size") / block)))
    picked: dict[str, list] = {}
    for row in some.select("grp", "h1", "vec", "size").collect():
        picked.setdefault(row.grp, []).append((row.h1, bytes(row.vec), row.size))
    pivots = {g: _unit([v for _, v, _ in sorted(p)[: min(PIVOTS, math.ceil(p[0][2] / block))]]) for g, p in picked.items()}

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index
            grp, vec = b.column(at("grp")).to_pylist(), b.column(at("vec"))
            cell, dist = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for g in set(grp) & pivots.keys():
                k = np.array([i for i, x in enumerate(grp) if x == g])
                c = _unit([vec[int(i)].as_py() for i in k]) @ pivots[g].T
                cell[k] = c.argmax(axis=1)
                dist[k] = np.sqrt(np.maximum(0, 2 - 2 * c.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], [*b.schema.names, "cell", "dist"])

    spec = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    d = cut(classes.mapInArrow(run, f"{spec}, cell int, dist double"))
    radius = {(r.grp, r.cell): r.radius for r in d.where("cell >= 0").groupBy("grp", "cell").agg(F.max("dist").alias("radius")).collect()}  # at most one per pivot
    r = math.sqrt(2 - 2 * threshold) + 1e-6
    meet = []
    for g, p in pivots.items():
        gap = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))
        have = sorted(c for x, c in radius if x == g)
        meet += [(g, a, b) for a in have for b in have if a == b or gap[a, b] <= radius[g, a] + radius[g, b] + r]
    pairs = spark.createDataFrame(meet, "grp string, cell int, other int")
    alone = d.where("cell < 0").select("grp", "cell").distinct().withColumn("other", F.col("cell"))
    return d.drop("dist"), pairs.unionByName(alone)


def unit_table(d: DataFrame, meet: DataFrame, block: int) -> DataFrame:
    """``unit, side, h1, n, vec``: each class once for every block that its block has to meet."""
    blocks = cut(d.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    theirs = blocks.select("grp", F.col("cell").alias("other"), F.col("blocks").alias("others"))
    table = cut(meet.join(theirs, ["grp", "other"]).join(blocks, ["grp", "cell"]).groupBy("grp", "cell", "blocks").agg(F.collect_list(F.struct("other", "others")).alias("meets")))
    e = d.join(table, ["grp", "cell"])
    e = e.withColumn("mine", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    e = e.withColumn("o", F.explode("meets")).withColumn("their", F.explode(F.sequence(F.lit(0), F.col("o.others") - 1)))
    me, it = F.struct(F.col("cell").alias("c"), F.col("mine").alias("b")), F.struct(F.col("o.other").alias("c"), F.col("their").alias("b"))
    lo, hi = F.least(me, it), F.greatest(me, it)
    unit = F.concat_ws(":", "grp", lo["c"], lo["b"], hi["c"], hi["b"])
    side = F.when(lo == hi, F.lit(-1)).when(me == lo, F.lit(0)).otherwise(F.lit(1))
    return e.select(unit.alias("unit"), side.cast("int").alias("side"), "h1", "n", "vec")


def link_units(units: DataFrame, threshold: float) -> DataFrame:
    """``h1, links`` and ``h1, other`` rows from whole units."""

    def run(batches):
        for t in runs_of(batches, 1):
            side, h, n = (t.column(c).to_numpy() for c in ("side", "h1", "n"))
            if len(h) < 2:
                continue
            x = _unit(t.column("vec").to_pylist())
            if side[0] < 0:
                tree = CoverTree(x)
                i, j = dual_pairs(tree, tree, threshold, True)
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if not len(left) or not len(right):
                    continue
                i, j = dual_pairs(CoverTree(x[left]), CoverTree(x[right]), threshold, False)
                i, j = left[i], right[j]
            if not len(i):
                continue
            links = np.bincount(i, n[j], len(h)) + np.bincount(j, n[i], len(h))
            some = np.flatnonzero(links)
            joins = np.array(forest(len(h), i, j)).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h[some], h[joins[:, 0]]])), pa.array([*links[some].astype(np.int64).tolist(), *[None] * len(joins)], pa.int64()), pa.array([*[None] * len(some), *h[joins[:, 1]].tolist()], pa.int64())],
                ["h1", "links", "other"],
            )

    return spread(units).select("unit", "side", "h1", "n", "vec").mapInArrow(run, "h1 bigint, links bigint, other bigint")


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per vector ``vec_id, n_links, component_id, kept``: other vectors of its label at or above the cosine limit,
    the smallest vec_id reachable by links, and whether that is its own."""
    require(vectors, "vec_id", "embedding", "label")
    rows = cut(usable(vectors).withColumn("h1", F.when(F.col("vec").isNotNull(), F.xxhash64("grp", "vec"))))
    classes = cut(rows.where("h1 is not null").groupBy("h1", "grp", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    d, meet = cells(classes.select("h1", "grp", "vec", "n"), block, threshold)
    found = cut(link_units(unit_table(d, meet, block), threshold))
    return settle(rows.select("vec_id", "h1"), "vec_id", classes.select("h1", "rep", "n"), found).select("vec_id", "n_links", "component_id", "kept")
