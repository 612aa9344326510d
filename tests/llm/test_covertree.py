import math
from collections import defaultdict

import numpy as np
import pytest

from cinderlake.llm import covertree

from .test_jaccard import closure

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    links, pairs = defaultdict(int), []
    good = {}
    for k, (_, e, label) in enumerate(rows):
        if label is None or not e or any(v is None or not math.isfinite(v) for v in e) or not any(e):
            continue
        x = np.array(e, np.float32).astype(float)
        good[k] = (label, x / np.sqrt((x * x).sum()))
    ks = sorted(good)
    for a in ks:
        for b in ks:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and float((good[a][1] * good[b][1]).sum()) >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    group, by = closure(range(len(rows)), pairs), defaultdict(list)
    for k, r in enumerate(rows):
        by[group[k]].append(r[0])
    return sorted((str(r[0]), links[k], str(min((x for x in by[group[k]] if x is not None), default=None))) for k, r in enumerate(rows))


def compare(spark, rows, **how):
    got = covertree.near_dedup(spark.createDataFrame(rows, SCHEMA), **how).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [16, 1024])
def test_clusters_and_odd_vectors(spark, block):
    r = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        c = r.normal(size=8)
        for _ in range(20):
            rows.append((len(rows) * 7 % 1009, (c + r.normal(size=8) * r.choice([0.0, 0.05, 0.2, 0.4])).astype(np.float32).tolist(), int(r.integers(0, 2))))
    v = rows[0][1]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 8, 0), (2003, [math.nan] + v[1:], 0), (2004, [math.inf] + v[1:], 0), (2005, [None] + v[1:], 0), (2006, v, None), (None, v, 0), (2007, [x * 2 for x in v], 0), (2007, v, 0), (2008, v[:4], 0)]
    compare(spark, rows, block=block)


def test_embeddings(spark):
    compare(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()], block=40)


def test_empty(spark):
    assert covertree.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_covers_and_nests():
    x = np.random.default_rng(1).normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = covertree.CoverTree(x)
    for k in range(len(t.center)):
        own = t.order[t.begin[k] : t.end[k]]
        assert t.center[k] in own
        assert np.linalg.norm(x[own] - x[t.center[k]], axis=1).max() <= t.radius[k] + 1e-6
        if t.first[k] < t.last[k]:
            kids = range(t.first[k], t.last[k])
            assert t.center[k] in t.center[list(kids)]
            assert sorted(np.concatenate([t.order[t.begin[c] : t.end[c]] for c in kids])) == sorted(own)


def test_children_lie_apart_and_pruning_saves_distances():
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(40, 16)), 25, axis=0) + r.normal(size=(1000, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t, level = covertree.CoverTree(x), {0: 2.0}
    for k in range(len(t.center)):
        kids = np.arange(t.first[k], t.last[k])
        level |= {c: level[k] / 2 for c in kids.tolist()}
        if len(kids) > 1:
            gap = 2 - 2 * x[t.center[kids]] @ x[t.center[kids]].T
            assert np.sqrt(gap[np.triu_indices(len(kids), 1)].min()) > level[k] / 2 - 1e-7
    seen = []
    i, j = covertree.dual_pairs(t, t, 0.93, True, seen=seen)
    g = np.triu(x @ x.T, 1)
    assert {*zip(i.tolist(), j.tolist())} == {*zip(*(v.tolist() for v in np.nonzero(g >= 0.93)))}
    assert sum(seen) < 0.25 * len(x) ** 2


def test_huge_and_tiny_vectors_link(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 0.0], 0), (4, [1e-200, 0.0], 0), (5, [1.0, 0.0], 0), (6, [3e-320, 3e-320], 0), (7, [1.7e308, 1.7e308], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 6: (3, 1), 7: (3, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3)}


def test_clashing_columns_and_string_ids(spark):
    rows = [("a", [1.0, 0.0], 0), ("b", [1.0, 0.01], 0), (None, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int").selectExpr("*", "1 as h1", "2 as grp", "3 as vec", "4 as n_links", "5 as cell")
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in covertree.near_dedup(df).collect()) == [("None", 0, "None"), ("a", 1, "a"), ("b", 1, "a")]
