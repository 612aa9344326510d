import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from cinderlake.llm import components, jaccard

from .helpers import awkward, frame

SF = "/root/testdata/sf0.01"


def closure(ids, pairs):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def brute(rows, n=5, threshold=0.8):
    """By position in rows: number of links and members of the group."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links, pairs = defaultdict(int), []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            k = len(sets[a] & sets[b])
            if k and k >= threshold * (len(sets[a]) + len(sets[b]) - k) - 1e-9:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    return links, closure(range(len(rows)), pairs)


def compare(spark, rows, **how):
    links, group = brute(rows)
    by = defaultdict(list)
    for i in range(len(rows)):
        by[group[i]].append(rows[i][0])
    want = sorted((str(rows[i][0]), links[i], str(min((x for x in by[group[i]] if x is not None), default=None))) for i in range(len(rows)))
    got = jaccard.jaccard_join(frame(spark, rows), **how).collect()
    assert sorted((str(r.doc_id), r.n_links, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_awkward(spark):
    compare(spark, awkward())
    assert jaccard.jaccard_join(frame(spark, [])).count() == 0


def test_large_group_in_blocks(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # near copies at every distance, so that links are partial and chains occur
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(120)] = f"x{r.randrange(1000)}"
        rows.append((i * 3 % 61, " ".join(w), "en", "a", 1))
    rows += [(100 + i, rows[i % 4][1], "en", "b", 1) for i in range(20)]
    rows += [(200 + i, " ".join(f"y{r.randrange(10**6)}" for _ in range(80)), "en", "c", 1) for i in range(20)]
    compare(spark, rows, block=7)


def test_documents(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.doc_id % 2 == 0]
    compare(spark, docs)


def test_many_rows_without_an_id(spark):
    """Sets are made once a class in each task, not once for every row that shares the null id."""
    r = random.Random(11)
    base = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(10)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "other"]) for b in base] + [" ".join(f"y{r.randrange(10**6)}" for _ in range(30)) for _ in range(480)]
    rows = [(None, texts[i % 500], "en", "a", 1) for i in range(5000)]
    docs = frame(spark, rows)
    got = jaccard.jaccard_join(docs).collect()
    assert len(got) == 5000 and sorted(Counter(r.n_links for r in got).items()) == [(9, 4800), (19, 200)]
    assert jaccard.keep_one(docs).count() == 490
    wanted = docs.select(F.lit(None).cast("long").alias("rep"), F.xxhash64("text").alias("rep_text"), F.lit(0).cast("long").alias("root"), F.lit(10).cast("long").alias("n"), "text").distinct()
    h = jaccard.signatures(docs.distinct()).select("h1", F.col("text_hash").alias("rep_text")).distinct()
    assert jaccard.gram_sets(docs.coalesce(1), wanted.join(h, "rep_text").drop("text").coalesce(1)).count() <= 500 * 8


def test_recall_of_the_banding():
    b = jaccard.bands_for()
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (None, 3), (7, 7)]])
def test_components(spark, edges):
    e = spark.createDataFrame(edges, "a bigint, b bigint")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = closure({x for p in real for x in p}, real)
    assert {r.node: r.root for r in components.components(e).collect()} == want
