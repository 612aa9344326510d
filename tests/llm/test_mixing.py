import hashlib
from collections import defaultdict

import pytest

from cinderlake.llm import mixing

from .helpers import awkward, frame, words

SF = "/root/testdata/sf0.01"


def water(sizes, repeats=3):
    """Targets by repeated resharing, as the text of the rule says."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= repeats * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = repeats * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return out


def brute(rows, repeats=3):
    key = lambda d, t: hashlib.md5(f"{'' if d is None else d}:0:{t or ''}".encode()).hexdigest()
    docs = [(d, s, len(words(t)), key(d, t)) for d, t, _, s, _ in rows]
    sizes = defaultdict(int)
    for _, s, n, _ in docs:
        sizes[s] += n
    target = water(sizes, repeats)
    queue, cum, seen = [], defaultdict(int), defaultdict(int)
    for d, s, n, by in sorted(docs, key=lambda x: (x[3], x[2])):
        cum[s] += n
        seen[s, d] += 1
        for k in range(repeats):
            if n:
                queue.append(((cum[s] + k * sizes[s]) / target[s], s is None, s or "", by, seen[s, d], k, d, n))
    queue.sort()
    taken, total = defaultdict(int), 0
    for *_, d, n in queue:
        if total >= sum(sizes.values()):
            break
        total += n
        taken[d] += n
    return {d: (taken[d], sizes[s], target[s]) for d, s, *_ in docs}


@pytest.mark.parametrize("source", ["awkward", "sf"])
def test_equals_sequential_queue(spark, source):
    docs = frame(spark, awkward()) if source == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = brute(rows)
    got = defaultdict(int)
    result = mixing.mix(docs).collect()
    assert len(result) == len(rows)
    for r in result:
        got[r.doc_id] += r.taken
        assert r.taken <= 3 * r.size
        assert r.source_size == want[r.doc_id][1] and r.target == pytest.approx(want[r.doc_id][2])
    assert dict(got) == {d: x[0] for d, x in want.items()}


def test_sources_end_near_their_targets(spark):
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        x = by[r.source_size, r.target]
        x[0] += r.taken
        x[2] = max(x[2], r.size)
    for (_, target), (taken, _, largest) in by.items():
        assert abs(taken - target) <= largest + 1


def test_mixed_documents_repeat_rows(spark):
    docs = frame(spark, awkward())
    want = sorted((r.doc_id or -1, r.copies) for r in mixing.mix(docs).collect() if r.copies)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    total = defaultdict(int)
    for d, c in want:
        total[d] += c
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id or -1] += 1
    assert got == total


def test_many_rows_without_an_id(spark):
    """Texts without an id, and many of one id: each is spread by its text and taken by its own row number."""
    rows = [(None if i % 2 else 7, f"w{i} " * (1 + i % 9), "en", "ab"[i % 7 == 0], i) for i in range(5000)]
    got = mixing.mixed_documents(frame(spark, rows)).collect()
    m = mixing.mix(frame(spark, rows))
    assert m.where("doc_id is null").count() == 2500 and sum(len(words(r.text)) for r in got) == m.agg({"taken": "sum"}).first()[0]
    assert {tuple(r) for r in got} <= set(rows)
    per_bucket = mixing.sized(frame(spark, rows)).groupBy("__key").count().agg({"count": "max"}).first()[0]
    assert per_bucket == 1


def test_clashing_columns(spark):
    docs = frame(spark, awkward()).selectExpr("*", "1 as size", "2 as target", "3 as taken", "4 as copies", "5 as finish", "6 as weight")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r.target for r in out.collect()} == {2}
    assert mixing.mix(docs).count() == len(awkward())


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None, None, None), (2, " ", "en", "a", 1)])).agg({"taken": "sum"}).first()[0] == 0
