import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cinderlake.llm import linededup, queries
from cinderlake.llm._words import texts

from .helpers import awkward, frame, words

SF = "/root/testdata/sf0.01"
STRIP = "\x20\t\n\x0b\x0c\r"


def brute(spark, rows, min_words=4, min_sites=5, min_spread=0.3):
    """Contexts come from the operator's own hashes; counting, limits and deletion are plain Python."""
    lines = linededup.line_rows(frame(spark, rows), "source", 1).collect()
    context = {(r.copy, r.line): r.context for r in lines}
    import pyarrow as pa

    def hashes(t):
        (_, _, w), = texts(pa.array([t]))
        h, _, _, start, *_ = linededup.line_hashes(w)
        return dict(zip(start.tolist(), h.view(np.int64).tolist())), int(w.spans(w.offsets[:-1], w.offsets[1:]).view(np.int64)[0])

    sites, copies, contexts = (defaultdict(set) for _ in range(3))
    for d, t, _, s, _ in rows:
        if t:
            by, copy = hashes(t)
            at = 0
            for line in t.split("\n"):
                if len(words(line)) >= min_words:
                    key = line.strip(STRIP)
                    sites[key].add(s)
                    copies[key].add(t)
                    contexts[key].add(context[copy, by[at]])
                at += len(line.encode()) + 1
    bad = {k for k in sites if min(len(sites[k]), len(contexts[k])) >= min_sites and len(contexts[k]) >= min_spread * len(copies[k])}
    out = []
    for d, t, *_ in rows:
        out.append((str(d), None if t is None else "\n".join(x for x in t.split("\n") if x.strip(STRIP) not in bad)))
    return sorted(out, key=str), bad


def made():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    boiler, passage, short = "All rights reserved by the owner.", line(60), "so it is"
    rows = []
    for i in range(60):
        body = [line(12) for _ in range(6)]
        if i % 2:
            body.insert(r.randrange(7), boiler + " " * (i % 3))
        if i % 5 == 0:
            body.insert(r.randrange(7), passage)
        if i % 3 == 0:
            body.append(short)
        rows.append((i, "\n".join(body), "en", f"s{i % 9}", 1))
    doc = [line(12) for _ in range(12)]
    for i in range(40):  # nearly copied documents over many sites: their lines stay
        copy = list(doc)
        copy[r.randrange(12)] = line(12)
        rows.append((100 + i, "\n".join(copy), "en", f"s{i % 9}", 1))
    rows += [(200 + i, rows[0][1], "en", f"s{i}", 1) for i in range(9)]
    return rows, boiler, passage, short, doc


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_deletes_boilerplate_only(spark, most):
    rows, boiler, passage, short, doc = made()
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows), min_words=4, most=most).collect()}
    want, bad = brute(spark, rows)
    assert bad == {boiler, passage}
    assert sorted(((str(d), r.text) for d, r in got.items()), key=str) == want
    assert all(boiler not in r.text and passage not in r.text for r in got.values())
    assert sum(short in r.text for r in got.values()) >= 20
    assert sum(x in got[100 + i].text for i in range(40) for x in doc) == 40 * 11
    assert got[1].n_lines == len(rows[1][1].split("\n")) and got[1].n_removed == 1


@pytest.mark.parametrize("lg_k", [4, 12])
def test_near_limits_are_exact(spark, lg_k):
    r = random.Random(9)
    rows, spread = [], {}
    for k in range(40):
        spread[k] = 3 + k % 5
        for s in range(spread[k]):
            rows.append((len(rows), f"this is shared line number {k}\n" + " ".join(str(r.random()) for _ in range(9)), "en", f"s{s}", 1))
    got = linededup.dedup_lines(frame(spark, rows), lg_k=lg_k).collect()
    for x in got:
        k = int(rows[x.doc_id][1].split("\n")[0].split()[-1])
        assert (x.n_removed == 1) == (spread[k] >= 5)


def test_awkward(spark):
    rows = awkward()
    out = linededup.dedup_lines(frame(spark, rows).selectExpr("*", "1 as n_lines", "2 as line", "3 as site"), min_words=4, min_sites=1, min_spread=0.0)
    want, bad = brute(spark, rows, min_sites=1, min_spread=0.0)
    assert bad and sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str) == want
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted(((str(r.doc_id), r.text) for r in linededup.dedup_lines(frame(spark, rows), min_words=4).collect()), key=str)
    want, bad = brute(spark, rows)
    assert bad and got == want


def test_contexts_of_many_unrelated_texts_stay_apart(spark):
    """A line on all sites goes, however many texts hold it, also where the texts have all word pairs in common."""
    r = random.Random(3)
    vocabulary = [f"w{x}" for x in range(20)]
    boiler = "All rights reserved by the owner."
    rows = [(i, "\n".join([" ".join(r.choices(vocabulary, k=12)) for _ in range(6)] + [boiler]), "en", f"s{i % 9}", 1) for i in range(1500)]
    lines = linededup.line_rows(frame(spark, rows), "source", 4)
    got = {r.line: r for r in linededup.boilerplate(lines).collect()}
    assert len(got) == 1 and all(r.contexts > 0.9 * r.texts for r in got.values())
    assert all(boiler not in r.text for r in linededup.dedup_lines(frame(spark, rows)).collect())


def test_query_and_pipeline_count_short_lines(spark, tmp_path):
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    rows = [(i, "\n".join([line(), line(), "All rights reserved." if i % 2 else line(), "Home" if i % 3 else line(), "rare" if i % 30 == 0 else line()]), "en", f"s{i % 9}", 1) for i in range(60)]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op6_line_dedup(spark, str(tmp_path)), corpus_pipeline.line_dedup(spark, docs, str(tmp_path))):
        texts_of = [x.text.split("\n") for x in got.collect()]
        assert len(texts_of) == 60 and not any("All rights reserved." in t or "Home" in t for t in texts_of)
        assert sum("rare" in t for t in texts_of) == 2


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_many_rows_without_an_id(spark, most):
    """Rows that share a null id each lose their own lines only, and the work is one list a text."""
    r = random.Random(8)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    boiler = [f"all rights of number {k} are reserved" for k in range(3)]
    rows = [(None, "\n".join([line(), boiler[i % 3], line()]), "en", f"s{i % 10}", 1) for i in range(5000)]
    got = linededup.dedup_lines(frame(spark, rows), most=most).collect()
    assert len(got) == 5000 and all(x.n_removed == 1 for x in got)
    assert sorted(x.text for x in got) == sorted(t.replace("\n" + boiler[i % 3], "") for i, (_, t, *_) in enumerate(rows))
