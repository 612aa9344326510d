"""The stages against plain models, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from cinderlake.llm import jaccard, quality

from .helpers import awkward, frame
from .test_jaccard import brute
from .test_mixing import brute as queue
from .test_packing import check

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["input"] = docs.collect()
    for name, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema) if name != "pack_sequences" else stage(spark, docs, SF)
        out[name] = docs.collect()
    return out


def test_stage_names_and_columns(outputs):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "pack_sequences"]
    for n, _ in cp.STAGES[:-1]:
        assert list(outputs[n][0].asDict()) == cp.COLUMNS


def test_quality_keeps_clean_documents(spark, outputs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in outputs["quality_rules"]}
    good = [r.doc_id for r in outputs["input"] if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 50]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    junk = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in junk) <= 0.2 * len(junk)


def test_line_dedup_keeps_every_document(outputs):
    before, after = ({r.doc_id: r for r in outputs[n]} for n in ("quality_rules", "line_dedup"))
    assert before.keys() == after.keys()
    for d, r in after.items():
        left = Counter(before[d].text.split("\n"))
        left.subtract(Counter(r.text.split("\n")) if r.text else {})
        assert min(left.values()) >= 0 and r.n_chars == len(r.text)


def test_one_of_each_group_stays(outputs):
    rows = [tuple(r) for r in outputs["line_dedup"]]
    _, group = brute(rows)
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    assert sorted(r.doc_id for r in outputs["near_duplicates"]) == sorted(least.values())


def test_mix_and_packing(outputs):
    rows = [tuple(r) for r in outputs["near_duplicates"]]
    want = queue(rows)
    got = Counter(r.doc_id for r in outputs["mix_sources"])
    for d, t, *_ in rows:
        n = len(t.encode().split())
        assert got[d] * n == want[d][0]
    check(outputs["pack_sequences"], [(r.doc_id, r.text) for r in outputs["mix_sources"]])


def test_awkward_rows_pass_every_stage(spark):
    docs = frame(spark, awkward())
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 0
        if name != "pack_sequences":
            assert out.columns == cp.COLUMNS
            assert stage(spark, frame(spark, []), SF).count() == 0


def test_keep_one_of_awkward_rows(spark):
    rows = awkward()
    _, group = brute(rows)
    kept = Counter(r.doc_id for r in jaccard.keep_one(frame(spark, rows)).collect())
    assert sum(kept.values()) == len(set(group.values())) and all(d in kept for d in (1, 2, 3, 5)) and not kept[6] and not kept[None]


def test_bad_label_table(spark):
    labels = spark.createDataFrame([(1, None, 1), (None, 0, 0), (7, 1, None)], "doc_id bigint, quality int, toxic int")
    assert quality.learn_rules(frame(spark, awkward()), labels) == []
