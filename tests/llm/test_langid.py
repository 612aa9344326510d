import math
import random
from collections import Counter

import numpy as np
import pytest

from cinderlake.llm import langid

from .helpers import awkward, crc, frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = langid.identify_held_out(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == truth[r.doc_id][0] for r in got if r.held_out and len(truth[r.doc_id][1]) > 60]
    assert np.mean(right) > 0.97
    sure = [(r.score, r.lang_pred == truth[r.doc_id][0]) for r in got if r.held_out]
    assert abs(np.mean([s for s, _ in sure]) - np.mean([y for _, y in sure])) < 0.05  # calibrated


def test_weights_are_sparse_and_loss_falls():
    r = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(r.integers(3))
        f = np.unique(np.concatenate([r.integers(0, 2000, 20), 5000 + y * 10 + r.integers(0, 10, 3)]))
        rows.append((f, np.full(len(f), len(f) ** -0.5), y))
    w, b = langid.ftrl(rows, 3)
    assert (w == 0).mean() > 0.9
    assert np.mean([int((v @ w[f] + b).argmax()) == y for f, v, y in rows]) > 0.95


def test_temperature_recovers_scale():
    r = np.random.default_rng(0)
    z = r.normal(size=(4000, 4))
    y = np.array([r.choice(4, p=langid.softmax(x)) for x in z])
    assert langid.temperature(3 * z, y) == pytest.approx(3, rel=0.15)


def test_odd_texts(spark):
    rows = [*awkward(), (50, "1234 !!", "en", "a", 1), (51, "\U0001f600 中", "en", "a", 1)]
    got = {r.doc_id: r for r in langid.identify_held_out(frame(spark, rows)).collect()}
    assert len(got) == len({x[0] for x in rows})
    for d in (1, 2, 3, 50):
        assert (got[d].lang_pred, got[d].score) == ("und", 1.0)
    assert got[51].lang_pred in ("en", "fr", "de")
    assert langid.identify_held_out(frame(spark, [])).count() == 0
    none = langid.identify_held_out(frame(spark, [(1, "some words", None, "a", 1)])).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_counts_cover_the_whole_text():
    f, n = langid.counts("Ab1 2c")
    assert n.sum() == len(" ab c ") + (len(" ab c ") - 1) + (len(" ab c ") - 2)


def test_many_rows_without_an_id(spark):
    rows = [(None, f"the {i} and of this {i}", "en", "a", 1) for i in range(3000)] + [(None, f"le {i} et la de ce {i}", "fr", "a", 1) for i in range(3000)]
    rows += [(None, "the same text over and over", "en", "a", 1)] * 3000
    m = langid.train(frame(spark, rows), max_per_lang=10)
    assert m.langs == ["en", "fr"] and (m.weights != 0).any()
    assert m.predict("the and of this")[0] == "en" and m.predict("le et la de ce")[0] == "fr"


def test_more_languages_than_a_few_hundred(spark):
    rows = [(i, chr(0x4E00 + i) * 3, f"l{i}", "a", 1) for i in range(300)]
    assert len(langid.train(frame(spark, rows)).langs) == 300


def grams(text):
    """1- to 3-grams of the lower-cased text, other than letters as single blanks, as plain strings."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    if not t.strip():
        return None
    t = " " + " ".join(t.split()) + " "
    return Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))


def bucket(gram):
    """The feature of a gram by the operator's fixed 32-bit mixing, in plain integers."""
    c, m = [ord(x) for x in gram], 0xFFFFFFFF
    a = c[0] * 0x9E3779B1 & m
    if len(c) > 1:
        a = ((a ^ a >> 15) * 0x85EBCA77 + c[1] * 0xC2B2AE3D) & m
    if len(c) > 2:
        a = ((a ^ a >> 13) * 0x27D4EB2F + c[2] * 0x165667B1) & m
    return a >> 32 - langid.BITS


def plain_model(train, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, epochs=3):
    """Document frequencies, vectors and FTRL with scalars and dictionaries. ``train``: (text, lang) in the fit's order."""
    names = sorted({x for _, x in train})
    feats = [Counter() for _ in train]
    for f, (t, _) in zip(feats, train, strict=True):
        for g, n in grams(t).items():
            f[bucket(g)] += n
    df = Counter(x for f in feats for x in f)
    idf = lambda x: math.log((1 + len(train)) / (1 + df[x])) + 1

    def vector(f):
        v = {x: (1 + math.log(n)) * idf(x) for x, n in f.items()}
        norm = math.sqrt(sum(y * y for y in v.values()))
        return {x: y / norm for x, y in v.items()}

    z, s = Counter(), Counter()

    def weight(x, k):
        if abs(z[x, k]) <= l1:
            return 0.0
        return -(z[x, k] - math.copysign(l1, z[x, k])) / ((beta + math.sqrt(s[x, k])) / alpha + l2)

    def odds(v):
        e = [sum(y * weight(x, k) for x, y in v.items()) for k in range(len(names))]
        return e

    def soft(e, t=1.0):
        p = [math.exp((x - max(e)) / t) for x in e]
        return [x / sum(p) for x in p]

    made = [({**vector(f), -1: 1.0}, names.index(lang)) for f, (_, lang) in zip(feats, train, strict=True)]
    fit, back = [r for i, r in enumerate(made) if i % 5], [r for i, r in enumerate(made) if i % 5 == 0]
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for r in order.permutation(len(fit)):
            v, y = fit[r]
            p = soft(odds(v))
            steps = {(x, k): a * (p[k] - (k == y)) for x, a in v.items() for k in range(len(names))}
            was = {i: weight(*i) for i in steps}
            for i, g in steps.items():
                z[i] += g - (math.sqrt(s[i] + g * g) - math.sqrt(s[i])) / alpha * was[i]
                s[i] += g * g
    best = min((k / 1000 for k in range(-2995, 2996)), key=lambda t: sum(-math.log(max(soft(odds(v), math.exp(t))[y], 1e-300)) for v, y in back))
    return lambda t: (lambda p: (names[p.index(max(p))], max(p)))(soft(odds({**vector(_count(t)), -1: 1.0}), math.exp(best)))


def _count(t):
    f = Counter()
    for g, n in grams(t).items():
        f[bucket(g)] += n
    return f


def test_equals_a_plain_model(spark):
    r = random.Random(2)
    some = {"en": "the and of this with from", "fr": "le la et les ça déjà où", "de": "der die und straße über"}
    rows = [(i, " ".join(r.choices(some[lang].split(), k=6)) + f" {i}.", lang, "a", 1) for i, lang in enumerate(list(some) * 8)]
    docs = frame(spark, rows)
    from pyspark.sql import functions as F

    train = docs.withColumn("k", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(17))).orderBy("k").collect()
    predict = plain_model([(x.text, x.lang) for x in train])
    m = langid.train(docs)
    for t in [x.text for x in train] + ["the straße et", "où", "with und les"]:
        (a, p), (b, q) = m.predict(t), predict(t)
        assert a == b and p == pytest.approx(q, rel=1e-3, abs=1e-6)
