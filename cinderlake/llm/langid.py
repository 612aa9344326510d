"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the whole lower-cased text (runs of characters that are no letters
count as one blank), weighted by (1 + log tf) x idf and scaled to length 1. Document frequencies come from every
training text. Weights are trained by follow-the-regularised-leader with elastic-net penalties (per-coordinate rates;
the L1 part leaves most weights at exactly 0), and a temperature fitted on held-back rows calibrates the probabilities.

Only texts with a letter are predicted; the score is the calibrated probability of the predicted language, 1 for
``und``. Defined results: a null text or one without a letter is ``und``; a corpus without usable labels predicts
``und`` everywhere with score 0; repeated rows are each predicted, and the fit's sample holds equal ones once; null ids count as the empty text in the split; an
empty table gives an empty one; other columns are not carried and never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import crc_mod, require


BITS = 15
DIM = 1 << BITS
#: Training texts per language, about (by hash of id and text): the documented bound of the fit's sample.
MAX_PER_LANG = 1_500
_BLANK = np.uint32(32)
_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def code_points(text: str) -> np.ndarray | None:
    """Lower-cased letters with single blanks between runs and at both ends; None without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, _BLANK)
    keep = np.ones(len(c), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    return np.concatenate([[_BLANK], c[keep], [_BLANK]]).astype(np.uint32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature, how often) of the 1- to 3-grams; None without a letter."""
    c = code_points(text)
    if c is None:
        return None
    a = c * np.uint32(0x9E3779B1)
    b = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[1:] * np.uint32(0xC2B2AE3D)
    t = (b[:-1] ^ (b[:-1] >> np.uint32(13))) * np.uint32(0x27D4EB2F) + a[2:] * np.uint32(0x165667B1)
    n = np.bincount(np.concatenate([a, b, t]) >> np.uint32(32 - BITS), minlength=DIM)
    f = np.flatnonzero(n)
    return f, n[f]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x languages, mostly zeros
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, f: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[f]
        return v / (np.sqrt((v * v).sum()) or 1.0)

    def logits(self, f: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[f] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        got = counts(text) if text else None
        if got is None:
            return "und", 1.0
        if not self.langs:
            return "und", 0.0
        p = softmax(self.logits(got[0], self.vector(*got)) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-Proximal for the multinomial loss: (weights DIM x k, bias k). Coordinates with |z| <= l1 are exactly 0."""
    z, s = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(s[i])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            f, v, y = rows[r]
            i = np.append(f, DIM)  # the last coordinate is the bias
            x = np.append(v, 1.0)
            w = weights(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(s[i] + g * g) - np.sqrt(s[i])) / alpha
            z[i] += g - sigma * w
            s[i] += g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    a, b, phi = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - phi * (b - a), a + phi * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over every text: in how many each feature occurs, and how many texts have a letter. Partial sums per task."""

    def run(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                got = counts(t) if t else None
                if got is not None:
                    df[got[0]] += 1
                    n += 1
        f = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *f.tolist()], pa.int32()), pa.array([n, *df[f].tolist()], pa.int64())], ["f", "n"])

    rows = texts.select("text").mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()  # DIM + 1 rows at most
    df = np.zeros(DIM, np.int64)
    total = 0
    for f, n in rows:
        if f < 0:
            total = n
        else:
            df[f] = n
    return df, total


def train(docs: DataFrame, max_per_lang: int = MAX_PER_LANG, **how) -> Model:
    """Fit on rows with a language and a text. The sample of the fit is bounded and chosen by a hash of id and text; the
    document frequencies are those of all rows."""
    require(docs, "doc_id", "text", "lang")
    src = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    langs = src.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not langs:
        return Model([], np.ones(DIM), np.zeros((DIM, 0)), np.zeros(0))
    df, total = document_frequencies(src)
    idf = np.log((1 + total) / (1 + df)) + 1
    names = sorted(r.lang for r in langs)
    share = F.create_map(*(x for r in langs for x in (F.lit(r.lang), F.lit(min(1.0, max_per_lang / r.n)))))
    key = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(17))
    unit = F.pmod(F.col("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = src.select("lang", key.alias("key"), "text").where(unit < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    some = some.groupBy("lang", "key").agg(F.first("text").alias("text"))  # equal rows are one, so that they do not break the bound

    def run(batches):
        for b in batches:
            lang, order, feats, times = [], [], [], []
            for name, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                got = counts(t.as_py())
                if got is not None:
                    lang.append(name), order.append(k), feats.append(got[0].astype("<u2").tobytes()), times.append(got[1].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(order, pa.int64()), pa.array(feats, pa.binary()), pa.array(times, pa.binary())], ["lang", "key", "f", "n"])

    def fit(batches):  # one task: its rows are the bounded sample
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[1], r[0], r[2], r[3]))
        m = Model(names, idf, np.zeros((DIM, len(names))), np.zeros(len(names)))
        made = []
        for name, _, f, n in rows:
            f = np.frombuffer(f, "<u2").astype(np.int64)
            made.append((f, m.vector(f, np.frombuffer(n, "<u4").astype(float)), names.index(name)))
        back = [r for i, r in enumerate(made) if i % 5 == 0]
        m.weights, m.bias = ftrl([r for i, r in enumerate(made) if i % 5], len(names), **how)
        if back:
            m.temperature = temperature(np.array([m.logits(f, v) for f, v, _ in back]), np.array([y for *_, y in back]))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype("<f8").tobytes()]), pa.array([m.bias.astype("<f8").tobytes()]), pa.array([m.temperature])], ["w", "b", "t"])

    sample = some.mapInArrow(run, "lang string, key bigint, f binary, n binary")
    r = sample.repartition(1).mapInArrow(fit, "w binary, b binary, t double").first()
    if r is None:
        return Model([], np.ones(DIM), np.zeros((DIM, 0)), np.zeros(0))
    return Model(names, idf, np.frombuffer(r.w, "<f8").reshape(DIM, len(names)), np.frombuffer(r.b, "<f8"), r.t)


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` of every whole text. One pass, no shuffle."""
    src = docs.select(*keep, "text")
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, f"{spec}, lang_pred string, score double")


def identify_held_out(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every text, learned from the rows that are not held out."""
    d = docs.select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"))
    return identify(d, train(d.where(~F.col("held_out"))), "doc_id", "held_out")
