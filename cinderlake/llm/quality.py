"""Quality rules: learned decision lists over statistics of whole texts.

``text_stats`` measures every text in one pass without a shuffle. ``learn_rules`` fits an ordered list of
threshold conjunctions by sequential covering (grow on two thirds of a bounded labelled sample by FOIL
gain, prune on the rest by precision, delete what is covered, repeat). ``rules_column`` turns the list
into one ordered Spark ``CASE WHEN``, so judging runs in generated code.

Defined results: a null text is an empty text (no words); an empty table gives an empty table; repeated
rows are each judged; other columns pass through, also those named like a statistic (statistics are
fields of the struct ``stats``); columns named ``stats``, ``base_failed``, ``rule`` or ``kept`` are replaced. A label table without usable rows gives an empty list
(nothing is rejected by a rule).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import require
from ._words import U, mix, texts

#: Rows of the label table that a fit reads at most (by smallest hash of the id): the documented bound.
MAX_LABELLED = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_ends", "n_lines", "n_distinct_words")
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "ends_per_word", "words_per_line", "distinct_share")
_SYMBOL, _UPPER, _DIGIT, _END = (np.isin(np.arange(256), list(s)) for s in (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?"))


def _stats(col: pa.Array) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(col), np.int64) for k in COUNTS}
    for i, j, w in texts(col):
        d, n = w.data, w.n_docs
        at = slice(i, j)
        out["n_words"][at] = w.counts
        out["word_chars"][at] = w.per_doc(w.inside & ((d & 0xC0) != 0x80))
        for k, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_ends", _END)):
            out[k][at] = w.per_doc(flags[d])
        h = w.hash
        # lines with a word, equal to an earlier line of the text
        start, end, doc = w.lines()
        has = np.searchsorted(w.start, end, "left") > np.searchsorted(w.start, start, "left")
        start, end, doc = start[has], end[has], doc[has]
        out["n_lines"][at] = np.bincount(doc, minlength=n)
        key = mix(w.spans(start, end) + doc.astype(U) * U(0xD1342543DE82EF95))
        first = np.unique(key, return_index=True)[1]
        out["n_dup_lines"][at] = out["n_lines"][at] - np.bincount(doc[first], minlength=n)
        first = np.unique(mix(h + w.doc.astype(U) * U(0xD1342543DE82EF95)), return_index=True)[1]
        out["n_distinct_words"][at] = np.bincount(w.doc[first], minlength=n)
        g, first = w.grams(3, h)
        if len(g):
            key = mix(g + w.doc[first].astype(U) * U(0xD1342543DE82EF95))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(g), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = np.zeros(len(h), bool)
            for k in range(3):
                hit[first[twice] + k] = True
            out["n_repeat_words"][at] = np.bincount(w.doc[hit], minlength=n)
    return out


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus a struct ``stats`` of COUNTS (all long). One pass, no shuffle."""
    require(docs, text_col)
    rest = [c for c in docs.columns if c not in (text_col, "stats")]
    kind = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("stats", kind, False)])

    def run(batches):
        for b in batches:
            got = _stats(b.column(b.schema.get_field_index(text_col)))
            stats = pa.StructArray.from_arrays([pa.array(got[c]) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), stats], [*rest, "stats"])

    return docs.mapInArrow(run, schema)


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """As :func:`text_stats`, and the text stays."""
    require(docs, text_col)
    docs = docs.drop("stats")
    schema = T.StructType([*docs.schema.fields, T.StructField("stats", T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS]), False)])

    def run(batches):
        for b in batches:
            got = _stats(b.column(b.schema.get_field_index(text_col)))
            stats = pa.StructArray.from_arrays([pa.array(got[c]) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns, stats], [*b.schema.names, "stats"])

    return docs.mapInArrow(run, schema)


def features(stats: str = "stats") -> dict[str, Column]:
    """Every feature as a double Column over the struct; shares of nothing are 0."""
    c = lambda n: F.col(f"{stats}.{n}").cast("double")
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {
        "n_words": c("n_words"), "mean_word": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "ends_per_word": share("n_ends", "n_words"), "words_per_line": share("n_words", "n_lines"), "distinct_share": share("n_distinct_words", "n_words"),
    }


def base_failed(stats: str = "stats") -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ">=" or "<", threshold) that rejects what it covers."""

    conditions: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def column(self, feats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, x in self.conditions:
            out = out & ((feats[name] >= F.lit(x)) if op == ">=" else (feats[name] < F.lit(x)))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {op} {x:.6g}" for n, op, x in self.conditions)


def rules_column(rules: list[Rule], stats: str = "stats") -> Column:
    """Index (from 1) of the first rule that covers the row, 0 if none: an ordered CASE WHEN."""
    feats, out = features(stats), None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(feats), i) if out is None else out.when(r.column(feats), i)
    return F.lit(0) if out is None else out.otherwise(0)


def _covers(x: np.ndarray, cond) -> np.ndarray:
    name, op, t = cond
    v = x[:, FEATURES.index(name)]
    return v >= t if op == ">=" else v < t


def fit(x: np.ndarray, bad: np.ndarray, min_precision: float = 0.9, max_rules: int = 16, max_conditions: int = 4, cuts: int = 64) -> list[Rule]:
    """Sequential covering over a feature matrix; ``bad`` marks rows to reject. Deterministic."""
    rules: list[Rule] = []
    prune = np.zeros(len(x), bool)
    for kind in (bad, ~bad):  # every third row of each kind
        prune[np.flatnonzero(kind)[2::3]] = True
    alive = np.ones(len(x), bool)
    barred: set[tuple[str, str]] = set()  # first conditions that led to a rule of too little precision
    while len(rules) < max_rules and (alive & bad & ~prune).sum() >= 3:
        g = alive & ~prune
        gx, gy, conds, inside = x[g], bad[g], [], np.ones(g.sum(), bool)
        while len(conds) < max_conditions and (~gy[inside]).any():
            p0, n0 = gy[inside].sum(), (~gy[inside]).sum()
            best = (1e-9, None)
            for f, name in enumerate(FEATURES):
                v = gx[inside, f]
                ts = np.unique(np.quantile(v, np.linspace(0, 1, cuts + 2)[1:-1]))
                order = np.argsort(v, kind="stable")
                sv, sy = v[order], np.concatenate([[0], np.cumsum(gy[inside][order])])
                k = np.searchsorted(sv, ts, "left")
                for op, p, n in ((">=", p0 - sy[k], (len(v) - k) - (p0 - sy[k])), ("<", sy[k], k - sy[k])):
                    if not conds and (name, op) in barred:
                        continue
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= 3, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), (name, op, float(ts[i])))
            if best[1] is None:
                break
            conds.append(best[1])
            inside &= _covers(gx, best[1])
        if not conds:
            break
        # prune: the shortest prefix with the best (p - n) / (p + n) on the held-out third
        first, scores, got = conds[0][:2], [], alive & prune
        for c in conds:
            got &= _covers(x, c)
            p, n = (got & bad).sum(), (got & ~bad).sum()
            scores.append((p - n) / (p + n) if p + n else -1.0)
        conds = conds[: int(np.argmax(scores)) + 1]
        got = alive.copy()
        for c in conds:
            got &= _covers(x, c)
        precision = float((got & bad).sum() / max(1, got.sum()))
        if precision < min_precision or max(scores) < 2 * min_precision - 1:
            barred.add(first)
            continue
        barred.clear()
        rules.append(Rule(tuple(conds), int(got.sum()), precision))
        alive &= ~got
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, **how) -> list[Rule]:
    """Decision list that rejects ``quality = 0`` texts, learned from at most ``max_rows`` labelled rows.

    The sample is the ``max_rows`` labels of smallest id hash, so it is bounded, stable and broadcast.
    Rows that fail :func:`base_failed` are left out: they are rejected before any rule.
    """
    some = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("__quality"))
    some = some.groupBy("doc_id").agg(F.min("__quality").alias("__quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = text_stats(got).where(~base_failed()).select("doc_id", "__quality", F.struct(*(c.alias(n) for n, c in features().items())).alias("x"))
    # an id may stand on any number of rows: one of them, so that the driver gets max_rows rows at most
    rows = rows.groupBy("doc_id").agg(F.min("__quality").alias("quality"), F.min("x").alias("x"))
    pdf = rows.select(F.xxhash64("doc_id", F.lit(5)).alias("order"), "quality", "x.*").toPandas()
    if pdf.empty:
        return []
    pdf = pdf.sort_values(["order", *FEATURES], kind="stable")
    return fit(pdf[list(FEATURES)].to_numpy(float), pdf["quality"].to_numpy() == 0, **how)


def judge(docs: DataFrame, rules: list[Rule], keep_text: bool = False) -> DataFrame:
    """``docs`` with ``stats``, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    out = (with_stats if keep_text else text_stats)(docs)
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", rules_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
