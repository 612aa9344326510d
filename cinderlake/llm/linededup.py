"""Line dedup by distinct-site spread.

Every line of at least ``min_words`` words is hashed; HyperLogLog sketches per line hash (of sites, of distinct texts
and of contexts) merge by aggregation. Lines whose estimate lies near a limit get exact distinct counts. A line is
boilerplate if it stands on at least ``min_sites`` sites and in enough different surroundings: a line's context is
the smallest 6-gram hash among the rest of its text (unrelated texts share few, however many they are), and contexts must be at least ``min_sites`` and at least ``min_spread`` of
the distinct texts that hold the line. So lines of copied or nearly copied documents, whose surroundings are copied too, stay; whole
documents are for the near-duplicate operator. Boilerplate is deleted from every text.

Defined results: lines are \\n-split and compared without the white space about them; a null text stays null, a text
of boilerplate only becomes empty; null sites are one site; repeated rows count as one text; null ids are matched like
any other; an empty table gives an empty one; columns named ``n_lines`` or ``n_removed`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import cut, require
from ._words import U, Words, mix, texts

MIN_WORDS, MIN_SITES, MIN_SPREAD, LG_K = 1, 5, 0.3, 12
#: Line hashes that go to every task at most (8 MB); beyond, they are joined to the texts.
MAX_BROADCAST = 1 << 20
#: Words of the n-grams that contexts are taken from: too long to be shared by chance, short enough to survive edits of a copy.
GRAM = 6
_TOP = U(0xFFFFFFFFFFFFFFFF)


def line_hashes(w: Words) -> tuple[np.ndarray, ...]:
    """(hash, text, words, start, end, first word, last word) of every line with a word; the hash is of the trimmed line."""
    start, end, doc = w.lines()
    a, z = np.searchsorted(w.start, start, "left"), np.searchsorted(w.start, end, "left")
    has = z > a
    start, end, doc, a, z = start[has], end[has], doc[has], a[has], z[has]
    return w.spans(w.start[a], w.end[z - 1]) if len(a) else np.zeros(0, U), doc, z - a, start, end, a, z


def contexts(w: Words, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per line: the smallest n-gram hash among the other lines of its text (all ones if there is none). A line of fewer
    than GRAM words is one n-gram; no other part of a line is, for texts have short parts in common by chance."""
    if not len(doc):
        return np.zeros(0, U)
    h = w.hash
    n = len(h)
    line = np.zeros(n, np.int64)
    line[first[1:]] = 1
    line = np.cumsum(line)
    gram, whole = h.copy(), np.zeros(n, bool)
    for k in range(1, GRAM):
        same = np.flatnonzero(line[k:] == line[: n - k])
        gram[same] = mix(gram[same] * U(0xD6E8FEB86659FD93) + h[same + k])
    whole[: max(n - GRAM + 1, 0)] = line[GRAM - 1 :] == line[: max(n - GRAM + 1, 0)]
    whole[first] = True
    low = np.minimum.reduceat(np.where(whole, gram, _TOP), first)
    order = np.lexsort((low, doc))
    d, v = doc[order], low[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])  # distinct values of each text
    d, v = d[new], v[new]
    at = np.searchsorted(d, doc)
    least = v[at]
    after = np.minimum(at + 1, len(d) - 1)
    second = np.where(d[after] == doc, v[after], _TOP)
    second = np.where(after == at, _TOP, second)
    return np.where(low == least, second, least)


def line_rows(docs: DataFrame, site_col: str, min_words: int) -> DataFrame:
    """``key, site, line, context, copy``: once per distinct line of a text; key is a hash of id and text, copy one of the text."""
    src = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text")).alias("key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), "text")
    schema = "key bigint, site string, line bigint, context bigint, copy bigint"

    def run(batches):
        for b in batches:
            for i, j, w in texts(b.column(2)):
                h, doc, n, _, _, a, _ = line_hashes(w)
                context = contexts(w, doc, a)
                copy = w.spans(w.offsets[:-1], w.offsets[1:])
                ok = n >= min_words
                h, doc, context = h[ok], doc[ok], context[ok]
                first = np.unique(mix(h + doc.astype(U) * U(0xD1342543DE82EF95)), return_index=True)[1]
                h, doc, context = h[first], doc[first], context[first]
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(x.view(np.int64)) for x in (h, context, copy[doc]))], ["key", "site", "line", "context", "copy"])

    return src.mapInArrow(run, schema)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, min_spread: float = MIN_SPREAD, lg_k: int = LG_K) -> DataFrame:
    """``line, sites, texts, contexts`` of the boilerplate lines among :func:`line_rows` rows."""
    # most lines stand on one site only: they leave by a plain count before any sketch is made
    several = lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("line")
    some = cut(lines.join(cut(several), "line", "left_semi").select("line", "site", "context", "copy")) if min_sites > 1 else lines
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(lg_k))).alias(c)
    e = cut(some.groupBy("line").agg(sketch("site"), sketch("copy"), sketch("context")))
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    fewest = F.least("site", "context")
    sure = (fewest >= min_sites * (1 + error) + 1) & (F.col("context") >= F.col("copy") * min_spread * (1 + 2 * error) + 1)
    out = (fewest < min_sites * (1 - error) - 1) | (F.col("context") < F.col("copy") * min_spread * (1 - 2 * error) - 1)
    # a table of its own: grouping right after the join would keep a very common line in one task
    near = cut(some.join(e.where(~sure & ~out).select("line"), "line", "left_semi"))
    exact = None
    for c in ("site", "copy", "context"):  # each by two pre-aggregated steps, so that a very common line is no hot group
        n = near.groupBy("line", c).agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("*").alias(c))
        exact = n if exact is None else exact.join(n, "line")
    exact = exact.where((F.least("site", "context") >= min_sites) & (F.col("context") >= F.col("copy") * min_spread))
    return e.where(sure).unionByName(exact).select("line", F.col("site").alias("sites"), F.col("copy").alias("texts"), F.col("context").alias("contexts"))


def _deleting(columns: list[str], at: int, lines_of):
    """A batch function: ``columns`` (text at ``at``) without the lines in ``lines_of(batch, row)``, with counts."""

    def run(batches):
        for b in batches:
            col = b.column(at)
            count, removed, change = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), {}
            known = lines_of(b)
            for i, j, w in texts(col):
                h, doc, _, start, end, _, _ = line_hashes(w)
                count[i:j] = np.bincount(w.lines()[2], minlength=j - i)
                hit = known(h.view(np.int64), doc + i)
                for k in np.unique(doc[hit]).tolist():
                    mine = slice(*np.searchsorted(doc, (k, k + 1)))
                    drop = set(start[mine][hit[mine]].tolist())
                    o, z = w.offsets[k], w.offsets[k + 1]
                    left, x = [], int(o)
                    for line in w.data[o:z].tobytes().split(b"\n"):
                        if x not in drop:
                            left.append(line)
                        x += len(line) + 1
                    change[k + i] = b"\n".join(left).decode()
                    removed[k + i] = len(drop)
            if change:
                col = pa.array([change.get(k, v) for k, v in enumerate(col.to_pylist())], col.type)
            count[~col.is_valid().to_numpy(zero_copy_only=False)] = 0
            cols = [col if k == at else b.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count), pa.array(removed)], [*columns, "n_lines", "n_removed"])

    return run


def delete_lines(docs: DataFrame, lines: DataFrame, found: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` without the lines whose hashes ``found`` (``line``) holds; ``lines``: the :func:`line_rows` of ``docs``.

    Up to ``most`` hashes (8 bytes each) go to every task, and texts stay where they are. More of them are joined to
    the texts that hold them, by id and text hash.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    d, at = docs.select(*kept), kept.index("text")
    if found.limit(most + 1).count() <= most:
        all_of = np.sort(np.array([r.line for r in found.select("line").collect()], np.int64))
        shared = docs.sparkSession.sparkContext.broadcast(all_of)
        return d.mapInArrow(_deleting(kept, at, lambda b: lambda h, doc: _among(h, shared.value)), schema)
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text")).alias("__k")
    gone = cut(lines.join(found, "line").groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("__lines")))
    d = d.select("*", key).join(gone.withColumnRenamed("key", "__k"), "__k", "left").select(*kept, "__lines")

    def lines_of(b):
        mine = b.column(len(kept))
        one_list = b"".join(x.values.to_numpy().astype("<i8").tobytes() if x.is_valid else b"" for x in mine)
        values, size = np.frombuffer(one_list, "<i8"), np.array([len(x.values) if x.is_valid else 0 for x in mine], np.int64)
        pairs = np.unique(_pair(values, np.repeat(np.arange(len(mine)), size)))
        return lambda h, doc: _among(_pair(h, doc), pairs)

    return d.mapInArrow(_deleting(kept, at, lines_of), schema)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted values."""
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x if len(values) else np.zeros(len(x), bool)


def _pair(line: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(line.view(U) + row.astype(U) * U(0xD1342543DE82EF95))


def dedup_lines(docs: DataFrame, site_col: str = "source", min_words: int = MIN_WORDS, min_sites: int = MIN_SITES, min_spread: float = MIN_SPREAD, lg_k: int = LG_K, most: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with boilerplate lines deleted from ``text``, plus ``n_lines`` (before) and ``n_removed``."""
    require(docs, "doc_id", "text", site_col)
    lines = cut(line_rows(docs, site_col, min_words))
    return delete_lines(docs, lines, cut(boilerplate(lines, min_sites, min_spread, lg_k).select("line")), most)
