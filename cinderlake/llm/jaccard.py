"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

Documents with the same n-gram set are one class (their similarity is 1). Classes that share a band are only
candidates: they are joined into candidate groups by stars to the smallest member of each band bucket (linear in
the rows, no bucket is ever expanded), and then every pair inside a candidate group is compared on the full sets.
A group of up to ``BLOCK`` classes is one unit of work; a larger one is cut into blocks and every two blocks are
a unit, so no task holds more than two blocks and no pair is left out. Units return counts per class and a spanning
forest of the links, never pairs.

Bands and rows are chosen so that a pair at the threshold shares a band with at least the target probability.

Defined results: words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer than ``n`` words
has one n-gram, all its words; a text without words (null, empty, white space) links with nothing. Repeated rows
are separate documents and link with each other; null ids take part, and rank after every other id as a group's
smallest; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, require
from ._words import U, Words, mix, texts
from .components import components, forest, runs_of, settle, spread, unit_rows

THRESHOLD, N, RECALL, ROWS, BLOCK = 0.8, 5, 0.9999, 5, 128


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of so many rows that a pair at the threshold shares one with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram, by text; short texts have one."""
    h = w.hash
    g, at = w.grams(n, h)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        first = np.searchsorted(w.doc, short, "left")
        count = w.counts[short]
        own = np.full(len(short), 0x51ED270B, U)
        for i in range(n - 1):
            own = np.where(i < count, mix(own + h[np.minimum(first + i, len(h) - 1)]), own)
        g, doc = np.concatenate([g, own]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def distinct(g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]


def set_hash(g: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's n-gram set (0, 0 for the empty one); g holds each n-gram once a text."""
    out = np.zeros((2, n_docs), U)
    if len(g):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            out[k, doc[first]] = mix(np.add.reduceat(mix(g ^ U(salt)), first))
    return out[0], out[1]


def signatures(docs: DataFrame, n: int = N, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_hash, h1, h2, bands``; nulls for texts without words."""
    src = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    bands = bands or bands_for(rows=rows)
    r = np.random.default_rng(7)
    mul, add = (r.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * U(2) + U(1) for _ in range(2))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text_hash bigint, h1 bigint, h2 bigint, bands array<bigint>"

    def run(batches):
        for b in batches:
            for i, j, w in texts(b.column(1), 1 << 19, fold=True):
                g, doc = distinct(*shingles(w, n))
                m = w.n_docs
                h1, h2 = set_hash(g, doc, m)
                key = np.zeros((m, bands), U)
                has = np.zeros(m, bool)
                if len(g):
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    has[doc[first]] = True
                    for k in range(bands):
                        own = np.full(len(first), k + 1, U)
                        for x in range(k * rows, (k + 1) * rows):
                            own = mix(own + np.minimum.reduceat(g * mul[x] + add[x], first))
                        key[doc[first], k] = own
                none = pa.array(~has)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (m + 1) * bands, bands, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), *(pa.array(h.view(np.int64), mask=~has) for h in (h1, h2)), pa.compute.if_else(none, None, lists)], ["doc_id", "text_hash", "h1", "h2", "bands"])

    return src.mapInArrow(run, schema)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """``node, root`` of the classes (``h1, bands``) that share a band with another one, directly or in a chain."""
    rows = classes.select(F.explode("bands").alias("band"), "h1")
    lead = cut(rows.groupBy("band").agg(F.min("h1").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead"))
    return components(rows.join(lead, "band").where("h1 <> lead"), "h1", "lead")


def _verify(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float):
    """Linked pairs (i in left, j in right, i < j when both are the same) by exact set similarity."""
    m = len(sets)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    keep = shared[col]
    col, row = (np.cumsum(shared) - 1)[col[keep]], who[order][keep]
    total = int(shared.sum())
    both = np.zeros((len(left), len(right)))
    at_l, at_r = np.full(m, -1), np.full(m, -1)
    at_l[left], at_r[right] = np.arange(len(left)), np.arange(len(right))
    step = 8192
    edges = np.searchsorted(col, np.arange(0, total + step, step))
    for k in range(len(edges) - 1):
        c, x = col[edges[k] : edges[k + 1]] - k * step, row[edges[k] : edges[k + 1]]
        if not len(c):
            continue
        a, b = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        il, ir = at_l[x] >= 0, at_r[x] >= 0
        a[at_l[x[il]], c[il]] = 1
        b[at_r[x[ir]], c[ir]] = 1
        both += a @ b.T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    i, j = np.nonzero(both >= threshold * union - 1e-9)
    i, j = left[i], right[j]
    ok = i < j if left is right or np.array_equal(left, right) else i != j
    return i[ok], j[ok]


def linked_classes(members: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """From ``root, h1, n, grams``: ``h1, links`` (documents of linked classes) and ``h1, other`` (a forest)."""
    units = spread(unit_rows(members.select("root", "h1", "n", "grams"), "root", "h1", block))

    def run(batches):
        for t in runs_of(batches, 1):
            side, h, n = (t.column(c).to_numpy() for c in ("side", "h1", "n"))
            first = np.unique(h, return_index=True)[1]  # a class may have come from several tasks
            side, h, n = side[first], h[first], n[first]
            if len(h) < 2:
                continue
            grams = t.column("grams").combine_chunks()
            sets = [np.frombuffer(grams[int(k)].as_py(), U) for k in first]
            sizes = np.array([len(s) for s in sets])
            left, right = (np.arange(len(h)),) * 2 if side[0] < 0 else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            i, j = _verify(sizes, sets, left, right, threshold)
            if not len(i):
                continue
            links = np.bincount(i, n[j], len(h)) + np.bincount(j, n[i], len(h))
            some = np.flatnonzero(links)
            tree = np.array(forest(len(h), i, j)).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h[some], h[tree[:, 0]]])), pa.array([*links[some].astype(np.int64).tolist(), *[None] * len(tree)], pa.int64()), pa.array([*[None] * len(some), *h[tree[:, 1]].tolist()], pa.int64())],
                ["h1", "links", "other"],
            )

    return units.select("unit", "side", "h1", "n", "grams").mapInArrow(run, "h1 bigint, links bigint, other bigint")


def gram_sets(docs: DataFrame, wanted: DataFrame, n: int = N) -> DataFrame:
    """``root, h1, n, grams`` of the classes in ``wanted`` (``h1, rep, rep_text, root, n``): grams are the sorted 64-bit
    hashes of the row of that id and text hash; a task emits a class once, on however many equal rows it meets it."""
    key = lambda i, t: F.xxhash64(F.col(i).isNull(), i, t).alias("__k")
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("__t")).select(key("doc_id", "__t"), "text")
    src = wanted.select("root", "h1", "n", key("rep", "rep_text")).join(d, "__k").select("root", "h1", "n", "text")

    def run(batches):
        met: set[int] = set()
        for b in batches:
            for i, j, w in texts(b.column(3), 1 << 19, fold=True):
                g, doc = distinct(*shingles(w, n))
                h1, _ = set_hash(g, doc, w.n_docs)
                ok = np.flatnonzero(h1.view(np.int64) == b.column(1).slice(i, j - i).to_numpy())
                ok = [k for k in ok.tolist() if not (h1[k] in met or met.add(h1[k]))]
                at = np.searchsorted(doc, np.arange(w.n_docs + 1))
                part = b.slice(i, j - i).take(pa.array(ok, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([g[at[k] : at[k + 1]].tobytes() for k in ok], pa.binary())], ["root", "h1", "n", "grams"])

    return src.mapInArrow(run, "root bigint, h1 bigint, n bigint, grams binary")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document ``doc_id, n_links, component_id, kept``, ``group_id`` (null without words) and ``text_hash``
    (xxhash64 of the text, to tell rows of one id apart).

    ``n_links`` counts the other documents at or above the threshold, copies included; ``component_id`` is the
    smallest doc_id reachable by links; ``kept`` marks the documents with that id.
    """
    require(docs, "doc_id", "text")
    sig = cut(signatures(docs, n, bands_for(threshold, recall, rows), rows))
    classes = cut(sig.where("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    classes = classes.select("h1", "h2", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_text"), "n", "bands")
    groups = cut(candidate_groups(classes))
    wanted = classes.select("h1", "rep", "rep_text", "n").join(groups.withColumnRenamed("node", "h1"), "h1")
    found = cut(linked_classes(cut(gram_sets(docs, wanted, n)), threshold, block))
    out = settle(sig.select("doc_id", "text_hash", "h1"), "doc_id", classes.select("h1", "rep", "n"), found)
    return out.select("doc_id", "n_links", "component_id", "kept", "group_id", "text_hash")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the smallest id's (ties: the smallest text hash)."""
    found = cut(jaccard_join(docs, **how))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r")
    one = found.where("n_links > 0").groupBy("group_id").agg(first).select("r.doc_id", "r.text_hash", F.lit(True).alias("__once"))
    rest = found.where("n_links = 0").select("doc_id", "text_hash").distinct().withColumn("__once", F.lit(False))
    stay = one.unionByName(rest).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__once")
    d = docs.withColumn("__text", F.xxhash64("text"))
    d = d.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")))
    n = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__once"))
    return d.withColumn("__n", n).where("__n = 1 OR NOT __once").select(*docs.columns)
