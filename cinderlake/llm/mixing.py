"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash; passes over the source follow one another, at most
``max_repeats`` of them. A copy of a document has the virtual finish time (words of its source up to and
including it) / (target of its source). All copies are range-sorted by finish time and the mix stops at the
total budget, so every source moves at its target's pace and ends near its target.

Only native DataFrame operations. No source is ever in one task: running sums go over hash buckets of each
source first (bounded tables) and then inside a bucket, and the cut by budget goes over bins of finish time
first and inside the one bin that holds the cut.

Defined results: null text has size 0; null source is a source of its own, last in order; documents of size
0 take part but take no words; an empty table gives an empty one; repeated rows are separate documents, told
apart by a number of their own among equals; columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import cut, require, table_cut

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Per source: ``source, source_size, weight, target`` from ``source, source_size``.

    Sources by code point, null last, weigh 1, 2, 3 and again; they share the sum of all sizes by weight;
    a target stops at ``max_repeats`` times its source's size and the excess is shared by weight among the
    others until none is above. Closed form: in order of size / weight, a source is at its stop if its stop
    is no more than its share of what all sources before it (each at its stop) leave over.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    t = t.withColumn("__stop", (max_repeats * F.col("source_size")).cast("long")).withColumn("__all", F.sum("source_size").over(one))
    by = one.orderBy(F.col("__stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__left", F.col("__all") - F.coalesce(F.sum("__stop").over(before), F.lit(0)))
    t = t.withColumn("__weights", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("__stops", F.col("__stop") * F.col("__weights") <= F.col("weight") * F.col("__left"))
    # the first source that does not stop sets the level for it and all after it
    level = F.min(F.when(~F.col("__stops"), F.struct(F.row_number().over(by), "__left", "__weights"))).over(one)
    t = t.withColumn("__level", level)
    share = F.col("weight").cast("double") * F.col("__level.__left").cast("double") / F.col("__level.__weights").cast("double")
    return t.select("source", "source_size", "weight", F.when(F.col("__stops"), F.col("__stop").cast("double")).otherwise(share).alias("target"))


def sized(docs: DataFrame, seed: int = 0, *keep: str) -> DataFrame:
    """``doc_id, source, size, __key`` and the ``keep`` columns: __key orders the documents of a source, the same in
    every run, by id and text, so that rows of one id or none are spread as well."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("__key"), *keep)


def finish_times(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """:func:`sized` rows with ``source_size``, ``target``, ``cum`` (words of the source up to the row) and ``__n``.

    A source of n rows has about sqrt(n) / 2 buckets, so neither a bucket nor a source's list of buckets is large.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    t = targets(per.select("source", "source_size"), max_repeats)
    per = per.select(F.col("source").alias("__s"), F.ceil(F.sqrt("__rows") / 2).cast("long").alias("__buckets"))
    t = t.join(per, F.col("source").eqNullSafe(F.col("__s"))).select("__s", "source_size", "target", "__buckets")
    lead = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    d = sizes.join(t, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    d = d.withColumn("__bucket", F.floor(lead * F.col("__buckets") / F.lit(1 << 32)).cast("long")).drop("__buckets")
    sums = d.groupBy("source", "__bucket").agg(F.sum("size").alias("__words"))
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "size")
    d = d.withColumn("__n", F.row_number().over(inside))
    d = d.withColumn("cum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return d.withColumn("cum", F.col("cum") + F.col("__before")).drop("__s", "__b", "__before", "__bucket")


def _place(copy: Column) -> Column:
    """A copy's place in the queue: by finish time; ties by source (null last), key and id."""
    finish = (F.col("cum") + copy * F.col("source_size")).cast("double") / F.col("target")
    return F.struct(finish.alias("finish"), F.col("source").isNull().alias("no_source"), "source", "__key", "doc_id", "__n", copy.alias("copy"))


def find_cut(times: DataFrame, rows: int, max_repeats: int = 3) -> DataFrame:
    """One row, ``__cut``: the place of the copy that reaches the budget (the sum of all sizes); null if no words.

    Bins of finish time are summed first; only the bin with the budget in it is sorted.
    """
    bins = max(1 << 10, min(1 << 20, 1 << int(math.sqrt(max(1, rows))).bit_length()))
    c = times.where("size > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    c = c.select("size", _place(F.col("__copy")).alias("__place"))
    c = c.withColumn("__bin", F.floor(F.least(F.col("__place.finish"), F.lit(float(max_repeats))) * bins).cast("long"))
    one = Window.partitionBy(F.lit(0))
    w = c.groupBy("__bin").agg(F.sum("size").alias("__words"))
    w = w.withColumn("__before", F.coalesce(F.sum("__words").over(one.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = times.agg(F.sum("size").alias("__budget"))
    # one row: the bin in which the budget is reached
    at = w.crossJoin(F.broadcast(budget)).where("__before < __budget AND __before + __words >= __budget").select(F.col("__bin").alias("__b"), "__before", "__budget")
    got = c.join(F.broadcast(at), F.col("__bin") == F.col("__b"))
    so_far = F.col("__before") + F.sum("size").over(Window.partitionBy("__bin").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn("__so_far", so_far).where("__so_far >= __budget").agg(F.min("__place").alias("__cut"))


def mix(docs: DataFrame, seed: int = 0, max_repeats: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies, taken`` (= copies x size) and ``finish``.

    ``copies`` are the passes that the queue takes before the budget is reached; ``finish`` is the virtual finish
    time of the first copy: order by (finish + copy x source_size / target) for the mix's own order.
    """
    require(docs, "doc_id", "source", "text")
    sizes = cut(sized(docs, seed, *keep))
    times = cut(finish_times(sizes, max_repeats))  # narrow rows, read three times over
    got = times.crossJoin(F.broadcast(find_cut(times, sizes.count(), max_repeats)))  # the cut is one row
    taken = sum((F.when(_place(F.lit(k)) <= F.col("__cut"), 1).otherwise(0) for k in range(max_repeats)), F.lit(0))
    got = got.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"))
    got = got.withColumn("finish", F.col("cum").cast("double") / F.col("target"))
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "finish", *keep)


def mixed_documents(docs: DataFrame, seed: int = 0, max_repeats: int = 3) -> DataFrame:
    """The mix as documents: the rows and columns of ``docs``, each row as often as the mix takes it.

    Rows are numbered in a table of their own, so ids may be null or repeated; ``__row`` is taken as a column name.
    """
    require(docs, "doc_id", "source", "text")
    d = table_cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    m = mix(d, seed, max_repeats, ("__row",)).where("copies > 0").select(F.col("__row").alias("__r"), F.col("copies").cast("int").alias("__copies"))
    d = d.join(m, F.col("__row") == F.col("__r"))
    return d.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
