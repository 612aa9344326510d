"""Labelled points: clustering, fresh ignitions, strata, negatives, thinning. All dates are in one frame, keyed by
``target_date``; a point has ``event_id, latitude, longitude, acq_date, acq_time, bright_ti4, frp``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from ..functions.geo import EARTH_KM, haversine, in_ring, offset, unit_hash
from ..functions.session import cut, ship
from .graph import first_independent_set, min_labels
from .nearby import anti_near, anti_near_few, near_pairs

POINT = ["latitude", "longitude", "acq_date", "acq_time", "bright_ti4", "frp", "is_fire"]


def calendar(spark, years: list[int], months: list[int], days: list[int]) -> DataFrame:
    """``target_date`` of every year x month x day that exists."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, years))).alias("y"))
    d = one.withColumn("m", F.explode(F.array(*map(F.lit, months)))).withColumn("d", F.explode(F.array(*map(F.lit, days))))
    return d.select(F.try_to_date(F.format_string("%04d-%02d-%02d", "y", "m", "d"), "yyyy-MM-dd").alias("target_date")).where("target_date is not null")


def day_offset(df: DataFrame, date_col: str = "acq_date") -> DataFrame:
    """The date column becomes days since the frame's first date (one row, joined back)."""
    first = df.agg(F.min(date_col).alias("__first"))
    return df.crossJoin(F.broadcast(first)).withColumn(date_col, F.datediff(date_col, "__first")).drop("__first")


def window_fires(fires: DataFrame, targets: DataFrame, buffer_days: int = 15) -> DataFrame:
    """Fires of ``[d - buffer, d + buffer]`` for every target date: an equi-join on the date."""
    t = targets.select("target_date", F.explode(F.sequence(F.date_sub("target_date", buffer_days), F.date_add("target_date", buffer_days))).alias("__d"))
    return fires.join(t, fires.acq_date == F.col("__d")).drop("__d")


def fires_of_day(fires: DataFrame, targets: DataFrame, ring=None) -> DataFrame:
    """Each target date's own fires inside the country."""
    d = fires.join(targets.select("target_date"), fires.acq_date == F.col("target_date"))
    return d.where(in_ring("latitude", "longitude", ring))


def _same_date(prefix: str = "r_") -> Column:
    return F.col("target_date") == F.col(f"{prefix}target_date")


def fresh(candidates: DataFrame, fires: DataFrame, targets: DataFrame, km: float = 20.0, lookback_days: int = 15, anti=anti_near) -> DataFrame:
    """Candidates more than ``km`` from every fire of the days before (country or not); without past fires all stay."""
    past = window_fires(fires, targets, lookback_days).where("acq_date < target_date")
    past = past.select("latitude", "longitude", F.col("target_date").alias("r_target_date"))
    return anti(candidates, past, km, True, _same_date())


def safe(candidates: DataFrame, fires: DataFrame, targets: DataFrame, km: float = 25.0, buffer_days: int = 15, anti=anti_near) -> DataFrame:
    """Candidates more than ``km`` from every fire of the window on both sides of the date."""
    near = window_fires(fires, targets, buffer_days).select("latitude", "longitude", F.col("target_date").alias("r_target_date"))
    return anti(candidates, near, km, True, _same_date())


def _fine_cells(points: DataFrame, eps: float) -> DataFrame:
    """Points with ``cell`` (any two of one cell are within ``eps`` radians) and ``u``, ``v``, the place inside it in 0..1."""
    side = 2 * np.sin(min(eps, np.pi) / 2) / np.sqrt(2) * 0.9999  # hav <= (side / 2)^2 * 2 < sin(eps / 2)^2
    y = F.radians(F.col("latitude") + 90.0) / side
    i = F.floor(y)
    near = F.when((i * side < np.pi / 2) & ((i + 1) * side > np.pi / 2), 0.0).otherwise(F.least(F.abs(i * side - np.pi / 2), F.abs((i + 1) * side - np.pi / 2)))
    x = F.radians(F.col("longitude")) / (side / F.greatest(F.cos(near), F.lit(1e-6)))
    j = F.floor(x)
    return points.withColumns({"cell": F.struct(i.alias("i"), j.alias("j")), "u": y - i, "v": x - j})


def _boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, id`` (the smallest event id) and the bounds ``s, t, w, e`` of each group's points."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("event_id").alias("id"), F.min("latitude").alias("s"), F.max("latitude").alias("t"), F.min("longitude").alias("w"), F.max("longitude").alias("e")
    )


def _box_km(p: str, q: str) -> tuple[Column, Column]:
    """Least and largest distance that points of two boxes can have (bounds, not attained)."""
    c = lambda x, n: F.radians(F.col(x + n))
    flat = lambda x: F.when((c(x, "s") <= 0) & (c(x, "t") >= 0), 0.0).otherwise(F.least(F.abs(c(x, "s")), F.abs(c(x, "t"))))
    steep = lambda x: F.greatest(F.abs(c(x, "s")), F.abs(c(x, "t")))
    up = F.greatest(F.lit(0.0), c(p, "s") - c(q, "t"), c(q, "s") - c(p, "t"))
    turn = lambda k: F.greatest(F.lit(0.0), c(p, "w") - c(q, "e") + k, c(q, "w") - c(p, "e") - k)
    east = F.least(*(turn(F.lit(k * 2 * np.pi)) for k in (-1, 0, 1)))
    far_up = F.greatest(c(p, "t") - c(q, "s"), c(q, "t") - c(p, "s"))
    span = lambda k: F.greatest(c(p, "e") - c(q, "w") + k, c(q, "e") - c(p, "w") - k)
    far_east = F.least(*(span(F.lit(k * 2 * np.pi)) for k in (-1, 0, 1)), F.lit(np.pi))
    dist = lambda a, b, f: 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.pow(F.sin(a / 2), 2) + F.cos(f(p)) * F.cos(f(q)) * F.pow(F.sin(b / 2), 2))))
    return dist(up, east, steep), dist(far_up, far_east, flat)


def _touching(points: DataFrame, boxes: DataFrame, km: float, levels: int = 5, few: int = 4096) -> DataFrame:
    """``a, b``: nodes of crowded cells that hold points within ``km`` of each other (``a`` < ``b``).

    Bounds of the cells' boxes decide most pairs. Of the others, those of at most ``few`` pairs of points are measured; larger ones
    are split into pairs of smaller boxes, eight to a side each time, until one is near enough or ``levels`` are done.
    """
    bounds = ("n", "s", "t", "w", "e")
    part = lambda n: F.concat_ws(",", F.floor(F.col("u") * 8**n), F.floor(F.col("v") * 8**n)) if n else F.lit("")
    low, high = _box_km("a", "b")
    state = F.when(high <= km * (1 - 1e-9), 1).when(low > km * (1 + 1e-9), -1).otherwise(0).alias("state")
    columns = ["a", "b", "x", "y", state, (F.col("an") * F.col("bn") <= few).alias("few")]

    def measured(pairs, level):
        at = points.select("node", part(level).alias("cell"), "latitude", "longitude").distinct()  # copies of a place count once
        place = lambda a, x: at.select(F.col("node").alias(a), F.col("cell").alias(x), F.col("latitude").alias(a + "lat"), F.col("longitude").alias(a + "lon"))
        d = pairs.select("a", "b", "x", "y").join(place("a", "x"), ["a", "x"]).join(place("b", "y"), ["b", "y"])
        return d.where(haversine("alat", "alon", "blat", "blon") <= km).select("a", "b").distinct()

    side = lambda x: boxes.select(((F.col("s") + F.col("t")) / 2).alias("latitude"), ((F.col("w") + F.col("e")) / 2).alias("longitude"), F.col("k").alias("k" + x), F.col("id").alias(x), *(F.col(c).alias(x + c) for c in bounds))
    # a centre is within km of its cell's points
    found = near_pairs(side("a"), side("b"), 3 * km, F.col("ka") == F.col("kb")).where("a < b").withColumns({"x": F.lit(""), "y": F.lit("")})
    met = []
    for level in range(levels + 1):
        found = cut(found.select(*columns).where("state >= 0"))
        met.append(found.where("state = 1").select("a", "b").distinct())
        left = cut(found.where("state = 0").join(met[-1], ["a", "b"], "left_anti"))
        small = left if level == levels else left.where("few")
        met.append(measured(small, level))
        left = left.where("not few")
        if level == levels or not left.limit(1).count():
            break
        own = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        split = cut(_boxes(points.join(own, "node", "left_semi").withColumns({"old": part(level), "new": part(level + 1)}), ["node", "old", "new"]))
        child = lambda a, x: split.select(F.col("node").alias(a), F.col("old").alias(x), F.col("new").alias("n" + x), *(F.col(c).alias(a + c) for c in bounds))  # noqa: B023, E731
        found = left.select("a", "b", "x", "y").join(child("a", "x"), ["a", "x"]).join(child("b", "y"), ["b", "y"]).drop("x", "y").withColumnsRenamed({"nx": "x", "ny": "y"})
    return reduce(DataFrame.unionByName, met)


def dbscan(points: DataFrame, eps: float = 0.012, min_points: int = 5, key: str = "target_date") -> DataFrame:
    """Points with ``cluster_id``: density clusters on the sphere (eps in radians), numbered from 0 by their lowest core
    point within each ``key``; noise points are singletons 100000, 100001, ... in order of id.

    A border point belongs to the adjacent cluster with the lowest number, as in a sequential scan. Cells are so small
    that points of one cell are neighbours. A cell of ``min_points`` or more is all core and one node of the cluster graph;
    only pairs with a point of another cell's sparse few are written out, and crowded cells are compared by boxes.
    """
    km = eps * EARTH_KM
    p = cut(_fine_cells(points.select("event_id", "latitude", "longitude", F.col(key).alias("k")), eps))
    boxes = cut(_boxes(p, ["k", "cell"]).where(F.col("n") >= min_points))
    p = p.join(boxes.select("k", "cell", F.col("id").alias("node")), ["k", "cell"], "left")  # node: of a crowded cell
    # pairs with a point of a sparse cell: each point has few of them around, however crowded its own cell is
    left = p.where("node is null").select("latitude", "longitude", F.col("event_id").alias("a"), F.col("k").alias("ka"))
    right = p.select("latitude", "longitude", F.col("event_id").alias("b"), F.col("k").alias("kb"), F.col("node").alias("nb"))
    pairs = cut(near_pairs(left, right, km, F.col("ka") == F.col("kb")).select("a", "b", "nb"))
    core = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("a"))
    lone = core.select(F.col("a").alias("b"), F.col("a").alias("c"))
    with_core = cut(pairs.join(lone, "b", "left").select("a", F.coalesce("nb", "c").alias("b")).where("b is not null").distinct())  # (sparse point, node of a core neighbour)
    edges = with_core.join(core, "a", "left_semi").unionByName(_touching(p.where("node is not null"), boxes, km))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # a union would plan the edges twice
    edges = cut(edges.where("a <> b").select(F.explode(both).alias("e")).select("e.*").distinct())
    node = min_labels(core.select(F.col("a").alias("id")).unionByName(boxes.select("id")), edges)
    # a core point is its own core neighbour, so the lowest label around it is its own
    sparse = with_core.join(node, with_core.b == node.id).groupBy("a").agg(F.min("label").alias("__label"))
    crowded = p.where("node is not null").join(node, F.col("node") == F.col("id")).select(F.col("event_id").alias("a"), F.col("label").alias("__label"))
    labels = cut(sparse.unionByName(crowded))
    d = points.join(labels, points.event_id == labels.a, "left").drop("a")
    noise = F.col("__label").isNull()
    number = F.dense_rank().over(Window.partitionBy(key, noise).orderBy("__label")) - 1
    single = F.row_number().over(Window.partitionBy(key, noise).orderBy("event_id")) - 1 + 100_000
    return d.withColumn("cluster_id", F.when(noise, single).otherwise(number).cast("int")).drop("__label")


def best_per_group(df: DataFrame, keys: list[str], value: str, tie: str = "event_id") -> DataFrame:
    """Whole row of each group's largest value; ties go to the smallest id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), tie)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def strata(df: DataFrame, key: str = "target_date", value: str = "frp") -> tuple[DataFrame, DataFrame]:
    """(rows with ``frp_bin``, status per key). Terciles are exact with linear interpolation, right-closed, lowest included.

    A date whose cut points coincide (one row, or heavy ties) has no strata: it yields no rows and the status says so.
    """
    q = df.groupBy(key).agg(F.percentile(value, F.array(*map(F.lit, (0.0, 1 / 3, 2 / 3, 1.0)))).alias("q"), F.count("*").alias("n"))
    ok = (F.col("q")[0] < F.col("q")[1]) & (F.col("q")[1] < F.col("q")[2]) & (F.col("q")[2] < F.col("q")[3])
    status = q.select(key, "n", F.when(ok, "ok").otherwise("no_strata").alias("status"))
    good = q.where(ok).select(F.col(key).alias("__k"), "q")
    name = F.when(F.col(value) <= F.col("q")[1], "small").when(F.col(value) <= F.col("q")[2], "medium").otherwise("large")
    return df.join(good, F.col(key) == F.col("__k")).withColumn("frp_bin", name).drop("__k", "q"), status


def _k_means(x: np.ndarray, k: int, restarts: int = 10, rounds: int = 100, seed: int = 42) -> np.ndarray:
    """Labels of the best of several Lloyd runs from k-means++ starts."""
    r = np.random.default_rng(seed)
    best = (np.inf, None)
    for _ in range(restarts):
        c = x[[r.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
            c = np.vstack([c, x[r.choice(len(x), p=d / d.sum()) if d.sum() else r.integers(len(x))]])
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[own]) ** 2).sum()
        if cost < best[0]:
            best = (cost, own)
    return best[1]


def diverse_sample(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Groups of at most ``n`` rows whole; of larger ones the strongest of each of ``n`` k-means clusters on degrees.

    A group is one date's stratum: bounded by what one satellite day holds for one country.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id", kind="stable")
        if len(pdf) <= n:
            return pdf
        own = _k_means(pdf[["latitude", "longitude"]].to_numpy(float), n)
        pdf = pdf.assign(__own=own).sort_values(["frp", "event_id"], ascending=[False, True], kind="stable")
        return pdf.drop_duplicates("__own").drop(columns="__own").sort_values("event_id")

    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(pick, df.schema)


def positives(fires: DataFrame, targets: DataFrame, ring=None, eps: float = 0.012, km: float = 20.0, lookback_days: int = 15, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(labelled positives by target date, status by target date): country filter, density clusters, brightest of each,
    fresh ignitions, strata, spatially diverse sample.

    The clusters' brightest and the fresh ones are cut (the former by the distance join): terciles, rows and status all read the latter,
    and would each plan and run the clusters and the distance join again.
    """
    day = fires_of_day(fires, targets, ring)
    bright = best_per_group(dbscan(day, eps), ["target_date", "cluster_id"], "bright_ti4")
    found, status = strata(cut(fresh(bright, fires, targets, km, lookback_days, anti_near_few)))
    status = targets.select("target_date").join(status, "target_date", "left").select("target_date", F.coalesce("n", F.lit(0)).alias("n_fresh"), F.coalesce("status", F.lit("no_fires")).alias("status"))
    got = diverse_sample(found, ["target_date", "frp_bin"], n)
    return got.withColumn("is_fire", F.lit(1)), status


def median_time(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Median ``acq_time`` by target date, truncated; 1900 without points."""
    m = points.groupBy("target_date").agg(F.percentile("acq_time", F.lit(0.5)).cast("int").alias("m"))
    return targets.select("target_date").join(m, "target_date", "left").select("target_date", F.coalesce("m", F.lit(1900)).alias("median_time"))


def hard_candidates(positive: DataFrame, tries: int = 30, low: float = 30.0, high: float = 70.0, seed: int = 0) -> DataFrame:
    """``tries`` shifted places for each positive, by hash: distance U(low, high) km, angle U(0, 2 pi)."""
    d = positive.select("target_date", "event_id", "acq_time", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"), F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("attempt"))
    dist = low + (high - low) * unit_hash("target_date", "event_id", "attempt", seed=seed)
    angle = 2 * np.pi * unit_hash("target_date", "event_id", "attempt", seed=seed + 1)
    lat, lon = offset("p_lat", "p_lon", dist, angle)
    return d.withColumn("latitude", lat).withColumn("longitude", lon).drop("p_lat", "p_lon")


def random_candidates(targets: DataFrame, lat: tuple[float, float], lon: tuple[float, float], tries: int = 150, seed: int = 10) -> DataFrame:
    """``tries`` places in the country's box for each date, by hash."""
    d = targets.select("target_date", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("attempt"))
    return d.withColumn("latitude", lat[0] + (lat[1] - lat[0]) * unit_hash("target_date", "attempt", seed=seed)).withColumn("longitude", lon[0] + (lon[1] - lon[0]) * unit_hash("target_date", "attempt", seed=seed + 1))


def _km(lat, lon, lats, lons):
    a, b = np.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.asarray(lons) - lon) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))


def accept_spaced(candidates: DataFrame, spacing_km: float = 15.0, n_random: int = 5) -> DataFrame:
    """Fold each date's verified candidates in order: hard ones by positive (first acceptable attempt of each), then random
    ones until ``n_random``; a candidate within ``spacing_km`` of an accepted (rounded) one is rejected.

    ``candidates``: ``target_date, kind`` (0 hard, 1 random), ``event_id`` (null for random), ``attempt, latitude, longitude, acq_time``.
    A date's candidates are a bounded number (30 for each of at most 15 positives, and 150).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kind", "event_id", "attempt"], kind="stable")
        took, done, lats, lons, n = [], set(), [], [], 0
        for i, (kind, event, lat, lon) in enumerate(zip(pdf["kind"], pdf["event_id"], pdf["latitude"], pdf["longitude"], strict=True)):
            if (kind == 0 and event in done) or (kind == 1 and n >= n_random):
                continue
            if lats and _km(lat, lon, np.array(lats), np.array(lons)).min() <= spacing_km:
                continue
            took.append(i)
            lats.append(round(lat, 5))
            lons.append(round(lon, 5))
            if kind == 0:
                done.add(event)
            else:
                n += 1
        out = pdf.iloc[took].copy()
        out["latitude"], out["longitude"] = lats, lons
        return out

    ship(candidates.sparkSession)
    return candidates.groupBy("target_date").applyInPandas(fold, candidates.schema)


def negatives(positive: DataFrame, fires: DataFrame, targets: DataFrame, ring, lat_range, lon_range, safe_km: float = 25.0, spacing_km: float = 15.0, n_random: int = 5, buffer_days: int = 15) -> DataFrame:
    """Hard and random negatives of every date with ``kind``. Country and fire distance are set-based (they depend on the
    candidate alone); only the spacing is a fold. Candidates are few against the fires, so they are what is copied to cells, and what
    is verified is cut: the driver plans the steps one by one."""
    cols = ["target_date", "kind", "event_id", "attempt", "latitude", "longitude", "acq_time"]
    hard = hard_candidates(positive).withColumn("kind", F.lit(0))
    rand = random_candidates(targets, lat_range, lon_range).join(median_time(positive, targets), "target_date")
    rand = rand.withColumn("kind", F.lit(1)).withColumn("event_id", F.lit(-1).cast("long")).withColumnRenamed("median_time", "acq_time")
    c = hard.withColumn("event_id", F.col("event_id").cast("long")).select(*cols).unionByName(rand.select(*cols))
    c = safe(c.where(in_ring("latitude", "longitude", ring)), fires, targets, safe_km, buffer_days, anti_near_few)
    got = cut(accept_spaced(cut(c.select(*cols)), spacing_km, n_random))
    return got.select("target_date", "kind", "latitude", "longitude", F.col("target_date").alias("acq_date"), F.col("acq_time").cast("int").alias("acq_time"), F.lit(0.0).alias("bright_ti4"), F.lit(0.0).alias("frp"), F.lit(0).alias("is_fire"))


def labelled_dataset(fires: DataFrame, targets: DataFrame, ring, lat_range, lon_range, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(all dates' positives and negatives in a shuffled order fixed by content, status by date)."""
    pos, status = positives(fires, targets, ring)
    pos, status = cut(pos), cut(status)
    ok = status.where("status = 'ok'").select("target_date")
    neg = negatives(pos, fires, ok, ring, lat_range, lon_range)
    both = pos.select("target_date", *POINT).unionByName(neg.select("target_date", *POINT))
    return both.orderBy(unit_hash("target_date", "latitude", "longitude", "is_fire", seed=seed)), status


def conflicts(points: DataFrame, km: float, days: int) -> DataFrame:
    """``a, b`` in both directions: points nearer than ``km`` and at most ``days`` apart."""
    # days are part of the key: buckets of days + 1, each point in its own and the left one in its neighbours' too
    bucket = F.floor(F.unix_date("acq_date") / (days + 1))
    p = points.select("latitude", "longitude", F.col("event_id").alias("a"), F.col("acq_date").alias("da"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("ka"))
    q = points.select("latitude", "longitude", F.col("event_id").alias("b"), F.col("acq_date").alias("db"), bucket.alias("kb"))
    d = near_pairs(p, q, km, F.col("ka") == F.col("kb")).where((F.col("a") != F.col("b")) & (F.col("km") < km) & (F.abs(F.datediff("da", "db")) <= days))
    return d.select("a", "b")


def _stages(order: DataFrame, first: int) -> list[tuple]:
    """``(priority, id)`` bounds that divide the order into about ``first``, 3, 12, 48, ... times ``first`` rows; from a sample, for
    it only says where one stage ends and the next begins."""
    n = order.count()
    seen = sorted(tuple(x) for x in order.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // 20_000))) == 0).select("priority", "id").collect()) if n > first else []
    sizes = [first]
    while sizes[-1] * 4 < n:
        sizes.append(sizes[-1] * 4)
    return [seen[min(len(seen) - 1, k * len(seen) // n)] for k in sizes] if seen else []


def thin(points: DataFrame, km: float = 40.0, days: int = 15, priority: Column | None = None, seed: int = 42, first: int = 4096) -> DataFrame:
    """Greedy thinning in a random order fixed by content: what a sequential pass in order of priority keeps.

    The order is taken in stages, each three times as long as all before it. Points of a stage near one already kept go by a distance
    join with the kept ones, which are sparse; pairs are written only among the few that are left.
    """
    p = points.withColumn("priority", unit_hash("event_id", seed=seed) if priority is None else priority)
    p = cut(p.select("event_id", F.col("event_id").alias("id"), "latitude", "longitude", "acq_date", "priority"))
    stage, kept = F.lit(0), None
    bounds = _stages(p, first)
    for at, i in bounds:
        stage = stage + (F.struct("priority", "id") > F.struct(F.lit(at).alias("priority"), F.lit(i).alias("id"))).cast("int")
    for k in range(len(bounds) + 1):
        d = p.where(stage == k)
        if kept is not None:
            bucket = F.floor(F.unix_date("acq_date") / (days + 1))
            near = kept.select("latitude", "longitude", F.col("acq_date").alias("r_date"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("r_k"))
            d = anti_near(d.withColumn("__k", bucket), near, km, False, (F.col("__k") == F.col("r_k")) & (F.abs(F.datediff("acq_date", "r_date")) <= days)).drop("__k")
        d = cut(d)
        new = d.join(first_independent_set(d.select("id", "priority"), conflicts(d, km, days)), "id", "left_semi").select("id", "latitude", "longitude", "acq_date")
        kept = cut(new if kept is None else kept.unionByName(new))
    return points.join(kept.select(F.col("id").alias("event_id")), "event_id", "left_semi")
