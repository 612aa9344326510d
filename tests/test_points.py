import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlake.functions.session import cut
from cinderlake.operators import graph, nearby, points as P
from cinderlake.sources import fixtures as X

SF = "/root/testdata/sf0.01"


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [25.0, 400.0])
def test_distance_joins_everywhere_on_the_sphere(spark, radius):
    r = np.random.default_rng(1)
    lat = np.degrees(np.arcsin(r.uniform(-1, 1, 500)))
    lon = r.uniform(-180, 180, 500)
    lat[:60], lon[:60] = r.uniform(86, 90, 60), r.uniform(-180, 180, 60)
    lat[60:160], lon[60:160] = r.uniform(-2, 2, 100), r.choice([-179.9, 179.9], 100) + r.uniform(-0.1, 0.1, 100)
    lon = (lon + 180) % 360 - 180
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    d = spark.createDataFrame(rows, "a int, latitude double, longitude double")
    got = sorted((x.a, x.b) for x in nearby.near_pairs(d, d.withColumnRenamed("a", "b"), radius).collect())
    want = sorted((i, j) for i, a, b in rows for j, c, e in rows if km((a, b), (c, e)) <= radius)
    assert got == want
    half = d.where("a % 2 = 0").select("latitude", "longitude")
    left = {x.a for x in nearby.anti_near(d.where("a % 2 = 1"), half, radius).collect()}
    assert left == {i for i, a, b in rows if i % 2 and all(km((a, b), (c, e)) > radius for j, c, e in rows if j % 2 == 0)}


def sequential_dbscan(pts, eps, least):
    near = [[j for j in range(len(pts)) if km(pts[i], pts[j]) <= eps * 6371.0] for i in range(len(pts))]
    label, n = [None] * len(pts), 0
    for i in range(len(pts)):
        if label[i] is not None or len(near[i]) < least:
            continue
        stack, label[i] = [i], n
        while stack:
            for j in near[stack.pop()]:
                if label[j] is None:
                    label[j] = n
                    if len(near[j]) >= least:
                        stack.append(j)
        n += 1
    single = 100_000
    for i in range(len(pts)):
        if label[i] is None:
            label[i] = single
            single += 1
    return label


def test_dbscan_equals_a_sequential_scan(spark):
    t = spark.sql("select explode(array(date '2024-01-16', date '2024-01-17')) as target_date")
    got = P.dbscan(P.fires_of_day(X.fires(spark, SF), t), 0.02).collect()
    for day in (16, 17):
        rows = sorted((r.event_id, r.latitude, r.longitude, r.cluster_id) for r in got if r.target_date.day == day)
        assert [r[3] for r in rows] == sequential_dbscan([r[1:3] for r in rows], 0.02, 5)
        assert any(r[3] < 100_000 for r in rows) and any(r[3] >= 100_000 for r in rows)


@pytest.mark.parametrize("where", [(50.0, -100.0), (0.0, 179.9), (84.0, 10.0)])
def test_dbscan_with_crowded_cells(spark, where):
    """Blobs far denser than the radius, some just within it of each other and some just beyond; copies of one place."""
    r = np.random.default_rng(3)
    eps = 0.01
    deg = math.degrees(eps)
    lat, lon = [], []
    for k, gap in enumerate((0.0, 1.02, 2.01, 3.3, 4.2, 5.19, 7.0)):
        n = (90, 60, 40, 70, 8, 50, 30)[k]
        lat += list(where[0] + r.uniform(-0.02, 0.02, n) * deg)
        lon += list(where[1] + (gap + r.uniform(-0.02, 0.02, n)) * deg / math.cos(math.radians(where[0])))
    lat += list(where[0] + r.uniform(-3, 3, 60) * deg) + [where[0] + 3.5 * deg] * 20
    lon += list(where[1] + r.uniform(-1, 8, 60) * deg / math.cos(math.radians(where[0]))) + [where[1]] * 20
    at = r.permutation(len(lat))
    rows = [(1, i, float(lat[j]), (float(lon[j]) + 180) % 360 - 180) for i, j in enumerate(at)]
    d = spark.createDataFrame(rows, "target_date int, event_id bigint, latitude double, longitude double")
    got = {x.event_id: x.cluster_id for x in P.dbscan(d, eps).collect()}
    p = P._fine_cells(d.withColumnRenamed("target_date", "k"), eps)
    boxes = P._boxes(p, ["k", "cell"]).where("n >= 5")
    nodes = p.join(boxes.select("cell", F.col("id").alias("node")), "cell")
    pairs = [{tuple(x) for x in P._touching(nodes, boxes, eps * 6371.0, few=few).select("a", "b").collect()} for few in (1, 4096)]
    assert pairs[0] == pairs[1] != set()
    want = sequential_dbscan([x[2:] for x in rows], eps, 5)
    assert [got[i] for i in range(len(rows))] == want and len({w for w in want if w < 100_000}) > 1


def test_cut_carries_no_constraints_along(spark):
    d = cut(spark.range(5).where("id > 1").withColumn("b", F.col("id")).select("id", "b", (F.col("id") + F.col("b")).alias("c")))
    assert d._jdf.queryExecution().optimizedPlan().constraints().size() == 0
    assert sorted(tuple(x) for x in d.collect()) == [(2, 2, 4), (3, 3, 6), (4, 4, 8)]


def test_labels_of_paths_stars_and_random_graphs(spark):
    r = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 130)] + [tuple(map(int, x)) for x in r.integers(300, 420, (90, 2))]
    up = list(range(430))
    for a, b in edges * 430:
        up[a] = up[b] = min(up[a], up[b])
    d = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a bigint, b bigint")
    got = {x.id: x.label for x in graph.min_labels(spark.range(430), d).collect()}
    assert got == dict(enumerate(up))


@pytest.mark.parametrize("limit,days", [(20.0, 15), (60.0, 3)])
def test_thinning_equals_a_sequential_pass(spark, limit, days):
    p = X.points(spark, SF).where("event_id < 6000")
    got = {r.event_id for r in P.thin(p, limit, days, (F.col("event_id") * 7919) % 1009).collect()}
    rows = sorted((r.event_id * 7919 % 1009, r.event_id, r.latitude, r.longitude, r.acq_date) for r in p.collect())
    kept = []
    for _, i, a, b, d in rows:
        if not any(km((a, b), (x, y)) < limit and abs((d - e).days) <= days for _, x, y, e in kept):
            kept.append((i, a, b, d))
    assert got == {k[0] for k in kept} and 0 < len(got) < len(rows)


def test_thinning_in_stages_writes_few_pairs(spark, monkeypatch):
    """1,500 points in one place: the stages after the first meet what is kept, not each other."""
    r = np.random.default_rng(7)
    rows = [(i, 50 + float(a), -100 + float(b), datetime.date(2024, 1, 1 + int(d))) for i, (a, b, d) in enumerate(zip(r.uniform(0, 1, 1500), r.uniform(0, 1, 1500), r.integers(0, 28, 1500)))]
    d = spark.createDataFrame(rows, "event_id bigint, latitude double, longitude double, acq_date date")
    written, real = [], P.conflicts

    def counted(*a):
        e = real(*a)
        written.append(e.count())
        return e

    monkeypatch.setattr(P, "conflicts", counted)
    got = {x.event_id for x in P.thin(d, 30.0, 10, F.col("event_id") * 7919 % 101, first=64).collect()}
    kept = []
    for i, a, b, day in sorted(rows, key=lambda x: (x[0] * 7919 % 101, x[0])):
        if not any(km((a, b), (x, y)) < 30 and abs((day - e).days) <= 10 for _, x, y, e in kept):
            kept.append((i, a, b, day))
    assert got == {x[0] for x in kept} and sum(written) < real(d, 30.0, 10).count() / 50


def test_strata_edge_cases(spark):
    rows = [("2024-01-01", i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7])] + [("2024-01-02", 50, 1.0)] + [("2024-01-03", 60 + i, 5.0) for i in range(4)] + [("2024-01-04", 70, 1.0), ("2024-01-04", 71, 2.0)]
    d = spark.createDataFrame(rows, "target_date string, event_id int, frp double")
    got, status = P.strata(d)
    assert {r.target_date: r.status for r in status.collect()} == {"2024-01-01": "ok", "2024-01-02": "no_strata", "2024-01-03": "no_strata", "2024-01-04": "ok"}
    assert [(r.frp, r.frp_bin) for r in got.orderBy("event_id").collect()] == [(1.0, "small"), (2.0, "small"), (3.0, "small"), (4.0, "medium"), (5.0, "medium"), (6.0, "large"), (7.0, "large"), (1.0, "small"), (2.0, "large")]


def test_small_graphs_take_one_job_not_rounds(spark, monkeypatch):
    """Rounds and one task give the same labels, the one task in two tables; also of many edges' partitions, loops and lone nodes."""
    rng = np.random.default_rng(5)
    chain = rng.permutation(600)
    pairs = [*zip(chain[:-1], chain[1:]), *rng.integers(600, 900, (150, 2)), (950, 950)]
    e = spark.createDataFrame([(int(x), int(y)) for a, b in pairs for x, y in ((a, b), (b, a))], "a bigint, b bigint").repartition(7)
    made, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d: made.append(1) or cut(d))
    one = {r.id: r.label for r in graph.min_labels(spark.range(1000), e).collect()}
    assert len(made) <= 2
    rounds = {r.id: r.label for r in graph.min_labels(spark.range(1000), e, few=0).collect()}
    assert one == rounds and len(one) == 1000 and {one[k] for k in range(600)} == {0} and one[950] == 950
    last = {r.id: r.label for r in graph.min_labels(spark.range(1000), e, few=300).collect()}
    assert last == one
    assert graph.min_labels(spark.range(3), e.where("false")).count() == 3


@pytest.fixture(scope="module")
def labelled(spark):
    fires = X.fires(spark, SF)
    t = spark.sql("select explode(sequence(date '2024-01-15', date '2024-01-17')) as target_date union all select date '2030-01-01'")
    rows, status = P.labelled_dataset(fires, t, X.RING, X.LAT_RANGE, X.LON_RANGE)
    return rows.collect(), status.collect(), fires.collect()


def test_labelled_points_invariants(labelled):
    rows, status, fires = labelled
    assert {r.status for r in status if r.target_date.year == 2030} == {"no_fires"}
    by_day = {}
    for r in rows:
        by_day.setdefault(r.target_date, []).append(r)
    inside = lambda a, o: sum(((y1 > a) != (y2 > a)) and o < (x2 - x1) * (a - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(X.RING, X.RING[1:] + X.RING[:1])) % 2 == 1
    assert len(by_day) == 3
    for day, got in by_day.items():
        pos, neg = ([r for r in got if r.is_fire == k] for k in (1, 0))
        window = [f for f in fires if abs((f.acq_date - day).days) <= 15]
        assert 0 < len(pos) <= 15 and 0 < len(neg) <= len(pos) + 5
        for r in pos:
            assert all(km((r.latitude, r.longitude), (f.latitude, f.longitude)) > 20 for f in window if f.acq_date < day)
        for i, r in enumerate(neg):
            assert inside(r.latitude, r.longitude) and r.frp == 0 and r.acq_date == day
            assert all(km((r.latitude, r.longitude), (f.latitude, f.longitude)) > 24.99 for f in window)
            assert all(km((r.latitude, r.longitude), (s.latitude, s.longitude)) > 14.99 for s in neg[:i])


def test_positives_plan_holds_no_distance_join(spark):
    """Rows and status read the fresh ones, and do not each plan clusters and distances again."""
    t = spark.sql("select date '2024-01-16' as target_date")
    for d in P.positives(X.fires(spark, SF), t, X.RING):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and plan.count("Window") == 0 and plan.count("Join") <= 2
        assert d.count() > 0


def test_negatives_plan_holds_no_distance_join(spark):
    """Candidates, those near a fire and the accepted ones are tables: what is left to plan, and to run twice for the order, is small."""
    fires, t = X.fires(spark, SF), spark.sql("select date '2024-01-16' as target_date")
    pos, _ = P.positives(fires, t, X.RING)
    for d in (P.negatives(pos, fires, t, X.RING, X.LAT_RANGE, X.LON_RANGE), P.labelled_dataset(fires, t, X.RING, X.LAT_RANGE, X.LON_RANGE)[0]):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "FlatMapGroups" not in plan and d.count() > 0


def test_few_against_many_equals_the_anti_join(spark):
    """Also with null places, equal rows, both sides of 180 degrees and a condition on more columns."""
    rng = np.random.default_rng(3)
    left = [(int(k % 40), float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(-89, 89, 80), rng.uniform(-180, 180, 80)))] + [(1, None, 3.0), (2, 10.0, 179.99), (2, 10.0, 179.99), (3, 89.9, 0.0)]
    right = [(int(k % 40), float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(-89, 89, 900), rng.uniform(-180, 180, 900)))] + [(2, 10.0, -179.99), (3, 89.9, 180.0), (4, None, None)]
    a, b = spark.createDataFrame(left, "k int, latitude double, longitude double"), spark.createDataFrame(right, "r_k int, latitude double, longitude double")
    for when in (None, F.col("k") == F.col("r_k")):
        for inclusive in (True, False):
            want, got = (sorted(map(str, f(a, b, 400.0, inclusive, when).collect())) for f in (nearby.anti_near, nearby.anti_near_few))
            assert got == want and 0 < len(got) < len(left)


def test_labelled_points_are_reproducible(spark, labelled):
    t = spark.sql("select explode(sequence(date '2024-01-15', date '2024-01-17')) as target_date")
    again, _ = P.labelled_dataset(X.fires(spark, SF), t, X.RING, X.LAT_RANGE, X.LON_RANGE)
    assert again.collect() == labelled[0]


def test_spacing_fold_is_ordered(spark):
    d = datetime.date(2024, 1, 1)
    rows = [(d, 0, 1, 1, 50.0, -100.0, 5), (d, 0, 1, 2, 51.0, -100.0, 5), (d, 0, 2, 1, 50.05, -100.0, 6), (d, 0, 2, 2, 52.0, -100.0, 6), (d, 1, -1, 1, 52.01, -100.0, 7), (d, 1, -1, 2, 54.0, -100.0, 7), (d, 1, -1, 3, 55.0, -100.0, 7)]
    c = spark.createDataFrame(rows, "target_date date, kind int, event_id bigint, attempt int, latitude double, longitude double, acq_time int")
    got = sorted((r.kind, r.event_id, r.attempt) for r in P.accept_spaced(c, 15.0, 1).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, -1, 2)]


def test_calendar_and_empty_frames(spark):
    assert P.calendar(spark, [2023, 2024], [2], [28, 29]).count() == 3
    none = X.fires(spark, SF).where("false")
    t = spark.sql("select date '2024-01-16' as target_date")
    assert P.dbscan(P.fires_of_day(none, t)).count() == 0 and P.thin(none.withColumn("is_fire", F.lit(0))).count() == 0
    rows, status = P.positives(none, t)
    assert rows.count() == 0 and [r.status for r in status.collect()] == ["no_fires"]
