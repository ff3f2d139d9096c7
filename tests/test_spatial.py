"""Tile joins and rain fusion against brute force on small networks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raincourse.operators import fusion
from raincourse.operators import joins as J
from raincourse.operators import spatial as S
from raincourse.operators.spatial import box_join, radius_join


def haversine(a, b):
    p1, p2 = np.radians(a[:, 0])[:, None], np.radians(b[:, 0])[None, :]
    dl = np.radians(b[:, 1][None, :] - a[:, 1][:, None])
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    return 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


@pytest.fixture(scope="module")
def places():
    rng = np.random.default_rng(2)
    cells = np.column_stack([rng.uniform(-11, 6, 300), rng.uniform(95, 141, 300)])
    cells[:100] = [-6.2, 106.8] + rng.normal(0, 0.2, (100, 2))  # a third of all rows in one place
    return cells, np.column_stack([rng.uniform(-11, 6, 80), rng.uniform(95, 141, 80)])


def frames(spark, places):
    cells, gauges = places
    c = spark.createDataFrame([(1, i, float(a), float(b), 5.0 + i % 7) for i, (a, b) in enumerate(cells)], "t int, cell_id long, lat double, lon double, background double")
    g = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(gauges)], "t int, gauge_id long, g_lat double, g_lon double")
    return c, g


@pytest.mark.parametrize("radius, tile", [(150.0, None), (700.0, 200.0)])
def test_radius_join(spark, places, radius, tile):
    c, g = frames(spark, places)
    got = {(r.cell_id, r.gauge_id) for r in radius_join(c, g.drop("t"), radius, 11.0, tile_km=tile).collect()}
    assert got == set(zip(*map(lambda x: x.tolist(), np.where(haversine(*places) <= radius))))


def test_box_join(spark, places):
    c, _ = frames(spark, places)
    boxes = spark.createDataFrame([(1, -8.0, -5.0, 105.0, 110.5), (2, -11.0, 6.0, 95.0, 141.0), (3, 0.0, 0.5, 100.0, 100.2)], "b int, lat_min double, lat_max double, lon_min double, lon_max double")
    got = sorted((r.b, r.cell_id) for r in box_join(c, boxes).collect())
    want = sorted((b, i) for b, a0, a1, o0, o1 in [(1, -8, -5, 105, 110.5), (2, -11, 6, 95, 141), (3, 0, .5, 100, 100.2)]
                  for i, (a, o) in enumerate(places[0]) if a0 <= a <= a1 and o0 <= o <= o1)
    assert got == want


def test_optimal_interpolation(spark, places):
    c, g = frames(spark, places)
    innovation = np.linspace(-6, 9, 80)
    g = g.withColumn("innovation", F.lit(-6.0) + F.col("gauge_id") * (15.0 / 79))
    got = np.array([r.analysis for r in fusion.optimal_interpolation(c, g, "t").orderBy("cell_id").collect()])
    inv = np.linalg.inv(4.0 * np.exp(-0.5 * (haversine(places[1], places[1]) / 50) ** 2) + 2.25 * np.eye(80))
    d = haversine(*places)
    want = []
    for i in range(300):
        bg, near = 5.0 + i % 7, np.where(d[i] <= 150)[0]
        step = 4.0 * np.exp(-0.5 * (d[i, near] / 50) ** 2) @ inv[np.ix_(near, near)] @ innovation[near]
        want.append(max(bg + step, 0.0) if len(near) else bg)
    assert got == pytest.approx(np.array(want), abs=1e-9)


def test_zero_innovation_returns_the_background(spark, places):
    c, g = frames(spark, places)
    out = fusion.optimal_interpolation(c, g.withColumn("innovation", F.lit(0.0)), "t")
    assert out.filter(F.abs(F.col("analysis") - F.col("background")) > 1e-12).count() == 0


def test_kriging_bias(spark, places):
    c, g = frames(spark, places)
    ratio = 0.5 + (np.arange(80) % 9) / 4
    out = fusion.kriging_bias(c, g.withColumn("ratio", 0.5 + (F.col("gauge_id") % 9) / 4), "t").orderBy("cell_id").collect()
    m = np.ones((81, 81))
    m[:80, :80] = 1.5 * np.exp(-haversine(places[1], places[1]) / 45)
    m[80, 80] = 0
    w = np.linalg.pinv(m) @ np.vstack([1.5 * np.exp(-haversine(*places) / 45).T, np.ones(300)])
    assert [r.bias for r in out] == pytest.approx(list(np.clip(ratio @ w[:80], 0.1, 5)), abs=1e-8)


def test_few_gauges_give_no_correction(spark, places):
    c, g = frames(spark, places)
    two = g.filter("gauge_id < 2").withColumn("ratio", F.lit(3.0))
    assert fusion.kriging_bias(c, two, "t").filter("abs(bias - 1) > 1e-12").count() == 0
    assert fusion.idw_bias(c, two, "t").filter("abs(bias - 1) > 1e-12").count() == 0


def test_idw_bias(spark, places):
    c, g = frames(spark, places)
    ratio = 0.5 + (np.arange(80) % 9) / 4
    out = fusion.idw_bias(c, g.withColumn("ratio", 0.5 + (F.col("gauge_id") % 9) / 4), "t", 600.0).orderBy("cell_id").collect()
    cells, sites = places
    w = ((cells[:, None, :] - sites[None, :, :]) ** 2).sum(axis=2) + 1e-12
    w = np.where(haversine(*places) <= 600, w ** -2.0, 0.0)
    want = np.where((w > 0).sum(axis=1) >= 3, (w @ ratio) / np.maximum(w.sum(axis=1), 1e-300), 1.0)
    assert [r.bias for r in out] == pytest.approx(list(want), abs=1e-9)


def test_as_of_join_with_a_hot_key(spark):
    f = spark.createDataFrame([(1, t, float(t)) for t in range(0, 1000, 7)] + [(2, 500, 5.0)], "k int, t long, v double")
    r = spark.createDataFrame([(i, 1 if i % 5 else 2, i * 3) for i in range(300)], "id int, k int, t long")
    got = {x.id: x.v for x in J.as_of(r, f, ["k"], "t", ["v"], 50, "id").collect()}
    assert len(got) == 300
    for i in range(300):
        t = i * 3
        assert got[i] == (float(t // 7 * 7) if i % 5 else (5.0 if t >= 500 else None))


def test_substring_and_prefix_joins(spark):
    rows = spark.createDataFrame([(1, "river citarum upper"), (2, "solo"), (3, "ci")], "id int, name string")
    dim = spark.createDataFrame([("citarum",), ("solo",), ("ci",)], "code string")
    assert sorted((r.id, r.code) for r in J.substring_join(rows, "name", dim, "code").collect()) == [(1, "ci"), (1, "citarum"), (2, "solo"), (3, "ci")]
    assert sorted((r.id, r.code) for r in J.prefix_join(rows, "name", dim, "code").collect()) == [(2, "solo"), (3, "ci")]


def test_radius_join_crosses_the_date_line(spark):
    left = spark.createDataFrame([(0.0, 179.9), (0.0, -179.9), (0.0, 0.0)], "lat double, lon double")
    right = spark.createDataFrame([(0.0, -179.9), (0.0, 179.9)], "g_lat double, g_lon double")
    got = sorted((r.lon, r.g_lon) for r in radius_join(left, right, 50, 1.0).collect())
    assert got == [(-179.9, -179.9), (-179.9, 179.9), (179.9, -179.9), (179.9, 179.9)]


@pytest.mark.parametrize("low, high", [(55, 65), (80, 90)])
def test_radius_join_takes_its_bound_from_the_data(spark, low, high):
    rng = np.random.default_rng(5)
    a, b = (np.column_stack([rng.uniform(low, high, n), rng.uniform(-180, 180, n)]) for n in (300, 200))
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "i int, lat double, lon double")
    right = spark.createDataFrame([(j, float(x), float(y)) for j, (x, y) in enumerate(b)], "j int, g_lat double, g_lon double")
    got = sorted((r.i, r.j) for r in radius_join(left, right, 400.0).collect())
    assert got == sorted(zip(*map(lambda x: x.tolist(), np.where(haversine(a, b) <= 400.0))))


def test_boxes_at_points_of_all_sizes(spark):
    rng = np.random.default_rng(8)
    boxes = [(k, float(x), float(y), float(min(x + w, 180)), float(min(y + h, 90))) for k, (x, y, w, h) in enumerate(zip(
        rng.uniform(-180, 179, 300), rng.uniform(-90, 89, 300), 10 ** rng.uniform(-4, 2.3, 300), 10 ** rng.uniform(-4, 2, 300)))]
    boxes += [(300, -180.0, -90.0, 180.0, 90.0), (301, 10.0, 10.0, 10.0, 10.0)]
    points = [(k, float(y), float(x)) for k, (y, x) in enumerate(zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)))] + [(60, 10.0, 10.0), (61, boxes[5][2], boxes[5][1])]
    found = S.boxes_at_points(spark.createDataFrame(boxes, "b int, west double, south double, east double, north double"), spark.createDataFrame(points, "p int, lat double, lon double"))
    want = sorted((b, p) for b, w, s, e, n in boxes for p, lat, lon in points if w <= lon <= e and s <= lat <= n)
    assert sorted((r.b, r.p) for r in found.collect()) == want and len(want) > 60


def test_fusion_across_180_degrees_and_in_crowds(spark, places):
    """Far north and over the date line the result is that of a direct solution; a crowd of gauges is cut into pieces."""
    cells, gauges = (np.column_stack([p[:, 0] + 62, (p[:, 1] * 2 + 300) % 360 - 180]) for p in places)
    c, g = frames(spark, (cells, gauges))
    out = fusion.optimal_interpolation(c, g.withColumn("innovation", F.col("gauge_id") - 40.0), "t").orderBy("cell_id").collect()
    inv = np.linalg.inv(4.0 * np.exp(-0.5 * (haversine(gauges, gauges) / 50) ** 2) + 2.25 * np.eye(80))
    d = haversine(cells, gauges)
    gain = 4.0 * np.exp(-0.5 * (d / 50) ** 2) * (d <= 150)
    change = ((gain @ inv) * ((d <= 150) * (np.arange(80) - 40.0))).sum(axis=1)
    bg = 5.0 + np.arange(300) % 7
    assert [r.analysis for r in out] == pytest.approx(list(np.where((d <= 150).any(axis=1), np.maximum(bg + change, 0), bg)), abs=1e-9)
    assert (d <= 150).any(axis=1).sum() > 20
    frame = g.toPandas()
    for most in (1, 10, 80):
        seen = []
        for rows, near in fusion._pieces(cells[:, 0], cells[:, 1], frame, 150.0, most):
            seen += rows.tolist()
            assert set(np.flatnonzero((d[rows] <= 150).any(axis=0))) <= set(near.tolist())
        assert sorted(seen) == list(range(300))


def test_idw_pairs_are_not_stored(spark, places, monkeypatch):
    c, g = frames(spark, places)
    kept, write = [], S.sized
    monkeypatch.setattr(fusion, "sized", lambda df, name: kept.append(write(df, name)) or kept[-1])
    fusion.idw_bias(c, g.withColumn("ratio", F.lit(2.0)), "t", 2000.0).count()
    assert max(t.count() for t in kept) <= 300  # 300 cells and 80 gauges have thousands of pairs


def test_idw_ratios_that_are_no_numbers_stay_local(spark):
    c = spark.createDataFrame([(1, 0, 0.0, 100.0, 1.0), (1, 1, 0.0, 120.0, 1.0), (1, 2, 0.0, 120.0, 1.0), (1, 2, 0.0, 100.1, 1.0), (2, 0, 0.0, 100.0, 1.0)], "t int, cell_id long, lat double, lon double, background double")
    g = spark.createDataFrame([(1, i, 0.1 * i, x, r) for i, (x, r) in enumerate([(100.0, 2.0), (100.1, float("nan")), (100.2, 3.0), (120.0, 2.0), (120.1, 2.0), (120.2, 2.0), (120.3, None)])], "t int, gauge_id long, g_lat double, g_lon double, ratio double")
    got = sorted((r.t, r.cell_id, str(round(r.bias, 6))) for r in fusion.idw_bias(c, g, "t").collect())
    assert got == [(1, 0, "nan"), (1, 1, "2.0"), (1, 2, "nan"), (1, 2, "nan"), (2, 0, "1.0")]


def test_radius_join_is_spread_and_crowded_tiles_are_dealt(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = spark.createDataFrame([(i, 0.001 * (i % 30), 0.001 * (i // 30)) for i in range(900)], "i long, lat double, lon double").coalesce(1)
    pairs = radius_join(one, one.select(F.col("i").alias("j"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon")).where("j < 5"), 100.0)
    assert pairs.rdd.getNumPartitions() == parts and pairs.count() == 4500
    left, right = S.deal(one.withColumn("k", F.lit(1)), spark.range(3).withColumn("k", F.lit(1)), ["k"], 100)
    sizes = [r["count"] for r in left.groupBy("_part").count().collect()]
    assert sum(sizes) == 900 and len(sizes) == 9 and max(sizes) < 200
    assert left.join(right, ["k", "_part"]).count() == 2700


def test_pieces_are_not_cut_to_points_where_gauges_are_dense():
    rng = np.random.default_rng(3)
    lat, lon = rng.uniform(0, 2, 400), rng.uniform(100, 102, 400)
    g = pd.DataFrame({"g_lat": lat, "g_lon": lon})
    pieces = list(fusion._pieces(lat, lon, g, 500.0, most=50))
    assert sorted(np.concatenate([r for r, _ in pieces])) == list(range(400)) and len(pieces) < 10


def test_kriging_of_many_gauges_stores_no_matrix_of_them(spark, places, monkeypatch):
    """More gauges than one matrix takes: the field is that of the whole network, and no large array is made."""
    monkeypatch.setattr(fusion, "DIRECT", 20)
    cells, gauges = places
    c, g = frames(spark, places)
    ratio = 0.5 + (np.arange(80) % 9) / 4
    out = fusion.kriging_bias(c, g.withColumn("ratio", 0.5 + (F.col("gauge_id") % 9) / 4), "t").orderBy("cell_id").collect()
    m = np.ones((81, 81))
    m[:80, :80] = 1.5 * np.exp(-haversine(gauges, gauges) / 45)
    m[80, 80] = 0
    w = np.linalg.pinv(m) @ np.vstack([1.5 * np.exp(-haversine(cells, gauges) / 45).T, np.ones(300)])
    assert [r.bias for r in out] == pytest.approx(list(np.clip(ratio @ w[:80], 0.1, 5)), abs=1e-8)


def test_conjugate_gradients_over_times_with_other_gauges():
    rng = np.random.default_rng(6)
    p = fusion._unit(rng.uniform(0, 4, 700), rng.uniform(100, 104, 700))
    seen = rng.random((700, 4)) < [1.0, 0.9, 0.8, 0.3]
    z = rng.uniform(0.1, 5, (700, 4)) * seen
    largest, made = [], fusion._covariance
    whole = made(p, p)
    fusion._covariance = lambda a, b: largest.append(made(a, b)) or largest[-1]
    try:
        got = fusion._conjugate(p, seen, z, 1000.0)
    finally:
        fusion._covariance = made
    for s in range(4):
        k = np.flatnonzero(seen[:, s])
        want = np.linalg.solve(whole[np.ix_(k, k)], np.column_stack([np.ones(len(k)), z[k, s]]))
        assert np.abs(got[k][:, [s, s + 4]] - want).max() < 1e-8
    assert max(max(x.shape[-2:]) for x in largest) < 700 and not got[~seen[:, 3], 3].any()


def test_kriging_of_gauges_on_one_spot(spark, places, monkeypatch):
    """Gauges on one spot count as their mean, in one matrix and by conjugate gradients."""
    c, g = frames(spark, places)
    twice = g.unionByName(g.withColumn("gauge_id", F.col("gauge_id") + 80)).withColumn("ratio", 0.5 + (F.col("gauge_id") % 7) / 4)
    mean = twice.groupBy("t", "g_lat", "g_lon").agg(F.min("gauge_id").alias("gauge_id"), F.avg("ratio").alias("ratio"))
    want = [r.bias for r in fusion.kriging_bias(c, mean, "t").orderBy("cell_id").collect()]
    for most in (1500, 20):
        monkeypatch.setattr(fusion, "DIRECT", most)
        assert [r.bias for r in fusion.kriging_bias(c, twice, "t").orderBy("cell_id").collect()] == pytest.approx(want, abs=1e-8)


def test_interpolation_inverts_once_for_times_that_lack_some_gauges(monkeypatch):
    """Every time is that of its own gauges, solved directly, a gauge that comes twice included; one inverse serves them."""
    rng = np.random.default_rng(9)
    cells, sites = (np.column_stack([rng.uniform(0, 4, n), rng.uniform(100, 104, n)]) for n in (200, 600))
    seen = rng.random((600, 3)) < [1.0, 0.9, 0.8]
    v = np.round(rng.normal(0, 5, (600, 3)), 3)
    slots = [np.flatnonzero(x).tolist() for x in seen]
    values = [v[i, s].tolist() for i, s in enumerate(slots)]
    slots[0], values[0] = slots[0] + [0], values[0] + [1.5]
    g = pd.DataFrame({"g_lat": sites[:, 0], "g_lon": sites[:, 1], "_slot": slots, "_v": values})
    made, inverse = [], fusion._inverse
    monkeypatch.setattr(fusion, "_inverse", lambda p: made.append(len(p)) or inverse(p))
    got = fusion._corrections(pd.DataFrame({"lat": cells[:, 0], "lon": cells[:, 1]}), g, 5000.0)
    assert made == [601] and np.isnan(got[:, 3:]).all()
    for s in range(3):
        own, x = np.flatnonzero(seen[:, s]), v[seen[:, s], s]
        if s == 0:
            own, x = np.append(own, 0), np.append(x, 1.5)
        inv = np.linalg.inv(4.0 * np.exp(-0.5 * (haversine(sites[own], sites[own]) / 50) ** 2) + 2.25 * np.eye(len(own)))
        d = haversine(cells, sites[own])
        want = ((4.0 * np.exp(-0.5 * (d / 50) ** 2) * (d <= 150)) @ inv * ((d <= 150) * x)).sum(axis=1)
        assert got[:, s] == pytest.approx(want, abs=1e-9)


def test_interpolation_of_times_with_other_gauges(spark, places):
    """Times of quite different gauges, a time without any, and rows without background."""
    c, g = frames(spark, places)
    c = c.unionByName(c.withColumn("t", F.lit(2))).unionByName(c.withColumn("t", F.lit(3))).withColumn("background", F.when(F.col("cell_id") != 5, F.col("background")))
    g = g.withColumn("innovation", F.col("gauge_id") - 40.0)
    both = g.where("gauge_id < 60").unionByName(g.where("gauge_id > 50").withColumn("t", F.lit(2)))
    got = {(r.t, r.cell_id): r.analysis for r in fusion.optimal_interpolation(c, both, "t").collect()}
    assert len(got) == 900 and got[1, 5] is None and got[3, 5] is None
    for t, own in ((1, np.arange(60)), (2, np.arange(51, 80)), (3, np.arange(0))):
        inv = np.linalg.inv(4.0 * np.exp(-0.5 * (haversine(places[1][own], places[1][own]) / 50) ** 2) + 2.25 * np.eye(len(own)))
        d = haversine(places[0], places[1][own])
        change = ((4.0 * np.exp(-0.5 * (d / 50) ** 2) * (d <= 150)) @ inv * ((d <= 150) * (own - 40.0))).sum(axis=1)
        for i in set(range(300)) - {5}:
            bg = 5.0 + i % 7
            assert got[t, i] == pytest.approx(max(bg + change[i], 0) if (d[i] <= 150).any() else bg, abs=1e-9)
