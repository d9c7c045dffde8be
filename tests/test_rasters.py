"""Small grids with results worked out by hand, and plain numpy versions."""

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spectraloom import model
from spectraloom.functions import crs, text
from spectraloom.functions.percentiles import percentiles
from spectraloom.operators import fill, filters, gaps, georef, mosaic, quality
from spectraloom.operators.components import connected_components
from spectraloom.plans import pipeline, registry
from spectraloom.sources import rasters

FRAME = "frame_id int, width int, height int, a double, b double, c double, d double, e double, f double, crs string, band_count int, dtype string, dtype_max double"


def frame(i, width=10, height=10, a=1.0, b=0.0, c=0.0, d=0.0, e=-1.0, f=0.0, crs="X", bands=1, dtype="uint8", full=255.0):
    return (i, width, height, a, b, c, d, e, f, crs, bands, dtype, full)


def frames(spark, *rows):
    return spark.createDataFrame(list(rows), FRAME)


def pixels(spark, grids, band=1):
    """{frame: 2-D list} to pixels; None is nodata."""
    rows = [(i, band, y, x, float(v)) for i, g in grids.items() for y, r in enumerate(g) for x, v in enumerate(r) if v is not None]
    return spark.createDataFrame(rows, "frame_id int, band int, y int, x int, v double")


def dense(spark, grid, band=1):
    rows = [(band, y, x, None if v is None else float(v)) for y, r in enumerate(grid) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, "band int, y int, x int, v double")


def area(spark, picture):
    return spark.createDataFrame([(y, x, c == "#") for y, r in enumerate(picture) for x, c in enumerate(r)], "y int, x int, valid boolean")


def drawn(rows, height, width, column, chars):
    out = [["?"] * width for _ in range(height)]
    for r in rows:
        out[r.y][r.x] = chars[r[column]]
    return ["".join(r) for r in out]


def test_presets():
    assert model.preset(" Strict ").aspect_max == 2.5 and model.preset("default", std_min=1.0).std_min == 1.0
    with pytest.raises(KeyError):
        model.preset("other")


def test_hard_filter_takes_the_first_rule(spark):
    table = frames(spark, frame(1), frame(2, b=0.2, width=100), frame(3, width=100), frame(4, width=2), frame(5, width=20, height=4), frame(6, a=0.0, e=0.0), frame(7))
    got = {r.frame_id: (r.reason, r.measured) for r in filters.hard(table).collect()}
    assert got[1] == got[7] == (None, None) and got[2] == ("skew", 0.2) and got[3] == ("area", 1000.0) and got[4] == ("area", 20.0)
    assert got[5] == ("aspect", 5.0) and got[6][0] == "skew" and math.isinf(got[6][1])


def test_hard_filter_on_pixels(spark):
    full = [[i * 10 + j for j in range(10)] for i in range(10)]
    grids = {1: full, 2: [[255] * 10 for _ in range(10)], 3: [[7] * 10 for _ in range(10)], 4: [[1, None] + [None] * 8 for _ in range(10)]}
    table = frames(spark, *(frame(i) for i in range(1, 6)))
    got = {r.frame_id: r.reason for r in filters.hard(table, pixels(spark, grids)).collect()}
    assert got == {1: None, 2: "saturation", 3: "std", 4: "valid", 5: "valid"}


def test_deviation_filter(spark):
    same = frames(spark, *(frame(i) for i in range(5)))
    assert filters.split(filters.adaptive(same))[1].count() == 0
    table = frames(spark, *(frame(i, width=10 + i) for i in range(9)), frame(99, width=500))
    kept, rejected = filters.split(filters.adaptive(table))
    assert [r.frame_id for r in rejected.collect()] == [99] and kept.count() == 9
    assert filters.adaptive(table.limit(0)).count() == 0


def test_band_filter(spark):
    rows = [list(range(10)) for _ in range(10)]  # stripes: every column is constant
    flat = [[5] * 10 for _ in range(10)]
    zeros = [[0] * 10 if y < 4 else list(np.random.default_rng(y).integers(1, 9, 10)) for y in range(10)]
    good = np.random.default_rng(1).integers(1, 100, (10, 10)).tolist()
    table = frames(spark, *(frame(i) for i in range(1, 6)))
    got = {r.frame_id: (r.reason, r.measured) for r in filters.per_band(table, pixels(spark, {1: rows, 2: flat, 3: zeros, 4: good})).collect()}
    assert got[1][0] == "stripe" and got[1][1] == pytest.approx(1.0) and got[2] == ("stripe", 1.0)
    assert got[3] == ("dropout", 0.4) and got[4] == (None, None) and got[5] == ("dropout", 1.0)


def test_band_filter_by_type_and_scale(spark):
    rng = np.random.default_rng(2)
    good = rng.integers(1, 60000, (20, 20))
    burnt = good.copy()
    burnt[:10] = 65535
    tiny, offset = rng.random((20, 20)) * 1e-7, rng.random((20, 20)) + 1e9
    grids = {1: good.tolist(), 2: burnt.tolist(), 3: tiny.tolist(), 4: offset.tolist(), 5: [[0.1] * 20] * 20, 6: burnt.tolist()}
    table = frames(spark, *(frame(i, 20, 20, dtype="uint16", full=65535.0) for i in (1, 2)), *(frame(i, 20, 20, dtype="float64", full=None) for i in (3, 4, 5, 6)))
    got = {r.frame_id: (r.reason, r.measured) for r in filters.per_band(table, pixels(spark, grids)).collect()}
    # only integer types have a largest value that means saturation
    assert got[1][0] is None and got[2] == ("dropout", 0.5) and got[3][0] is None and got[4][0] is None and got[5] == ("stripe", 1.0) and got[6][0] is None
    for i in (3, 4):
        x = np.array(grids[i])
        assert {r.frame_id: r.stripe for r in filters.band_statistics(pixels(spark, grids), table).collect()}[i] == pytest.approx(x.mean(axis=0).var() / x.var(), rel=1e-6)


def test_reasons_as_text(spark):
    df = spark.createDataFrame([("skew", 0.125, 0.05, None, None), ("area", 1234.5, 600.0, 600.0, 2400.0), (None, None, None, None, None), ("skew", math.inf, 0.05, None, None), ("dropout", 0.405, 0.3, 0.0, 0.3), ("outlier", 12.0, 55.25, 55.25, 1e7)], "reason string, measured double, threshold double, low double, high double")
    told = text.reason_text(*(F.col(c) for c in df.columns), F.lit(7))
    got = [r[0] for r in df.select(told).collect()]
    assert got == ["skewed transform (skew=0.125 > 0.050)", "abnormal area (area=1.23e+03, allowed=[600, 2.4e+03])", None, "skewed transform (skew=inf > 0.050)", "band 7 dropout (frac=0.41, allowed=[0, 0.30])", "area outlier vs MAD band (area=12, allowed=[55.2, 1e+07])"]
    parsed = [tuple(r) for r in df.select(*text.parse_reason(told)).collect()]
    assert parsed == [("0.125", "0.050"), ("1.23e+03", "[600, 2.4e+03]"), ("", ""), ("inf", "0.050"), ("0.41", "[0, 0.30]"), ("12", "[55.2, 1e+07]")]


def test_numbers_as_text(spark):
    rng = np.random.default_rng(0)
    values = [0.0, 1.0, -2.5, 0.125, 2.675, 999.4, 999.5, 999.6, 1005.0, 1015.0, 123456.0, 1e-4, 0.00012345, 9.996e-5, 1e-7, 1e22, math.inf, -math.inf, math.nan, 0.0575, 100.0, 1e5, *(rng.random(300) * 10.0 ** rng.integers(-6, 9, 300)).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for r in df.select("i", text.fixed(F.col("v"), 2).alias("a"), text.fixed(F.col("v"), 3).alias("b"), text.significant(F.col("v")).alias("c")).collect():
        v = values[r.i]
        assert (r.a, r.b, r.c) == (f"{v:.2f}", f"{v:.3f}", f"{v:.3g}"), v


def test_two_frames(spark):
    one, two = [[1, None, 3], [4, 5, None], [None, 8, 9]], [[10, 20, 30], [40, None, None], [70, 80, 90]]
    p = pixels(spark, {1: one, 2: two})
    first = {(r.y, r.x): (r.v, r.source_id) for r in mosaic.first_wins(p).collect()}
    assert first[0, 1] == (20.0, 2) and first[0, 0] == (1.0, 1) and (1, 2) not in first and len(first) == 8
    last = {(r.y, r.x): r.v for r in mosaic.last_wins(p).collect()}
    assert last[0, 0] == 10.0 and last[1, 1] == 5.0
    assert {(r.y, r.x): r.n for r in mosaic.overlap_count(p).collect()}[0, 0] == 2
    assert sum(r.covered for r in mosaic.coverage(p, 3, 4).collect()) == 8 and mosaic.coverage(p, 3, 4).count() == 12
    found = {r.source_id: (r.pixels, r.fraction) for r in mosaic.provenance(mosaic.sources(mosaic.first_wins(p))).collect()}
    assert found == {1: (6, 0.75), 2: (2, 0.25)}


def test_distances_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    ok = rng.random((40, 23)) < 0.8
    cells = spark.createDataFrame([(1, int(y), int(x)) for y, x in np.argwhere(ok)], "frame_id int, y int, x int")
    bad = np.argwhere(~ok)
    got = {(r.y, r.x): r.distance for r in mosaic.distance(cells, ["frame_id"], 40, 23).collect()}
    assert len(got) == ok.sum()
    assert all(got[y, x] == pytest.approx(np.sqrt(((bad - (y, x)) ** 2).sum(axis=1).min())) for y, x in map(tuple, np.argwhere(ok)))
    every = spark.createDataFrame([(1, y, x) for y in range(3) for x in range(3)], "frame_id int, y int, x int")
    assert all(math.isinf(r.distance) for r in mosaic.distance(every, ["frame_id"], 3, 3).collect())


def test_best_pixel(spark):
    one = [[1] * 4 + [None] * 3 for _ in range(5)]
    two = [[None] * 2 + [2] * 5 for _ in range(5)]
    p = pixels(spark, {1: one, 2: two})
    got = {(r.y, r.x): r.source_id for r in mosaic.best_pixel(p, 5, 7).collect()}
    assert [got[2, x] for x in range(7)] == [1, 1, 1, 2, 2, 2, 2]  # 2 beside 1: ties of two go to the earlier
    both = p.unionByName(p.withColumn("band", F.lit(2)).where("x <> 3"))
    whole = {(r.y, r.x): r.source_id for r in mosaic.best_pixel(both, 5, 7, per_band=False, bands=2).collect() if r.band == 1}
    assert (0, 3) not in whole


def test_catalog_checks(spark):
    good = frames(spark, frame(1), frame(2, c=10.0, f=-5.0))
    mosaic.require(good)
    b = mosaic.bounds(good).first()
    assert (b.left, b.right, b.top, b.bottom, b.width, b.height) == (0, 20, 0, -15, 20, 15)
    moved = mosaic.place(pixels(spark, {2: [[1]]}), good).first()
    assert (moved.y, moved.x) == (5, 10)
    for other, problem in ((frame(3, crs="Y"), "crs"), (frame(3, a=1.1), "resolution"), (frame(3, bands=2), "bands"), (frame(3, dtype="float32"), "dtype")):
        with pytest.raises(ValueError, match=problem):
            mosaic.require(frames(spark, frame(1), other))
    # systems that can't be converted aren't mixed
    with pytest.raises(ValueError, match="crs"):
        mosaic.require(frames(spark, frame(1), frame(3, crs="Y")), reproject=True)
    mosaic.require(frames(spark, frame(1, crs="EPSG:32636"), frame(3, crs="epsg:4326", a=0.1, e=-0.1)), reproject=True)
    with pytest.raises(ValueError, match="no frames"):
        mosaic.require(good.limit(0))


def test_resampling_keeps_a_plane(spark):
    plane = [[2 * x + 3 * y for x in range(8)] for y in range(8)]
    table = frames(spark, frame(1, width=8, height=8), frame(2, width=8, height=8, a=0.5, e=-0.5))
    got = {(r.frame_id, r.y, r.x): r.v for r in mosaic.resample(pixels(spark, {1: plane, 2: plane}), table).collect()}
    assert got[1, 3, 4] == 17.0 and got[2, 1, 1] == pytest.approx(2 * 2.5 + 3 * 2.5)


def test_systems_against_plain_geometry(spark):
    assert crs.parsed("EPSG:32636") == ("utm", 36) and crs.parsed(" epsg:32701") == ("utm", -1) and crs.parsed("EPSG:32661") is None and crs.parsed(None) is None
    places = [(33.0, 0.0), (33.0, 45.0), (33.0, 59.9), (30.2, 59.9), (35.9, -33.0), (32.0, 71.5), (33.0, 84.0), (30.0, 0.5), (-177.0, 10.0)]
    df = spark.createDataFrame(places, "lon double, lat double")
    for code in ("EPSG:32636", "EPSG:32736", "EPSG:3857", "EPSG:4326"):
        x, y = crs.from_geographic(F.col("lon"), F.col("lat"), code)
        there = df.where("lon > 0").select("lon", "lat", x.alias("x"), y.alias("y"))
        lon, lat = crs.to_geographic(F.col("x"), F.col("y"), code)
        for r in there.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-9), code
    x, y = crs.from_geographic(F.col("lon"), F.col("lat"), "EPSG:32636")
    e = df.where("lon > 0").select("lon", "lat", x.alias("x"), y.alias("y")).collect()
    e2 = crs.FLATTENING * (2 - crs.FLATTENING)

    def meridian(lat):
        """Length of the meridian from the equator, by quadrature."""
        p = (np.arange(200_000) + 0.5) / 200_000 * math.radians(lat)
        return float(np.mean(crs.MAJOR * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5) * math.radians(lat))

    for r in e:
        if r.lon == 33.0:
            assert r.x == pytest.approx(500000.0, abs=1e-6) and r.y == pytest.approx(0.9996 * meridian(r.lat), abs=1e-3)
    # conformal: steps east and north are equally long on the ellipsoid's scale and at right angles
    step = 1e-5
    near = spark.createDataFrame([(a + da, b + db) for a, b in places[:8] for da, db in ((0, 0), (step, 0), (0, step))], "lon double, lat double").select(x.alias("x"), y.alias("y"), "lat").collect()
    for k in range(0, len(near), 3):
        o, p, q = near[k : k + 3]
        n = crs.MAJOR / math.sqrt(1 - e2 * math.sin(math.radians(o.lat)) ** 2)
        m = n * (1 - e2) / (1 - e2 * math.sin(math.radians(o.lat)) ** 2)
        d = math.radians(step)
        east, north = np.array([p.x - o.x, p.y - o.y]) / (n * math.cos(math.radians(o.lat)) * d), np.array([q.x - o.x, q.y - o.y]) / (m * d)
        assert np.hypot(*east) == pytest.approx(np.hypot(*north), rel=1e-5) and abs(east @ north) < 1e-5 and east[0] * north[1] - east[1] * north[0] > 0
    for code in ("EPSG:2154", "X", ""):
        with pytest.raises(ValueError, match="unknown"):
            crs.to_geographic(F.lit(0.0), F.lit(0.0), code)


def test_warping_keeps_a_plane(spark):
    utm, geo = "EPSG:32636", "EPSG:4326"
    # a frame in degrees around the middle of a frame in metres; values are a plane in metres
    lon0, lat0, step = 33.0, 0.01, 1e-4
    one = frame(1, 60, 60, a=20.0, e=-20.0, c=499400.0, f=1700.0, crs=utm)
    two = frame(2, 40, 40, a=step, e=-step, c=lon0 - 20 * step, f=lat0 + 20 * step, crs=geo)
    table = frames(spark, one, two)
    centre = spark.createDataFrame([(y, x, lon0 + (x - 19.5) * step, lat0 + (19.5 - y) * step) for y in range(40) for x in range(40)], "y int, x int, lon double, lat double")
    x, y = crs.from_geographic(F.col("lon"), F.col("lat"), utm)
    plane = lambda x, y: (x - 499400) * 0.5 + (y - 500) * 0.25
    pixels_two = centre.select(F.lit(2).alias("frame_id"), F.lit(1).alias("band"), "y", "x", plane(x, y).alias("v"))
    pixels_one = spark.createDataFrame([(1, 1, r, c, plane(499400 + (c + 0.5) * 20, 1700 - (r + 0.5) * 20)) for r in range(60) for c in range(60)], "frame_id int, band int, y int, x int, v double")
    made, catalog = mosaic.warp(pixels_one.unionByName(pixels_two).where("NOT (frame_id = 2 AND y = 5 AND x = 5)"), table)
    grid = {r.frame_id: r for r in catalog.collect()}
    assert all(g.crs == utm and (g.a, g.e) == (20.0, -20.0) for g in grid.values()) and (grid[1].c, grid[1].f, grid[1].width) == (499400.0, 1700.0, 60)
    assert grid[2].width == math.ceil(40 * step * math.pi / 180 * crs.MAJOR * 0.9996 / 20) and grid[2].c < 500000 - 19 * 11
    rows = made.collect()
    inner = 0
    for r in rows:
        g = grid[r.frame_id]
        want = plane(g.c + (r.x + 0.5) * 20, g.f - (r.y + 0.5) * 20)
        edge = r.frame_id == 2 and not (1 <= r.y < g.height - 1 and 1 <= r.x < g.width - 1)
        # beside the missing cell and at the border weights are left out, which moves a value by less than a cell
        assert r.v == pytest.approx(want, abs=12.0 if edge or r.frame_id == 2 and r.y < 6 and r.x < 6 else 1e-3)
        inner += r.frame_id == 2 and not edge
    assert inner > 300 and sum(r.frame_id == 1 for r in rows) == 3600
    # the whole pipeline puts both on one canvas
    limits = model.Thresholds(skew_max=9.0, area_low=0.0, area_high=math.inf, aspect_max=9.0, valid_min=0.0, std_min=0.0)
    result = pipeline.run(table, pixels_one.unionByName(pixels_two), limits=limits, reproject=True, reach=5.0)
    assert result.mosaic.count() == 3600 and mosaic.warp(pixels_one, table.limit(0))[1].count() == 0


def test_a_reference_in_another_system(spark):
    rows = [(1, y, x, float(100 * y + x)) for y in range(30) for x in range(30)]
    ref = spark.createDataFrame(rows, "band int, y int, x int, v double")
    step = 1e-4
    made = {(r.y, r.x): r.v for r in quality.align_warped(ref, (33.0, 0.003, step, step), "EPSG:4326", (500000.0, 331.0, 20.0, 20.0), "EPSG:32636", 16, 16).collect()}
    east, north = math.pi / 180 * crs.MAJOR * 0.9996, math.pi / 180 * crs.MAJOR * (1 - crs.FLATTENING * (2 - crs.FLATTENING)) * 0.9996
    want = {(y, x): 100 * math.floor((0.003 - (331.0 - (y + 0.5) * 20) / north) / step) + math.floor((x + 0.5) * 20 / east / step) for y in range(16) for x in range(16)}
    assert len(made) == 256 and made == {k: float(v) for k, v in want.items()}


def test_percentiles_of_counted_values(spark):
    rng = np.random.default_rng(4)
    values = {None: rng.integers(0, 9, 500), 1: rng.random(301), 2: np.array([7.5]), 3: np.array([1.0, 2.0])}
    rows = [(k, float(v), int(n)) for k, x in values.items() for v, n in zip(*np.unique(x, return_counts=True))]
    df = spark.createDataFrame(rows, "k int, v double, n bigint").repartition(5)
    got = {r.k: r for r in percentiles(df, "k", "v", {"low": 0.05, "half": 0.5, "high": 0.95, "most": 1.0}).collect()}
    assert len(got) == 4
    for k, x in values.items():
        assert (got[k].low, got[k].half, got[k].high, got[k].most) == pytest.approx(np.percentile(x, [5, 50, 95, 100]))
    assert percentiles(df.limit(0), "k", "v", {"half": 0.5}).count() == 0


def test_distances_in_boxes_of_a_large_canvas(spark):
    rng = np.random.default_rng(5)
    ok = np.zeros((90, 80), dtype=bool)
    ok[40:60, 70:80] = rng.random((20, 10)) < 0.9
    ok[0:12, 0:15] = True
    halves = {1: ok & (np.arange(80) >= 40), 2: ok & (np.arange(80) < 40), 3: ok}
    cells = spark.createDataFrame([(i, int(y), int(x)) for i, m in halves.items() for y, x in np.argwhere(m)], "frame_id int, y int, x int")
    got = {(r.frame_id, r.y, r.x): r.distance for r in mosaic.distance(cells, ["frame_id"], 90, 80).collect()}
    assert len(got) == sum(m.sum() for m in halves.values())
    for i, m in halves.items():
        bad = np.argwhere(~m)
        assert all(got[i, y, x] == pytest.approx(np.sqrt(((bad - (y, x)) ** 2).sum(axis=1).min())) for y, x in map(tuple, np.argwhere(m)))


def test_bands_that_are_valid_alike_share_distances(spark):
    rng = np.random.default_rng(6)
    masks = {1: rng.random((20, 20)) < 0.8, 2: rng.random((20, 20)) < 0.8}
    masks |= {3: masks[1], 4: masks[2]}
    cells = spark.createDataFrame([(f, b, int(y), int(x)) for f in (1, 2) for b, m in masks.items() for y, x in np.argwhere(m)], "frame_id int, band int, y int, x int")
    shared = {tuple(r) for r in mosaic._band_distance(cells, 20, 20).select("frame_id", "band", "y", "x", "distance").collect()}
    each = {tuple(r) for r in mosaic.distance(cells, ["frame_id", "band"], 20, 20).select("frame_id", "band", "y", "x", "distance").collect()}
    assert shared == each


def test_tiles_smooth_as_whole_columns_do(spark):
    rng = np.random.default_rng(9)
    grid = [[float(rng.integers(0, 50)) if rng.random() < 0.5 else None for _ in range(40)] for _ in range(40)]
    cells = dense(spark, grid).unionByName(dense(spark, [[None, None]], 2)).unionByName(dense(spark, [[1, 2]], 3))
    whole = {(r.band, r.y, r.x): r.v for r in fill.fill(cells, reach=6, passes=2).collect()}
    tiled = {(r.band, r.y, r.x): r.v for r in fill.fill_tiled(cells, reach=6, passes=2, tile=12).collect()}
    assert whole.keys() == tiled.keys() and tiled[2, 0, 0] is None and tiled[3, 0, 1] == 2.0
    assert sum(whole[k] == pytest.approx(tiled[k]) for k in whole) >= 0.99 * len(whole)
    mask = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "y int, x int, state int")
    assert {r.x: r.v for r in fill.fill_tiled(dense(spark, [[4, 5]]), mask).collect()} == {0: 4.0, 1: 5.0}
    method = registry.method(registry.FILLS, "v2")
    assert {(r.band, r.y, r.x): r.v for r in method.run(cells, None, 6.0, 2).collect()} == pytest.approx(whole)


def test_display_bands():
    assert mosaic.rgb_bands(2) == (1, 1, 1) and mosaic.rgb_bands(200) == (81, 51, 25)


def test_holes_and_a_diagonal_leak(spark):
    ring = ["......", ".####.", ".#..#.", ".#.###", ".####.", "......"]
    got = {(r.y, r.x) for r in gaps.holes(area(spark, ring)).collect()}
    assert got == {(2, 2), (2, 3), (3, 2)}
    diagonal = [".####.", ".#..#.", ".#.#..", ".###.."]
    assert {(r.y, r.x) for r in gaps.holes(area(spark, diagonal)).collect()} == {(1, 2), (1, 3), (2, 2)}
    assert gaps.holes(area(spark, ["##", "##"])).count() == 0


def _shift(m, dy, dx):
    out = np.zeros_like(m)
    h, w = m.shape
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = m[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


@pytest.mark.parametrize("steps", [1, 3])
def test_closing_against_repeated_steps(spark, steps):
    rng = np.random.default_rng(steps)
    ok = rng.random((30, 24)) < 0.35
    ok[:, 12:14] = False
    grown = ok.copy()
    for _ in range(steps):
        grown = grown | _shift(grown, 0, 1) | _shift(grown, 0, -1) | _shift(grown, 1, 0) | _shift(grown, -1, 0)
    for _ in range(steps):
        grown = grown & _shift(grown, 0, 1) & _shift(grown, 0, -1) & _shift(grown, 1, 0) & _shift(grown, -1, 0)
    rows = gaps.closing(area(spark, [["#" if v else "." for v in r] for r in ok]), steps).collect()
    assert all(r.closed == bool(grown[r.y, r.x]) for r in rows) and len(rows) == 720


def test_slit_at_the_border_stays_open(spark):
    picture = ["#" * 10 + ".." + "#" * 10] * 12 + ["#" * 22] * 12
    state = drawn(gaps.fill_mask(area(spark, picture), 3).collect(), 24, 22, "state", "012")
    assert all(state[y][10:12] == "22" for y in range(3)) and all(state[y][10:12] == "11" for y in range(4, 12))
    assert {r.keep for r in gaps.two_state(gaps.fill_mask(area(spark, picture), 3)).collect()} == {0, 1}


def test_regions(spark):
    picture = ["#####", "#.#.#", "#.###", "#####"]
    got = gaps.region_metrics(gaps.fill_mask(area(spark, picture)), 2.0, -3.0).first()
    assert tuple(got) == (2, 2, 12.0)
    assert tuple(gaps.region_metrics(gaps.fill_mask(area(spark, ["##"]))).first()) == (0, 0, 0.0)
    assert gaps.region_metrics(gaps.fill_mask(area(spark, picture)), 0.0, 0.0).first().largest_area is None
    spiral = ["#########", "#.......#", "#.#####.#", "#.#...#.#", "#.#.#.#.#", "#.#.###.#", "#.#.....#", "#.#######"]
    cells = area(spark, spiral).where("NOT valid")
    assert gaps.label(cells).select("label").distinct().count() == 1


@pytest.mark.parametrize("few", [0, 3, 40, 10**6])
def test_components_whatever_one_task_may_hold(spark, few):
    rng = np.random.default_rng(12)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 4), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), few=few).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int"), few=few).count() == 0


def greedy(grid, source, reach):
    """Inverse distance over tracked quadrant sources, cell by cell."""
    h, w = len(grid), len(grid[0])
    out = [list(r) for r in grid]
    picks = {}
    for side in (-1, 1):
        for order in (range(h), range(h - 1, -1, -1)):
            held = [None] * w
            for y in order:
                for x in range(w):
                    seen = next(((y, k) for k in range(x, -1 if side < 0 else w, side) if source[y][k]), None)
                    if seen and (held[x] is None or abs(x - seen[1]) <= math.hypot(y - held[x][0], x - held[x][1])):
                        held[x] = seen
                    if held[x]:
                        picks.setdefault((y, x), []).append(held[x])
    for y in range(h):
        for x in range(w):
            if not source[y][x]:
                near = [(math.hypot(y - a, x - b), grid[a][b]) for a, b in picks.get((y, x), []) if grid[a][b] is not None]
                near = [(d, v) for d, v in near if 0 < d <= reach]
                out[y][x] = sum(v / d**2 for d, v in near) / sum(1 / d**2 for d, _ in near) if near else None
    return out


def test_the_tracker_is_greedy(spark):
    grid = [[None] * 6 for _ in range(12)]
    grid[0][5], grid[2][2] = 1, 2
    got = {(r.y, r.x): (r.nw_v, r.nw_d) for r in fill.sweep(fill.dense(dense(spark, grid))).collect()}
    assert got[10, 5] == (1.0, 10.0)  # the nearest source to the north-west is at 8.544


@pytest.mark.parametrize("strip", [3, 64])
def test_fill_against_plain_sweeps(spark, monkeypatch, strip):
    monkeypatch.setattr(fill, "STRIP", strip)
    rng = np.random.default_rng(strip)
    grid = [[float(rng.integers(0, 50)) if rng.random() < 0.15 else None for _ in range(11)] for _ in range(14)]
    want = greedy(grid, [[v is not None for v in r] for r in grid], 6)
    for r in fill.fill(dense(spark, grid), reach=6).collect():
        assert r.v == (None if want[r.y][r.x] is None else pytest.approx(want[r.y][r.x])), (r.y, r.x)


def test_same_row_counts_twice_and_nearest(spark):
    grid = [[1, None, None, None, 5]]
    got = {r.x: r.v for r in fill.fill(dense(spark, grid)).collect()}
    assert got[1] == pytest.approx((1 / 1 + 5 / 9) / (1 + 1 / 9)) and got[2] == pytest.approx(3.0) and got[0] == 1.0
    assert {r.x: r.v for r in fill.fill(dense(spark, grid), method="nearest").collect()}[2] == 1.0


def test_outside_cells_shadow_their_quadrant(spark):
    grid = [[9, None, None, 3]]
    mask = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 1), (0, 3, 0)], "y int, x int, state int")
    got = {r.x: r.v for r in fill.fill(dense(spark, grid), mask).collect()}
    assert got == {0: 9.0, 1: None, 2: 3.0, 3: 3.0}


def test_smoothing_and_untouched_bands(spark):
    grid = [[1, 2, 3], [4, None, 6], [7, 8, 9]]
    got = {(r.y, r.x): r.v for r in fill.smooth(fill.dense(dense(spark, grid))).collect()}
    assert got[1, 1] == pytest.approx(5.0) and got[0, 0] == 1.0
    full, none = [[1, 2], [3, 4]], [[None, None], [None, None]]
    both = dense(spark, full).unionByName(dense(spark, none, 2))
    got = {(r.band, r.y, r.x): r.v for r in fill.fill(both, passes=2).collect()}
    assert got[1, 1, 1] == 4.0 and got[2, 0, 0] is None
    ints = {r.x: r.v for r in fill.cast_back(fill.dense(dense(spark, [[0.5, 1.5, None]])), True, 7.0).collect()}
    assert ints == {0: 0.0, 1: 2.0, 2: 7.0}


def test_tiles_agree_away_from_the_halo(spark):
    rng = np.random.default_rng(8)
    grid = [[float(rng.integers(0, 50)) if rng.random() < 0.3 else None for _ in range(40)] for _ in range(40)]
    whole = {(r.y, r.x): r.v for r in fill.fill(dense(spark, grid), reach=8).collect()}
    tiled = {(r.y, r.x): r.v for r in fill.fill_tiled(dense(spark, grid), reach=8, tile=16).collect()}
    assert whole.keys() == tiled.keys() and sum(whole[k] == pytest.approx(tiled[k]) for k in whole) >= 0.995 * len(whole)


def test_scores_at_their_edges(spark):
    same = dense(spark, [[1, 2], [3, 4]])
    assert math.isinf(quality.scalars(quality.pair(same, same)).first().psnr)
    flat, other = dense(spark, [[5, 5]]), dense(spark, [[5, 6]])
    row = quality.scalars(quality.pair(flat, other)).first()
    assert math.isinf(row.psnr) and row.mae == 0.5 and row.rmse == pytest.approx(math.sqrt(0.5))
    assert quality.skipped_bands(flat, quality.pair(flat, dense(spark, [[None, None]]))).count() == 1
    rng = np.random.default_rng(0)
    image = dense(spark, rng.random((12, 12)).tolist())
    assert quality.ssim(image, image).first().ssim == pytest.approx(1.0)
    worse = image.withColumn("v", F.col("v") * F.when((F.col("x") + F.col("y")) % 2 == 0, 0.2).otherwise(1.0))
    assert quality.ssim(image, worse).first().ssim < 0.8


def test_aggregates_and_infinite_bands(spark):
    metrics = spark.createDataFrame([(b, m, "base", v) for b, m, v in ((1, "psnr", math.inf), (2, "psnr", 30.0), (3, "psnr", 20.0), (1, "rmse", 0.0), (2, "rmse", 2.0), (3, "rmse", 2.0))], "band int, metric string, variant string, value double")
    got = {r.metric: r for r in quality.aggregates(metrics).collect()}
    assert got["rmse"].worst == 2.0 and got["rmse"].worst_band == 2 and got["psnr"].worst_band == 3 and math.isinf(got["psnr"].mean) and got["psnr"].p05_band == 3


def test_spectral_angle(spark):
    ref = dense(spark, [[1, 0]]).unionByName(dense(spark, [[0, 1]], 2))
    made = dense(spark, [[1, 1]]).unionByName(dense(spark, [[1, 1]], 2))
    row = quality.spectral_angle(ref, made, 2).first()
    assert row.sam_deg == pytest.approx(45.0) and row.pixels == 2
    assert quality.spectral_angle(ref, ref, 2).first().sam == pytest.approx(0.0, abs=2e-6)
    assert quality.spectral_angle(ref, made, 3).first().sam is None


def test_seams(spark):
    ids = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 3, 2)], "y int, x int, source_id int")
    values = dense(spark, [[1, 2, 10, 11]])
    assert {r.x: r.seam for r in quality.seam_mask(ids).collect()} == {0: False, 1: True, 2: True, 3: False}
    got = {r.band: r for r in quality.seam_statistics(values, ids).collect()}
    assert got[1].n == 2 and got[1].max == 8.0 and got[None].mean == 4.5
    assert {r.band: r.n for r in quality.seam_statistics(values, ids, strict=True).collect()}[1] == 1
    assert quality.seam_length(ids).first()[0] == 2
    one = ids.withColumn("source_id", F.lit(1))
    pooled = quality.seam_statistics(values, one).collect()
    assert len(pooled) == 1 and pooled[0].n == 0 and pooled[0]["mean"] == 0.0


NAV = "line_id int, t double, roll double, pitch double, yaw double, lon double, lat double, alt double"
TIMES = "line_id int, line bigint, t double"


def test_poses_wrap_and_clamp(spark):
    yaws = [3.0, -3.1, -2.9, 3.1]
    nav = spark.createDataFrame([(1, 10.0 + i, 0.1 * i, 0.0, y, 30.0 + i, 59.0, 100.0) for i, y in enumerate(yaws)], NAV)
    times = spark.createDataFrame([(1, i, 500.0 + t) for i, t in enumerate((0.0, 0.5, 1.75, 3.0, 3.4))], TIMES)
    got = {r.line: r for r in georef.checked_poses(nav, times).collect()}
    at = [0.0, 0.5, 1.75, 3.0, 3.4]
    assert [got[i].yaw for i in range(5)] == pytest.approx(np.interp(at, range(4), np.unwrap(yaws)).tolist())
    assert [got[i].lon for i in range(5)] == pytest.approx(np.interp(at, range(4), [30, 31, 32, 33]).tolist())
    with pytest.raises(ValueError, match="durations"):
        georef.checked_poses(nav, times, offset=0.6)
    back = times.withColumn("t", F.when(F.col("line") == 3, 0.0).otherwise(F.col("t")))
    with pytest.raises(ValueError, match="must not fall"):
        georef.checked_poses(nav, back)


def test_ground_below_a_level_camera(spark):
    poses = spark.createDataFrame([(1, k, 30.0, 59.0 + k * 1e-5, 100.0, 0.0, 0.0, 0.0) for k in range(3)], "line_id int, line bigint, lon double, lat double, alt double, roll double, pitch double, yaw double")
    got = {(r.line, r.sample): r for r in georef.flat_ground(poses, 3, 20.0).collect()}
    assert got[0, 1].lon == pytest.approx(30.0) and got[0, 1].lat == pytest.approx(59.0) and all(r.valid for r in got.values())
    metres = (got[0, 2].lat - 59.0) * math.pi / 180 * 6_380_000
    assert metres == pytest.approx(100 * math.tan(math.radians(10)), rel=0.01)
    upside = georef.flat_ground(poses.withColumn("roll", F.lit(math.pi)), 3, 20.0)
    assert not any(r.valid for r in upside.collect())
    ring = georef.footprint(georef.flat_ground(poses, 3, 20.0)).first().ring
    assert len(ring) == 3 + 3 + 3 + 3 + 1 and ring[0] == ring[-1]
    assert len(georef.simplify(georef.footprint(georef.flat_ground(poses, 3, 20.0)), 1e-3).first().ring) >= 2
    georef.require_below(poses, 0.0)
    with pytest.raises(ValueError):
        georef.require_below(poses, 100.0)
    with pytest.raises(ValueError):
        georef.view_angle(F.lit(0), 1, 20.0)
    grid = georef.flat_ground(poses, 3, 20.0)
    cells = georef.index_map(grid).collect()
    assert len({(r.y, r.x) for r in cells}) == len(cells) > 0


def test_terrain_in_steps_against_plain_rounds(spark):
    poses = spark.createDataFrame([(1, k, 30.0 + k * 1e-4, 59.0, 100.0, 0.02 * k, 0.0, 0.0) for k in range(12)], "line_id int, line bigint, lon double, lat double, alt double, roll double, pitch double, yaw double")
    heights = {(y, x): float((7 * x + 3 * y) % 5 * 6) for y in range(40) for x in range(40)}
    dem = spark.createDataFrame([(y, x, h) for (y, x), h in heights.items()], "y int, x int, alt double")
    left, top, res = 29.9990, 59.0010, 5e-5
    got = {(r.line, r.sample): r for r in georef.dem_ground(poses, 5, 30.0, dem, left, top, res, res).collect()}
    h, done = {k: 0.0 for k in got}, set()
    for _ in range(8):
        table = spark.createDataFrame([(a, b, x) for (a, b), x in h.items()], "line bigint, sample int, h double")
        hits = georef._hits(georef.rays(poses, 5, 30.0).join(table, ["line", "sample"]), F.col("h")).collect()
        new = {(r.line, r.sample): heights.get((math.floor((top - r.glat) / res), math.floor((r.glon - left) / res)), 0.0) for r in hits}
        still = {a for a in range(12) if max(abs(new[a, b] - h[a, b]) for b in range(5)) <= 0.25}
        h = {k: h[k] if k[0] in done else new[k] for k in h}
        done |= still
    assert done
    assert all(got[k].alt == h[k] and got[k].valid == (k[0] in done) for k in got)


def test_terrain_meets_the_plane_where_it_is_flat(spark):
    poses = spark.createDataFrame([(1, k, 30.0, 59.0, 100.0, 0.0, 0.0, 0.0) for k in range(2)], "line_id int, line bigint, lon double, lat double, alt double, roll double, pitch double, yaw double")
    dem = spark.createDataFrame([(y, x, 20.0) for y in range(5) for x in range(5)], "y int, x int, alt double")
    got = {(r.line, r.sample): r for r in georef.dem_ground(poses, 3, 20.0, dem, 29.9, 59.1, 0.04, 0.04).collect()}
    flat = {(r.line, r.sample): r for r in georef.flat_ground(poses, 3, 20.0, 20.0).collect()}
    assert all(r.valid and r.alt == 20.0 and r.lat == pytest.approx(flat[k].lat) for k, r in got.items())


def test_geodetic_round_trip(spark):
    df = spark.createDataFrame([(10.0, 20.0, -30.0), (0.0, 0.0, 0.0)], "e double, n double, u double")
    moved = georef.with_geodetic(df, F.col("e"), F.col("n"), F.col("u"), F.lit(45.0), F.lit(10.0), F.lit(100.0), ("lat", "lon", "alt"))
    got = moved.collect()
    assert got[1].lat == pytest.approx(45.0, abs=1e-12) and got[1].alt == pytest.approx(100.0, abs=1e-6)
    assert got[0].alt == pytest.approx(70.0, abs=1e-3) and (got[0].lat - 45) * 111_131 == pytest.approx(20, abs=0.05)


def test_pipeline_rules(spark):
    table = frames(spark, frame(1, 6, 6), frame(2, 6, 6), frame(3, 6, 60))
    rng = np.random.default_rng(3)
    one = rng.integers(1, 90, (6, 6)).tolist()
    one[2][3] = None
    two = [[None] * 6 for _ in range(6)]
    two[0][0] = 7
    p = pixels(spark, {1: one, 2: two})
    limits = model.preset("permissive", valid_min=0.0)
    made = pipeline.run(table, p, limits=limits)
    got = {(r.y, r.x): (r.v, r.is_src) for r in made.filled.collect()}
    assert got[2, 3][0] is not None and not got[2, 3][1] and got[0, 0][0] == one[0][0] and len(got) == 36
    assert all(v == one[y][x] for (y, x), (v, src) in got.items() if src)
    assert made.gap_metrics.first().regions == 1 and made.mosaic.groupBy("y", "x", "band").count().where("count > 1").count() == 0
    dry = pipeline.run(table, p, dry_run=True, limits=limits)
    assert dry.mosaic is None and dry.judged.count() == 3
    with pytest.raises(RuntimeError, match="all frames"):
        pipeline.run(table.where("frame_id = 3").withColumn("b", F.lit(9.0)), p)
    with pytest.raises(RuntimeError, match="band 2"):
        pipeline.run(table.where("frame_id < 3").withColumn("band_count", F.lit(2)), p, limits=limits)


def test_registry():
    assert registry.method(registry.FILLS).id == "v3" and registry.method(registry.MOSAICS, "v2").label in registry.labels(registry.MOSAICS)
    assert len(registry.tooltip(registry.FILTERS).splitlines()) == 3
    with pytest.raises(KeyError):
        registry.method(registry.FILTERS, "v9")


def test_tables_on_disk(spark, tmp_path):
    made = pixels(spark, {1: [[1, 2], [3, math.nan]]})
    assert rasters.normalise(made, 2.0).where(F.col("v").isNull()).count() == 2
    path = f"file://{tmp_path}/m"
    rasters.write_mosaic(made.drop("frame_id"), path)
    scan = rasters.scan_bands(rasters.open_table(spark, path), 1)
    plan = rasters.scan_window(scan, 0, 0, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "GreaterThanOrEqual(y,0)" in plan
    with pytest.raises(AnalysisException):
        rasters.open_table(spark, path + "-none")
    assert rasters.side_path("/a/b.tif", "sources") == "/a/b.sources.tif"
    judged = filters.hard(frames(spark, frame(1)))
    rasters.write_rejected(rasters.rejected_rows(judged), f"file://{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r").columns == ["path", "reason", "measured_value", "threshold"]
