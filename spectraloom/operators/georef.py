"""Georeferencing of pushbroom lines: poses at frame times, rays to the ground, and resampling.

Everything per line_id; angles are radians, lon and lat degrees. Nothing is shuffled but by line: the product of poses and samples is generated, not joined.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise

FIELDS = ("roll", "pitch", "yaw", "lon", "lat", "alt")
MOST_APART = 0.5
# fixed values: the WGS-84 ellipsoid
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
_E2 = FLATTENING * (2 - FLATTENING)


def is_monotonic(times: DataFrame, order: str) -> DataFrame:
    """(line_id, ok): whether t never falls in the order of a column."""
    w = Window.partitionBy("line_id").orderBy(order)
    steps = times.select("line_id", (F.col("t") >= F.lag("t").over(w)).alias("up"))
    return steps.groupBy("line_id").agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("ok"))


def align_times(nav: DataFrame, frames: DataFrame, offset: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Both tables with t relative to each line's first time; frames move by offset."""
    line = Window.partitionBy("line_id")
    start = F.min("t").over(line)
    return nav.withColumn("t", F.col("t") - start), frames.withColumn("t", F.col("t") + offset - start)


def durations(nav: DataFrame, frames: DataFrame, offset: float = 0.0) -> DataFrame:
    """(line_id, nav_s, frames_s, ok): whether the last times are within half a second."""
    n, f = align_times(nav, frames, offset)
    ends = n.groupBy("line_id").agg(F.max("t").alias("nav_s")).join(f.groupBy("line_id").agg(F.max("t").alias("frames_s")), "line_id")
    return ends.withColumn("ok", F.abs(F.col("nav_s") - F.col("frames_s")) <= MOST_APART)


def unwrap_yaw(nav: DataFrame) -> DataFrame:
    """nav with yaw free of jumps by more than half a turn: corrections add up along each line."""
    line = Window.partitionBy("line_id").orderBy("t")
    turn = F.lit(2 * math.pi)
    step = F.col("yaw") - F.lag("yaw").over(line)
    short = F.pmod(step + math.pi, turn) - math.pi
    short = F.when((short == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(short)
    fix = F.when(F.abs(step) < math.pi, F.lit(0.0)).otherwise(short - step)
    marked = nav.withColumn("__fix", F.coalesce(fix, F.lit(0.0)))
    return marked.withColumn("yaw", F.col("yaw") + F.sum("__fix").over(line)).drop("__fix")


def interpolate_poses(nav: DataFrame, frames: DataFrame, offset: float = 0.0) -> DataFrame:
    """(line_id, line, t, roll, pitch, yaw, lon, lat, alt): linear between the records around each frame time, clamped at both ends.

    An as-of join both ways: records and frame times are merged by time, and windows carry the records.
    """
    n, f = align_times(unwrap_yaw(nav), frames, offset)
    record = F.struct("t", *FIELDS).alias("record")
    merged = n.select("line_id", "t", F.lit(0).alias("src"), F.lit(None).cast("bigint").alias("line"), record).unionByName(f.select("line_id", "t", F.lit(1).alias("src"), F.col("line").cast("bigint").alias("line"), F.lit(None).cast(n.select(record).schema["record"].dataType).alias("record")))
    order = Window.partitionBy("line_id").orderBy("t", "src")
    back = Window.partitionBy("line_id").orderBy(F.col("t").desc(), F.col("src").desc())
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    around = merged.select("line_id", "line", "t", "src", F.last("record", ignorenulls=True).over(upto(order)).alias("a"), F.last("record", ignorenulls=True).over(upto(back)).alias("b")).where("src = 1")
    share = F.try_divide(F.col("t") - F.col("a.t"), F.col("b.t") - F.col("a.t"))
    at = lambda k: F.coalesce(F.col(f"a.{k}") + (F.col(f"b.{k}") - F.col(f"a.{k}")) * share, F.col(f"a.{k}"), F.col(f"b.{k}"))
    return around.select("line_id", "line", "t", *(at(k).alias(k) for k in FIELDS))


def checked_poses(nav: DataFrame, frames: DataFrame, offset: float = 0.0) -> DataFrame:
    """interpolate_poses() after its checks; ValueError for times that fall or that don't cover each other."""
    for name, table, order in (("navigation", nav.withColumn("__i", F.monotonically_increasing_id()) if "seq" not in nav.columns else nav.withColumnRenamed("seq", "__i"), "__i"), ("frame", frames, "line")):
        if not is_monotonic(table, order).where(~F.col("ok")).isEmpty():
            raise ValueError(f"{name} times must not fall")
    apart = durations(nav, frames, offset).where(~F.col("ok")).limit(1).collect()
    if apart:
        raise ValueError(f"durations of line {apart[0].line_id} differ: {apart[0].nav_s:.1f} and {apart[0].frames_s:.1f} s")
    return interpolate_poses(nav, frames, offset)


def view_angle(sample: Column, samples: int, fov_deg: float, principal: float | None = None, flip: bool = False) -> Column:
    """Angle of a sample across the track; the principal sample, by default the middle one, looks straight down."""
    if samples < 2:
        raise ValueError("a sensor line has at least two samples")
    centre = (samples - 1) / 2 if principal is None else principal
    angle = (sample - F.lit(centre)) / F.lit(samples - 1) * F.radians(F.lit(float(fov_deg)))
    return -angle if flip else angle


def rotation(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rz(yaw) Ry(pitch) Rx(roll) as scalar expressions."""
    (sr, cr), (sp, cp), (sy, cy) = ((F.sin(x), F.cos(x)) for x in (roll, pitch, yaw))
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def _attitude(boresight: tuple[float, float, float]) -> list[list[Column]]:
    r = rotation(F.col("roll"), F.col("pitch"), F.col("yaw"))
    if not any(boresight):
        return r
    b = rotation(*(F.lit(math.radians(x)) for x in boresight))
    return [[r[i][0] * b[0][j] + r[i][1] * b[1][j] + r[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def _prime_vertical(lat: Column) -> Column:
    return F.lit(MAJOR) / F.sqrt(1 - F.lit(_E2) * F.sin(lat) * F.sin(lat))


def with_geodetic(df: DataFrame, east: Column, north: Column, up: Column, lat0: Column, lon0: Column, alt0: Column, names: tuple[str, str, str], steps: int = 3) -> DataFrame:
    """df with latitude, longitude (degrees) and height of local offsets, under names.

    Through earth-centred coordinates, then fixed-point steps for the latitude. Each step is a projection of its own, so that no expression is
    evaluated twice.
    """
    la, lo, n0 = F.col("__la"), F.col("__lo"), F.col("__n0")
    df = df.withColumns({"__la": F.radians(lat0), "__lo": F.radians(lon0), "__e": east, "__n": north, "__u": up, "__h": alt0})
    df = df.withColumns({"__n0": _prime_vertical(la), "__t": F.cos(la) * F.col("__u") - F.sin(la) * F.col("__n")})
    flat = (n0 + F.col("__h")) * F.cos(la)
    df = df.withColumns({
        "__z": (n0 * F.lit(1 - _E2) + F.col("__h")) * F.sin(la) + F.sin(la) * F.col("__u") + F.cos(la) * F.col("__n"),
        "__x": flat * F.cos(lo) + F.cos(lo) * F.col("__t") - F.sin(lo) * F.col("__e"),
        "__y": flat * F.sin(lo) + F.sin(lo) * F.col("__t") + F.cos(lo) * F.col("__e"),
    })
    df = df.withColumn("__p", F.sqrt(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")))
    df = df.withColumn("__lat", F.atan2(F.col("__z"), F.col("__p") * F.lit(1 - _E2)))
    for _ in range(steps):
        df = df.withColumn("__lat", F.atan2(F.col("__z") + F.lit(_E2) * _prime_vertical(F.col("__lat")) * F.sin("__lat"), F.col("__p")))
    lat, lon, alt = names
    df = df.withColumns({lat: F.degrees("__lat"), lon: F.degrees(F.atan2("__y", "__x")), alt: F.col("__p") / F.cos("__lat") - _prime_vertical(F.col("__lat"))})
    return df.drop("__la", "__lo", "__e", "__n", "__u", "__h", "__n0", "__t", "__z", "__x", "__y", "__p", "__lat")


def rays(poses: DataFrame, samples: int, fov_deg: float, principal: float | None = None, flip: bool = False, boresight: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """poses x samples with ray_e, ray_n, ray_u: the nine rotation terms are computed once for each pose, before samples are generated."""
    r = _attitude(boresight)
    terms = [r[i][j].alias(f"r{i}{j}") for i in range(3) for j in (1, 2)]
    each = poses.select("line_id", "line", "lon", "lat", "alt", *terms, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    angle = view_angle(F.col("sample"), samples, fov_deg, principal, flip)
    # the camera looks down: up is positive, so the ray starts as (0, sin, -cos)
    return each.select("line_id", "line", "sample", "lon", "lat", "alt", *((F.col(f"r{i}1") * F.sin(angle) - F.col(f"r{i}2") * F.cos(angle)).alias(f"ray_{k}") for i, k in enumerate("enu")))


def _hits(cells: DataFrame, ground: Column) -> DataFrame:
    scale = F.when(F.col("ray_u") < -1e-6, (ground - F.col("alt")) / F.col("ray_u"))
    valid = F.coalesce(scale > 0, F.lit(False))
    cells = cells.withColumns({"valid": valid, "galt": ground, "__scale": F.when(valid, scale)})
    away = F.col("__scale")
    return with_geodetic(cells, away * F.col("ray_e"), away * F.col("ray_n"), F.col("galt") - F.col("alt"), F.col("lat"), F.col("lon"), F.col("alt"), ("glat", "glon", "__up")).drop("__scale", "__up")


def flat_ground(poses: DataFrame, samples: int, fov_deg: float, ground_alt: float = 0.0, **sensor) -> DataFrame:
    """(line_id, line, sample, lon, lat, alt, valid) where rays meet a plane; the plane must lie below every pose, see require_below()."""
    found = _hits(rays(poses, samples, fov_deg, **sensor), F.lit(float(ground_alt)))
    return found.select("line_id", "line", "sample", F.col("glon").alias("lon"), F.col("glat").alias("lat"), F.col("galt").alias("alt"), "valid")


def require_below(poses: DataFrame, ground_alt: float) -> None:
    lowest = poses.agg(F.min("alt")).first()[0]
    if lowest is not None and ground_alt >= lowest:
        raise ValueError(f"the ground at {ground_alt} m must lie below the lowest pose at {lowest:.3f} m")


def dem_ground(poses: DataFrame, samples: int, fov_deg: float, dem: DataFrame, left: float, top: float, xres: float, yres: float, fallback_alt: float = 0.0, rounds: int = 8, tolerance: float = 0.25, **sensor) -> DataFrame:
    """Like flat_ground() on a terrain model dem(y, x, alt): each round samples the terrain, nearest cell, under the point of the round before.

    A line whose heights all moved by tolerance at most is done, keeps them and leaves the rounds, which end when no line is left. Off the model the
    fallback height counts. Every round is an equi-join on what is left, written to the shared folder.
    """
    left_over = rays(poses, samples, fov_deg, **sensor).withColumn("h", F.lit(float(fallback_alt)))
    columns, line = left_over.columns, Window.partitionBy("line_id", "line")
    terrain = dem.select(F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("alt").alias("__h"))
    parts = []
    for k in range(rounds):
        hit = _hits(left_over, F.col("h")).withColumns({"__y": F.floor((F.lit(top) - F.col("glat")) / yres).cast("int"), "__x": F.floor((F.col("glon") - left) / xres).cast("int")})
        seen = hit.join(terrain, ["__y", "__x"], "left").withColumn("__new", F.coalesce("__h", F.lit(float(fallback_alt))))
        still = F.max(F.when(F.col("valid"), F.abs(F.col("__new") - F.col("h")))).over(line) <= tolerance
        seen = seen.withColumns({"h": F.col("__new"), "__done": F.coalesce(still, F.lit(True))}).select(*columns, F.col("__done").alias("done"))
        seen = materialise(seen, "terrain-round")
        parts.append(seen.where("done"))
        left_over = seen.where("NOT done").drop("done")
        if k == rounds - 1 or left_over.isEmpty():
            break
    cells = left_over.withColumn("done", F.lit(False))
    for part in parts:
        cells = cells.unionByName(part)
    found = _hits(cells, F.col("h"))
    return found.select("line_id", "line", "sample", F.col("glon").alias("lon"), F.col("glat").alias("lat"), F.col("galt").alias("alt"), (F.col("valid") & F.col("done")).alias("valid"))


def sample_dem(points: DataFrame, dem: DataFrame, left: float, top: float, xres: float, yres: float) -> DataFrame:
    """points (lon, lat, ...) with dem_alt of the nearest cell of dem(y, x, alt), NULL off it."""
    keyed = points.withColumns({"__y": F.floor((F.lit(top) - F.col("lat")) / yres).cast("int"), "__x": F.floor((F.col("lon") - left) / xres).cast("int")})
    return keyed.join(dem.select(F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("alt").alias("dem_alt")), ["__y", "__x"], "left").drop("__y", "__x")


def extent(ground: DataFrame) -> DataFrame:
    """A row for each line_id: bounds of its valid points, resolution, canvas size and pixel sizes; a rounding doesn't add a row or column."""
    size = ground.groupBy("line_id").agg(*(f(F.when(F.col("valid"), F.col(c))).alias(n) for f, c, n in ((F.min, "lon", "left"), (F.max, "lon", "right"), (F.min, "lat", "bottom"), (F.max, "lat", "top"))), F.count_distinct("line").alias("lines"), (F.max("sample") + 1).alias("samples"))
    wide, high = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    res = F.greatest(wide / F.col("samples"), high / F.col("lines"))
    out = size.where(F.col("left").isNotNull()).withColumn("res", F.when(res > 0, res).otherwise(F.lit(1e-6)))
    out = out.withColumns({"width": F.greatest(F.lit(1), F.ceil(wide / F.col("res") - 1e-9).cast("int")), "height": F.greatest(F.lit(1), F.ceil(high / F.col("res") - 1e-9).cast("int"))})
    return out.select("line_id", "left", "bottom", "right", "top", "res", "width", "height", (wide / F.col("width")).alias("xres"), (high / F.col("height")).alias("yres"))


def index_map(ground: DataFrame) -> DataFrame:
    """(line_id, y, x, line, sample): the point nearest to the centre of each canvas cell, the smaller line and sample on ties.

    It depends on no band, so it is made once and every band joins it.
    """
    placed = ground.where("valid").join(extent(ground), "line_id")
    fx = F.coalesce(F.try_divide(F.col("lon") - F.col("left"), F.col("xres")), F.lit(0.0))
    fy = F.coalesce(F.try_divide(F.col("top") - F.col("lat"), F.col("yres")), F.lit(0.0))
    placed = placed.withColumns({"fx": fx, "fy": fy})
    placed = placed.withColumns({"x": F.least(F.floor("fx"), F.col("width") - 1).cast("int"), "y": F.least(F.floor("fy"), F.col("height") - 1).cast("int")})
    dx, dy = F.col("fx") - F.col("x") - 0.5, F.col("fy") - F.col("y") - 0.5
    best = placed.groupBy("line_id", "y", "x").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "line", "sample")).alias("m"))
    return best.select("line_id", "y", "x", F.col("m.line").alias("line"), F.col("m.sample").alias("sample"))


def resample(values: DataFrame, ground: DataFrame) -> DataFrame:
    """(line_id, band, y, x, v) of raw values (line_id, line, sample, band, v)."""
    return values.join(index_map(ground), ["line_id", "line", "sample"]).select("line_id", "band", "y", "x", "v")


def footprint(ground: DataFrame) -> DataFrame:
    """(line_id, ring): first line, last sample, last line backwards, first sample backwards, valid points only, closed; NULL below 2 x 2."""
    ends = ground.groupBy("line_id").agg(F.min("line").alias("l0"), F.max("line").alias("l1"), F.max("sample").alias("s1"))
    g = ground.where("valid").join(ends, "line_id").where((F.col("l1") > F.col("l0")) & (F.col("s1") > 0))
    line, sample = F.col("line").cast("bigint"), F.col("sample").cast("bigint")
    edges = [(F.col("line") == F.col("l0"), sample), (F.col("sample") == F.col("s1"), line), (F.col("line") == F.col("l1"), -sample), (F.col("sample") == 0, -line)]
    places = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(k).alias("edge"), at.alias("at"))) for k, (on, at) in enumerate(edges))))
    points = g.select("line_id", "lon", "lat", F.explode(places).alias("place"))
    rings = points.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("place", "lon", "lat"))).alias("p"))
    ring = F.transform("p", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat")))
    return rings.select("line_id", F.concat(ring, F.slice(ring, 1, 1)).alias("ring"))


def simplify(rings: DataFrame, tolerance: float) -> DataFrame:
    """rings with fewer points: none that is dropped lies farther than tolerance from the line that stays (Douglas-Peucker, iterative)."""

    def lines(parts):
        for frame in parts:
            frame = frame.copy()
            frame["ring"] = [_thinned(ring, tolerance) for ring in frame["ring"]]
            yield frame

    return rings.mapInPandas(lines, rings.schema)


def _thinned(ring, tolerance: float) -> list[dict]:
    points = np.array([(p["lon"], p["lat"]) for p in ring], dtype=np.float64)
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, rest = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*base)
        away = np.abs(base[0] * rest[:, 1] - base[1] * rest[:, 0]) / length if length > 0 else np.hypot(rest[:, 0], rest[:, 1])
        worst = int(away.argmax())
        if away[worst] > tolerance:
            m = a + 1 + worst
            keep[m] = True
            todo += [(a, m), (m, b)]
    return [{"lon": x, "lat": y} for x, y in points[keep]]
