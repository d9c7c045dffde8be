"""Mosaicking: every pixel of the mosaic comes from exactly one frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.crs import CODES
from ..tables import materialise

TOLERANCE = 1e-6
#: Points on each edge of a frame whose places in another system bound the frame there.
EDGE = 21


def violations(frames: DataFrame, reproject: bool = False, tolerance: float = TOLERANCE) -> DataFrame:
    """(frame_id, problem) of frames that don't go with the first one: crs, resolution, bands or dtype, in this order.

    With reproject only systems that functions.crs doesn't know are a problem, unless they equal the first frame's.
    The first frame is one row, so the product with it is bounded. No frame at all gives no row; require() tells that apart.
    """
    names = ("crs", "a", "e", "band_count", "dtype")
    known = lambda c: F.coalesce(F.regexp_like(c, F.lit(CODES)), F.lit(False))
    first = frames.agg(F.min_by(F.struct(*names), "frame_id").alias("ref"))
    far = lambda c: F.abs(F.abs(c) - F.abs(F.col(f"ref.{c}"))) > tolerance * F.abs(F.col(f"ref.{c}"))
    other = ~F.col("crs").eqNullSafe(F.col("ref.crs"))
    rules = [F.when(other & ~(known("crs") & known("ref.crs")), "crs")] if reproject else [F.when(other, "crs"), F.when(far("a") | far("e"), "resolution")]
    rules += [F.when(F.col("band_count") != F.col("ref.band_count"), "bands"), F.when(F.col("dtype") != F.col("ref.dtype"), "dtype")]
    return frames.crossJoin(F.broadcast(first)).select("frame_id", F.coalesce(*rules).alias("problem")).where(F.col("problem").isNotNull())


def require(frames: DataFrame, reproject: bool = False) -> None:
    """ValueError without frames or with the first frame that doesn't fit."""
    if frames.isEmpty():
        raise ValueError("no frames to mosaic")
    bad = violations(frames, reproject).orderBy("frame_id").limit(1).collect()
    if bad:
        raise ValueError(f"frame {bad[0].frame_id} differs from the first frame: {bad[0].problem}")


def bounds(frames: DataFrame) -> DataFrame:
    """One row: union bounds, pixel size of the first frame, and the canvas size, rounded half to even."""
    right, bottom = F.col("c") + F.col("width") * F.col("a"), F.col("f") + F.col("height") * F.col("e")
    out = frames.agg(F.min("c").alias("left"), F.max(right).alias("right"), F.max("f").alias("top"), F.min(bottom).alias("bottom"), F.min_by("a", "frame_id").alias("xres"), F.min_by(-F.col("e"), "frame_id").alias("yres"))
    return out.withColumns({"width": F.rint((F.col("right") - F.col("left")) / F.col("xres")).cast("int"), "height": F.rint((F.col("top") - F.col("bottom")) / F.col("yres")).cast("int")})


def place(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """pixels with y and x moved onto the canvas of all frames, to the nearest cell. The catalog joins by frame."""
    grid = bounds(frames).select("left", "top", "xres", "yres")
    moves = frames.crossJoin(F.broadcast(grid)).select("frame_id", F.rint((F.col("top") - F.col("f")) / F.col("yres")).cast("int").alias("dy"), F.rint((F.col("c") - F.col("left")) / F.col("xres")).cast("int").alias("dx"))
    return pixels.join(moves, "frame_id").select("frame_id", "band", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")


def union(*parts: DataFrame) -> DataFrame:
    """All pixels of several frame sets."""
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def first_wins(pixels: DataFrame) -> DataFrame:
    """(band, y, x, v, source_id): the first valid frame in order, band by band. Combines before the shuffle."""
    best = pixels.where(F.col("v").isNotNull()).groupBy("band", "y", "x").agg(F.min(F.struct("frame_id", "v")).alias("m"))
    return best.select("band", "y", "x", F.col("m.v").alias("v"), F.col("m.frame_id").alias("source_id"))


def last_wins(pixels: DataFrame) -> DataFrame:
    """Like first_wins() with the last frame on top, as stacked virtual rasters do."""
    best = pixels.where(F.col("v").isNotNull()).groupBy("band", "y", "x").agg(F.max(F.struct("frame_id", "v")).alias("m"))
    return best.select("band", "y", "x", F.col("m.v").alias("v"), F.col("m.frame_id").alias("source_id"))


def overlap_count(pixels: DataFrame, band: int = 1) -> DataFrame:
    """(y, x, n): how many frames are valid at a pixel, by one band."""
    return pixels.where((F.col("band") == band) & F.col("v").isNotNull()).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))


def grid(pixels: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """(y, x) of a full canvas; its size comes from the data where it isn't given."""
    spark = pixels.sparkSession
    if height is not None and width is not None:
        size = spark.range(1).select(F.lit(height).alias("h"), F.lit(width).alias("w"))
    else:
        size = pixels.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return _cells(size.where(F.col("h") > 0), [])


def _cells(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x) of every cell of canvases (keys, h, w); rows are dealt to all tasks before they become cells."""
    rows = sizes.select(*keys, "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    dealt = rows.repartition(sizes.sparkSession.sparkContext.defaultParallelism, *keys, "y")
    return dealt.select(*keys, "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))


def absent(cells: DataFrame) -> DataFrame:
    """(band, y, x) of cells that the box of a band's cells has no row for; none where a table is dense. Rows of the canvas are looked at one by one."""
    rows = cells.groupBy("band", "y").agg(F.collect_set("x").alias("xs"))
    box = cells.groupBy("band").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    every = box.select("band", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).join(rows, ["band", "y"], "left")
    return every.select("band", "y", F.explode(F.array_except(F.sequence("x0", "x1"), F.coalesce("xs", F.array().cast("array<int>")))).alias("x"))


def coverage(pixels: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """(y, x, covered) for the full canvas: 1 where a frame is valid."""
    return grid(pixels, height, width).join(overlap_count(pixels), ["y", "x"], "left").select("y", "x", F.col("n").isNotNull().cast("int").alias("covered"))


def sources(mosaic: DataFrame, band: int = 1) -> DataFrame:
    """(y, x, source_id) by one band."""
    return mosaic.where(F.col("band") == band).select("y", "x", "source_id")


def provenance(sources_: DataFrame, frames: DataFrame | None = None, name: str = "path") -> DataFrame:
    """(source_id, pixels, fraction) and, with a catalog that has it, each frame's name."""
    counts = sources_.where(F.col("source_id") != 0).groupBy("source_id").agg(F.count(F.lit(1)).alias("pixels"))
    total = counts.agg(F.sum("pixels").alias("all"))
    out = counts.crossJoin(F.broadcast(total)).select("source_id", "pixels", (F.col("pixels") / F.col("all")).alias("fraction"))
    if frames is None:
        return out
    return out.join(frames.select(F.col("frame_id").alias("source_id"), F.substring_index(name, "/", -1).alias("name")), "source_id", "left")


def distance(valid: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys, y, x, distance): exact Euclidean distance of valid cells to the nearest invalid one on the canvas.

    The canvas' border isn't an edge; without any invalid cell the distance is infinite. valid has a row for each valid cell. Only the box of a key's valid
    cells and a ring of one cell around it, as far as the canvas goes, are looked at: what lies farther out is farther than the ring. Two separable passes: the
    nearest invalid row in each column by windows, then the least of dx^2 + g^2 along each row, in numpy for blocks of whole rows.
    """
    found = valid.select(*keys, "y", "x")
    ends = lambda c, most: (F.greatest(F.min(c) - 1, F.lit(0)).cast("int"), F.least(F.max(c) + 1, F.lit(most - 1)).cast("int"))
    (y0, y1), (x0, x1) = ends("y", height), ends("x", width)
    boxes = found.groupBy(*keys).agg(y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))
    every = _cells(boxes.select(*keys, "y0", "x0", (F.col("y1") - F.col("y0") + 1).alias("h"), (F.col("x1") - F.col("x0") + 1).alias("w")), [*keys, "y0", "x0"])
    every = every.select(*keys, (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"))
    cells = every.join(found.withColumn("ok", F.lit(True)), [*keys, "y", "x"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    column = Window.partitionBy(*keys, "x").orderBy("y")
    gone = F.when(~F.col("ok"), F.col("y"))
    up = F.last(gone, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    down = F.min(gone).over(Window.partitionBy(*keys, "x").orderBy(F.col("y").desc()).rowsBetween(Window.unboundedPreceding, 0))
    near = F.least(F.col("y") - up, down - F.col("y")).cast("bigint")
    g = cells.withColumn("g", near)
    kinds = {f.name: f.dataType.simpleString() for f in valid.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", y int, x int, distance double"
    blocks = g.withColumn("__block", F.floor(F.col("y") / 32)).groupBy(*keys, "__block")
    return blocks.applyInPandas(lambda frame: _row_pass(frame, keys), schema)


def _row_pass(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Least of dx^2 + g^2 along whole rows: offsets grow until none can be nearer."""
    top, left = int(frame["y"].min()), int(frame["x"].min())
    ys, xs = frame["y"].to_numpy() - top, frame["x"].to_numpy() - left
    width = int(xs.max()) + 1
    g = np.full((ys.max() + 1, width), np.inf)
    g[ys, xs] = frame["g"].to_numpy(dtype=np.float64, na_value=np.inf)
    ok = np.zeros(g.shape, dtype=bool)
    ok[ys, xs] = frame["ok"].to_numpy()
    squares = g * g
    best = squares.copy()
    for dx in range(1, width):
        if dx * dx >= best.max():
            break
        best[:, dx:] = np.minimum(best[:, dx:], squares[:, :-dx] + dx * dx)
        best[:, :-dx] = np.minimum(best[:, :-dx], squares[:, dx:] + dx * dx)
    out = frame.loc[ok[ys, xs], [*keys, "y", "x"]].copy()
    out["distance"] = np.sqrt(best[ys, xs][ok[ys, xs]])
    return out


def _band_distance(found: DataFrame, height: int, width: int) -> DataFrame:
    """(frame_id, band, y, x, distance) of valid cells; bands of a frame that are valid at the same cells share one distance."""
    cell = F.xxhash64("y", "x")
    half = F.lit(0xFFFFFFFF).cast("bigint")
    alike = found.groupBy("frame_id", "band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(cell).alias("p"), F.sum(cell.bitwiseAND(half)).alias("q"))
    alike = materialise(alike.withColumn("like", F.min("band").over(Window.partitionBy("frame_id", "n", "p", "q"))).select("frame_id", "band", "like"), "bands-alike")
    firsts = alike.where(F.col("band") == F.col("like")).select("frame_id", "band")
    depth = distance(found.join(firsts, ["frame_id", "band"], "left_semi"), ["frame_id", "band"], height, width)
    return depth.withColumnRenamed("band", "like").join(alike, ["frame_id", "like"]).drop("like")


def best_pixel(pixels: DataFrame, height: int, width: int, per_band: bool = True, bands: int | None = None, edgeless: bool = True) -> DataFrame:
    """(band, y, x, v, source_id): the frame in whose valid area a pixel lies deepest; the earlier one on ties.

    A frame without any invalid cell is infinitely deep; without edgeless such frames, whose depth isn't defined, take no part.

    per_band chooses each band's winner by that band's validity; else a pixel counts as valid in a frame with all bands, and all bands come from one frame.
    """
    found = pixels.where(F.col("v").isNotNull())
    if per_band:
        depth = _band_distance(found.select("frame_id", "band", "y", "x"), height, width)
        scored = found.join(depth, ["frame_id", "band", "y", "x"])
    else:
        whole = found.groupBy("frame_id", "y", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == bands).drop("n")
        scored = found.join(distance(whole, ["frame_id"], height, width), ["frame_id", "y", "x"])
    if not edgeless:
        scored = scored.where(F.col("distance") < float("inf"))
    best = scored.groupBy("band", "y", "x").agg(F.max_by(F.struct("v", "frame_id"), F.struct("distance", -F.col("frame_id"))).alias("m"))
    return best.select("band", "y", "x", F.col("m.v").alias("v"), F.col("m.frame_id").alias("source_id"))


def resample(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Bilinear resampling of each frame to the first frame's pixel size, same crs: (frame_id, band, y, x, v).

    Each target cell takes the four source cells around its centre, the weights of invalid or missing ones left out.
    """
    ref = frames.agg(F.min_by("a", "frame_id").alias("ra"), F.min_by(-F.col("e"), "frame_id").alias("re"))
    scaled = frames.crossJoin(F.broadcast(ref)).select("frame_id", (F.col("ra") / F.col("a")).alias("sx"), (F.col("re") / -F.col("e")).alias("sy"), F.greatest(F.lit(1), F.rint(F.col("width") * F.col("a") / F.col("ra")).cast("int")).alias("w"), F.greatest(F.lit(1), F.rint(F.col("height") * -F.col("e") / F.col("re")).cast("int")).alias("h"))
    cells = _cells(scaled, ["frame_id", "sx", "sy"])
    return _bilinear(pixels, cells, (F.col("y") + 0.5) * F.col("sy") - 0.5, (F.col("x") + 0.5) * F.col("sx") - 0.5)


def _bilinear(pixels: DataFrame, cells: DataFrame, py: Column, px: Column) -> DataFrame:
    """(frame_id, band, y, x, v) of cells (frame_id, y, x) whose centres are at row py and column px of their frame."""
    corner = lambda p, k: (F.floor(p) + k).cast("int")
    weight = lambda p, k: (p - F.floor(p)) if k else (1 - (p - F.floor(p)))
    py_, px_ = F.col("__py"), F.col("__px")
    four = F.array(*(F.struct(corner(py_, j).alias("sy_"), corner(px_, i).alias("sx_"), (weight(py_, j) * weight(px_, i)).alias("weight")) for j in (0, 1) for i in (0, 1)))
    around = cells.select("frame_id", "y", "x", py.alias("__py"), px.alias("__px")).select("frame_id", "y", "x", F.inline(four)).where(F.col("weight") > 0)
    source = pixels.where(F.col("v").isNotNull()).select("frame_id", "band", F.col("y").alias("sy_"), F.col("x").alias("sx_"), "v")
    return around.join(source, ["frame_id", "sy_", "sx_"]).groupBy("frame_id", "band", "y", "x").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))


def warped_frames(frames: DataFrame) -> DataFrame:
    """The catalog on the first frame's grid: crs and pixel size are its, origin and size of frames of other systems bound what their edges become.

    Frames of the same system keep their origin. The different systems, a few codes, come to the driver; frames of unknown ones are left out (see violations()).
    """
    ref = frames.orderBy("frame_id").limit(1).select("crs", "a", "e").first()
    if ref is None:
        return frames
    codes = _codes(frames, ref.crs)
    share = F.transform(F.sequence(F.lit(0), F.lit(EDGE - 1)), lambda k: k / (EDGE - 1))
    edges = F.flatten(F.transform(share, lambda k: F.array(F.struct(k.alias("i"), F.lit(0.0).alias("j")), F.struct(k.alias("i"), F.lit(1.0).alias("j")), F.struct(F.lit(0.0).alias("i"), k.alias("j")), F.struct(F.lit(1.0).alias("i"), k.alias("j")))))
    points = frames.where(F.col("crs").isin(codes)).select("frame_id", "crs", "a", "c", "e", "f", "width", "height", F.inline(edges))
    x, y = crs.moved(F.col("c") + F.col("i") * F.col("width") * F.col("a"), F.col("f") + F.col("j") * F.col("height") * F.col("e"), F.col("crs"), codes, ref.crs)
    box = points.select("frame_id", x.alias("x"), y.alias("y")).groupBy("frame_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    same = F.col("crs") == ref.crs
    size = lambda own, far, step: F.greatest(F.lit(1), F.when(same, F.rint(own)).otherwise(F.ceil(far / step - 1e-9)).cast("int"))
    joined = frames.join(box, "frame_id")
    changed = {"width": size(F.col("width") * F.col("a") / ref.a, F.col("x1") - F.col("x0"), ref.a), "height": size(F.col("height") * F.col("e") / ref.e, F.col("y1") - F.col("y0"), -ref.e), "c": F.when(same, F.col("c")).otherwise(F.col("x0")), "f": F.when(same, F.col("f")).otherwise(F.col("y1")), "a": F.lit(ref.a), "e": F.lit(ref.e), "crs": F.lit(ref.crs)}
    return joined.select(*(changed[k].alias(k) if k in changed else F.col(k) for k in frames.columns))


def _codes(frames: DataFrame, ref: str) -> list[str]:
    return [r.crs for r in frames.select("crs").distinct().collect() if r.crs is not None and (r.crs == ref or crs.parsed(r.crs) and crs.parsed(ref))]


def warp(pixels: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels and catalog of all frames in the first frame's system and pixel size; bilinear, weights of invalid or missing cells left out.

    Each cell of a frame's new grid is looked up, through its centre, where it lies in the frame's own one; rows of cells are dealt to all tasks.
    """
    ref = frames.orderBy("frame_id").limit(1).select("crs").first()
    if ref is None:
        return pixels, frames
    target = materialise(warped_frames(frames), "warped-frames")
    own = frames.select("frame_id", F.col("crs").alias("__crs"), F.col("a").alias("__a"), F.col("e").alias("__e"), F.col("c").alias("__c"), F.col("f").alias("__f"))
    grids = target.join(own, "frame_id").select("frame_id", "a", "e", "c", "f", "__crs", "__a", "__e", "__c", "__f", F.col("width").alias("w"), F.col("height").alias("h"))
    cells = _cells(grids, [k for k in grids.columns if k not in ("w", "h")])
    x, y = crs.moved_back(F.col("c") + (F.col("x") + 0.5) * F.col("a"), F.col("f") + (F.col("y") + 0.5) * F.col("e"), ref.crs, F.col("__crs"), _codes(frames, ref.crs))
    placed = cells.withColumns({"__u": x, "__w": y})
    return _bilinear(pixels, placed, (F.col("__w") - F.col("__f")) / F.col("__e") - 0.5, (F.col("__u") - F.col("__c")) / F.col("__a") - 0.5), target


def rgb_bands(count: int) -> tuple[int, int, int]:
    """Bands shown as red, green and blue: 40, 25 and 12 % of the way; all the first below three bands."""
    if count < 3:
        return 1, 1, 1
    return tuple(min(count, max(1, round(share * (count - 1)) + 1)) for share in (0.40, 0.25, 0.12))


def chosen_bands(pixels: DataFrame, count: int) -> DataFrame:
    """(band, channel) pixels of the three display bands."""
    names: list[Column] = [F.struct(F.lit(c).alias("channel"), F.lit(b).alias("band")) for c, b in zip("rgb", rgb_bands(count), strict=True)]
    picks = pixels.sparkSession.range(1).select(F.inline(F.array(*names)))
    return pixels.join(F.broadcast(picks), "band")
