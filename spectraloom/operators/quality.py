"""Quality of a mosaic against a reference: (band, y, x, v) pixel tables on one grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.percentiles import percentiles
from ..tables import materialise
from .mosaic import absent
from .mosaic import grid as whole_grid

_INF = float("inf")
#: Metrics of which the smallest band is the worst.
LOW_IS_BAD = ("psnr", "ssim")
EPSILON = 1e-12


def align(reference: DataFrame, ref_grid: tuple[float, float, float, float], grid: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """reference by nearest neighbour on another grid; a grid is (left, top, x size, y size).

    Each target row and column maps to one source index, so two small joins place all bands.
    """
    left, top, sx, sy = grid
    rleft, rtop, rsx, rsy = ref_grid
    spark = reference.sparkSession
    ys = spark.range(height).select(F.col("id").cast("int").alias("y"), F.floor((F.lit(rtop) - (F.lit(top) - (F.col("id") + 0.5) * F.lit(sy))) / F.lit(rsy)).cast("int").alias("sy_"))
    xs = spark.range(width).select(F.col("id").cast("int").alias("x"), F.floor((F.lit(left) + (F.col("id") + 0.5) * F.lit(sx) - F.lit(rleft)) / F.lit(rsx)).cast("int").alias("sx_"))
    source = reference.select("band", F.col("y").alias("sy_"), F.col("x").alias("sx_"), "v")
    return source.join(ys, "sy_").join(xs, "sx_").select("band", "y", "x", "v")


def align_warped(reference: DataFrame, ref_grid: tuple[float, float, float, float], ref_crs: str, grid: tuple[float, float, float, float], target_crs: str, height: int, width: int) -> DataFrame:
    """align() for a reference in another system: each target cell takes the reference cell that its centre lies in. ValueError for unknown systems.

    Rows of cells are dealt to all tasks; the places depend on no band, so they are made once and every band joins them.
    """
    left, top, sx, sy = grid
    rleft, rtop, rsx, rsy = ref_grid
    cells = whole_grid(reference, height, width)
    x, y = crs.from_geographic(*crs.to_geographic(F.lit(left) + (F.col("x") + 0.5) * F.lit(sx), F.lit(top) - (F.col("y") + 0.5) * F.lit(sy), target_crs), ref_crs)
    places = cells.select("y", "x", F.floor((F.lit(rtop) - y) / F.lit(rsy)).cast("int").alias("sy_"), F.floor((x - F.lit(rleft)) / F.lit(rsx)).cast("int").alias("sx_"))
    return reference.select("band", F.col("y").alias("sy_"), F.col("x").alias("sx_"), "v").join(places, ["sy_", "sx_"]).select("band", "y", "x", "v")


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < _INF), F.col(c))


def pair(reference: DataFrame, mosaic: DataFrame) -> DataFrame:
    """(band, y, x, p, q): cells valid in both, p from the reference."""
    left = reference.select("band", "y", "x", _finite("v").alias("p")).where(F.col("p").isNotNull())
    right = mosaic.select("band", "y", "x", _finite("v").alias("q")).where(F.col("q").isNotNull())
    return left.join(right, ["band", "y", "x"])


def scalars(pairs: DataFrame, only: Column | None = None) -> DataFrame:
    """(band, n, rmse, mae, psnr) in one aggregation; psnr is infinite for equal images or a constant reference.

    only restricts the cells without dropping bands: one without such cells has n = 0 and NULLs.
    """
    keep = (lambda x: F.when(only, x)) if only is not None else (lambda x: x)
    d = keep(F.col("p") - F.col("q"))
    out = pairs.groupBy("band").agg(F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), (F.max(keep(F.col("p"))) - F.min(keep(F.col("p")))).alias("span"))
    psnr = F.when(F.col("n") > 0, F.when((F.col("mse") <= 0) | (F.col("span") <= 0), F.lit(_INF)).otherwise(20 * F.log10("span") - 10 * F.log10("mse")))
    return out.select("band", "n", "rmse", "mae", psnr.alias("psnr"))


def skipped_bands(bands: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bands (band) without a common valid cell."""
    return bands.select("band").distinct().join(pairs.select("band").distinct(), "band", "left_anti")


def ssim(reference: DataFrame, mosaic: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(band, ssim): mean structural similarity over uniform 7 x 7 windows, 3 cells cropped at the border.

    Both tables hold every cell of the grid. Cells that aren't valid in both (or not in only (y, x), where given) take the mean of the valid
    reference in both images; the data range is that of the valid reference, or 1. Window moments are separable: two windows for five sums and the count of
    cells. Cells without a row, as behind the end of a last line that is cut short, are put in on the way and count nowhere.
    """
    p, q = reference.select("band", "y", "x", _finite("v").alias("p")), mosaic.select("band", "y", "x", _finite("v").alias("q"))
    cells = p.join(q, ["band", "y", "x"])
    good = F.col("p").isNotNull() & F.col("q").isNotNull()
    if only is not None:
        cells = cells.join(only.select("y", "x", F.lit(True).alias("__in")), ["y", "x"], "left")
        good = good & F.coalesce("__in", F.lit(False))
    cells = cells.withColumn("good", good)
    stats = cells.groupBy("band").agg(F.avg(F.when(F.col("good"), F.col("p"))).alias("mean"), (F.max(F.when(F.col("good"), F.col("p"))) - F.min(F.when(F.col("good"), F.col("p")))).alias("span"), F.max("y").alias("y1"), F.max("x").alias("x1")).where(F.col("mean").isNotNull())
    full = cells.join(stats, "band").select("band", "y", "x", "span", "y1", "x1", *(F.when(F.col("good"), F.col(c)).otherwise(F.col("mean")).alias(c) for c in "pq"))
    moments = {"n": F.lit(1.0), "u": F.col("p"), "w": F.col("q"), "uu": F.col("p") * F.col("p"), "ww": F.col("q") * F.col("q"), "uw": F.col("p") * F.col("q")}
    full = full.select("band", "y", "x", "span", "y1", "x1", *(m.alias(k) for k, m in moments.items()), F.lit(True).alias("here"))
    full = full.unionByName(absent(cells).withColumn("here", F.lit(False)), allowMissingColumns=True)
    for line, order in (("y", "x"), ("x", "y")):
        box = Window.partitionBy("band", line).orderBy(order).rowsBetween(-3, 3)
        full = full.select("band", "y", "x", "span", "y1", "x1", *(F.sum(k).over(box).alias(k) for k in moments), "here")
    inner = full.where(F.col("here") & (F.col("y") >= 3) & (F.col("x") >= 3) & (F.col("y") <= F.col("y1") - 3) & (F.col("x") <= F.col("x1") - 3))
    m = {k: F.col(k) / F.col("n") for k in moments}
    unbiased = 49 / 48
    vu, vw, cov = unbiased * (m["uu"] - m["u"] * m["u"]), unbiased * (m["ww"] - m["w"] * m["w"]), unbiased * (m["uw"] - m["u"] * m["w"])
    span = F.when(F.col("span") > 0, F.col("span")).otherwise(F.lit(1.0))
    c1, c2 = (0.01 * span) * (0.01 * span), (0.03 * span) * (0.03 * span)
    value = ((2 * m["u"] * m["w"] + c1) * (2 * cov + c2)) / ((m["u"] * m["u"] + m["w"] * m["w"] + c1) * (vu + vw + c2))
    return inner.groupBy("band").agg(F.avg(value).alias("ssim"))


def band_metrics(reference: DataFrame, mosaic: DataFrame, fillmask: DataFrame | None = None) -> DataFrame:
    """(band, metric, variant, value) for rmse, mae, psnr and ssim.

    variant base uses all common cells, overlap_only is the same by definition, filled_only the cells with state 1 (only with a fillmask).
    """
    pairs = pair(reference, mosaic)
    parts = [scalars(pairs).join(ssim(reference, mosaic), "band", "left").withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("overlap_only"))))]
    if fillmask is not None:
        filled = fillmask.where(F.col("state") == 1).select("y", "x")
        parts.append(scalars(pairs.join(filled, ["y", "x"], "left_semi")).join(ssim(reference, mosaic, filled), "band", "left").withColumn("variant", F.lit("filled_only")))
    long = [x.select("band", F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col("variant"), F.col(k).alias("value")) for k in ("rmse", "mae", "psnr", "ssim"))))) for x in parts]
    return long[0] if len(long) == 1 else long[0].unionByName(long[1])


def aggregates(metrics: DataFrame) -> DataFrame:
    """(metric, variant, mean, worst, worst_band, p05, p05_band): over bands with a value.

    The worst is the largest error or the smallest psnr and ssim, the lowest band on ties; p05 is the 95th percentile of errors and the 5th of
    psnr and ssim, with the band nearest to it.
    """
    low = F.col("metric").isin(*LOW_IS_BAD)
    valued = metrics.where(F.col("value").isNotNull())
    found = valued.groupBy("metric", "variant").agg(F.avg("value").alias("mean"), F.max("value").alias("__high"), F.min("value").alias("__low"), F.expr("percentile(value, 0.95)").alias("__p95"), F.expr("percentile(value, 0.05)").alias("__p05"))
    found = found.select("metric", "variant", "mean", F.when(low, F.col("__low")).otherwise(F.col("__high")).alias("worst"), F.when(low, F.col("__p05")).otherwise(F.col("__p95")).alias("p05"))
    away = F.when(F.col("value") == F.col("p05"), F.lit(0.0)).otherwise(F.abs(F.col("value") - F.col("p05")))
    bands = valued.join(found, ["metric", "variant"]).groupBy("metric", "variant").agg(F.min(F.when(F.col("value") == F.col("worst"), F.col("band"))).alias("worst_band"), F.min(F.struct(away.alias("away"), "band")).getField("band").alias("p05_band"))
    return found.join(bands, ["metric", "variant"]).select("metric", "variant", "mean", "worst", "worst_band", "p05", "p05_band")


def angles(reference: DataFrame, mosaic: DataFrame, bands: int) -> DataFrame:
    """(y, x, angle): spectral angle of pixels valid in all bands with both norms positive; one aggregation by pixel."""
    sums = pair(reference, mosaic).groupBy("y", "x").agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.count(F.lit(1)).alias("n"))
    whole = sums.where((F.col("n") == bands) & (F.col("pp") > 0) & (F.col("qq") > 0))
    cosine = F.col("pq") / (F.sqrt("pp") * F.sqrt("qq") + EPSILON)
    return whole.select("y", "x", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("angle"))


def spectral_angle(reference: DataFrame, mosaic: DataFrame, bands: int) -> DataFrame:
    """One row: mean angle in radians and degrees and the number of pixels; NULL without any."""
    return angles(reference, mosaic, bands).agg(F.avg("angle").alias("sam"), F.degrees(F.avg("angle")).alias("sam_deg"), F.count(F.lit(1)).alias("pixels"))


def coverage_ratio(pixels: DataFrame) -> DataFrame:
    """One row: share of pixels valid in any band; pixels holds every cell of the grid."""
    any_band = pixels.groupBy("y", "x").agg(F.bool_or(F.col("v").isNotNull()).alias("valid"))
    return any_band.agg((F.count_if("valid") / F.count(F.lit(1))).alias("coverage_ratio"))


def nodata_fraction(pixels: DataFrame) -> DataFrame:
    """(band, nodata_fraction) of a table that holds every cell of the grid."""
    return pixels.groupBy("band").agg((1 - F.count("v") / F.count(F.lit(1))).alias("nodata_fraction"))


def filled_ratio(pixels: DataFrame, fillmask: DataFrame) -> DataFrame:
    """One row: share of the valid pixels that were filled."""
    valid = pixels.where(F.col("v").isNotNull()).select("y", "x").distinct().join(fillmask, ["y", "x"])
    return valid.agg(F.try_divide(F.count_if(F.col("state") == 1), F.count(F.lit(1))).alias("filled_pixel_ratio"))


def seam_mask(sources: DataFrame) -> DataFrame:
    """(y, x, seam) of pixels with a source: seam if a 4-neighbour has another one. Neighbours are found by windows along rows and columns."""
    found = sources.where(F.col("source_id") > 0)
    row, column = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")

    def differs(step: str, window, axis: str, by: int) -> Column:
        f = F.lag if step == "lag" else F.lead
        return F.coalesce((f(axis).over(window) == F.col(axis) + by) & (f("source_id").over(window) != F.col("source_id")), F.lit(False))

    seam = differs("lag", row, "x", -1) | differs("lead", row, "x", 1) | differs("lag", column, "y", -1) | differs("lead", column, "y", 1)
    return found.select("y", "x", seam.alias("seam"))


def seam_jumps(mosaic: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """(band, jump): differences of seam pixels to their upper and left neighbours, both valid; strict wants different sources too."""
    marked = seam_mask(sources).join(sources, ["y", "x"])
    cells = mosaic.where(F.col("v").isNotNull()).select("band", "y", "x", "v").join(marked, ["y", "x"], "left")
    row, column = Window.partitionBy("band", "y").orderBy("x"), Window.partitionBy("band", "x").orderBy("y")

    def jump(window, axis: str) -> Column:
        near = F.coalesce("seam", F.lit(False)) & (F.lag(axis).over(window) == F.col(axis) - 1)
        if strict:
            near = near & (F.lag("source_id").over(window) != F.col("source_id"))
        return F.when(near, F.abs(F.col("v") - F.lag("v").over(window)))

    both = cells.select("band", F.array_compact(F.array(jump(column, "y"), jump(row, "x"))).alias("jumps"))
    return both.select("band", F.explode("jumps").alias("jump"))


def seam_statistics(mosaic: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """(band, n, mean, median, p95, max) by band and, with a NULL band, pooled; pooled zeros without seams.

    Equal jumps of a band are counted first; percentiles come from running counts over ranges of them, so no band, nor all bands pooled, is gathered in one task.
    """
    counted = materialise(seam_jumps(mosaic, sources, strict).groupBy("band", "jump").agg(F.count(F.lit(1)).alias("n")), "counted-jumps")
    every = counted.unionByName(counted.groupBy("jump").agg(F.sum("n").alias("n")).withColumn("band", F.lit(None).cast(counted.schema["band"].dataType)))
    sums = every.groupBy("band").agg(F.sum("n").alias("n"), (F.sum(F.col("jump") * F.col("n")) / F.sum("n")).alias("mean"), F.max("jump").alias("max"))
    found = sums.join(percentiles(every, "band", "jump", {"median": 0.5, "p95": 0.95}).withColumnRenamed("band", "__band"), F.col("band").eqNullSafe(F.col("__band"))).drop("__band")
    stats = found.select("band", "n", "mean", "median", "p95", "max")
    # there is no pooled row of nothing, so one of zeros goes in; no figure is below it
    zeros = counted.sparkSession.range(1).select(F.lit(None).cast(counted.schema["band"].dataType).alias("band"), F.lit(0).cast("bigint").alias("n"), *(F.lit(0.0).alias(c) for c in ("mean", "median", "p95", "max")))
    return stats.unionByName(zeros).groupBy("band").agg(*(F.max(c).alias(c) for c in ("n", "mean", "median", "p95", "max")))


def seam_length(sources: DataFrame) -> DataFrame:
    """One row: number of seam pixels."""
    return seam_mask(sources).agg(F.count_if("seam").alias("seam_length"))
