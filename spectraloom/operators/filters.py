"""Frame rejection: fixed thresholds, median absolute deviation, and per-band dropout and striping.

Each filter returns all frames with reason (NULL for kept ones), measured, threshold and, for ranges, low and high, as numbers; text is made by
functions.text. Cheap rules on the catalog come before any pixel is read, and the first failing rule is the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MAD_FACTOR, MAD_SCALE, MAX_DROPOUT, MAX_STRIPE, Thresholds

_INF = float("inf")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(_INF))


def area() -> Column:
    """Footprint of a frame on the ground."""
    return F.col("width") * F.col("height") * F.abs("a") * F.abs("e")


def skew() -> Column:
    """Rotation terms against pixel size; infinite without pixel size."""
    return _ratio(F.greatest(F.abs("b"), F.abs("d")), F.greatest(F.abs("a"), F.abs("e")))


def aspect() -> Column:
    return _ratio(F.greatest("width", "height").cast("double"), F.least("width", "height").cast("double"))


def with_median_area(frames: DataFrame) -> DataFrame:
    """frames with area and the median area of all of them; that is one row, so broadcasting it is bounded."""
    sized = frames.withColumn("area", area())
    return sized.crossJoin(F.broadcast(sized.agg(F.expr("percentile(area, 0.5)").alias("median_area"))))


def centre_window(pixels: DataFrame, frames: DataFrame, size: int, band: int = 1) -> DataFrame:
    """The valid values of one band inside the centred window of each frame, with the window's number of cells."""
    span = lambda side: F.least(F.lit(size), F.col(side))
    start = lambda side: F.floor((F.col(side) - span(side)) / 2)
    windows = frames.select("frame_id", start("height").alias("y0"), (start("height") + span("height")).alias("y1"), start("width").alias("x0"), (start("width") + span("width")).alias("x1"), (span("height") * span("width")).alias("cells"), *[c for c in ("dtype_max",) if c in frames.columns])
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return pixels.where((F.col("band") == band) & F.col("v").isNotNull()).join(windows, "frame_id").where(inside)


def window_statistics(pixels: DataFrame, frames: DataFrame, size: int) -> DataFrame:
    """valid_fraction, saturated (share at the data type's maximum, for integer types) and std of each frame's centre window."""
    full = F.col("dtype_max") if "dtype_max" in frames.columns else F.lit(None).cast("double")
    found = centre_window(pixels, frames, size).groupBy("frame_id").agg((F.count("v") / F.first("cells")).alias("valid_fraction"), F.avg((F.col("v") == full).cast("double")).alias("saturated"), F.stddev_pop("v").alias("std"))
    joined = frames.select("frame_id").join(found, "frame_id", "left")
    return joined.withColumn("valid_fraction", F.coalesce("valid_fraction", F.lit(0.0)))


def hard(frames: DataFrame, pixels: DataFrame | None = None, limits: Thresholds = Thresholds()) -> DataFrame:
    """Fixed thresholds; the order of the rules is skew, area, aspect, valid, saturation, std. Without pixels only the first three."""
    table = with_median_area(frames).withColumns({"skew": skew(), "aspect": aspect()})
    low, high = F.lit(limits.area_low) * F.col("median_area"), F.lit(limits.area_high) * F.col("median_area")
    rules = [
        ("skew", F.col("skew") > limits.skew_max, F.col("skew"), F.lit(limits.skew_max)),
        ("area", F.col("area") < low, F.col("area"), low, low, high),
        ("area", F.col("area") > high, F.col("area"), high, low, high),
        ("aspect", F.col("aspect") > limits.aspect_max, F.col("aspect"), F.lit(limits.aspect_max)),
    ]
    if pixels is not None:
        # only survivors of the rules above need their pixels: a semi join that prunes partitions by frame
        alive = table.where(~F.coalesce(_any([x[1] for x in rules]), F.lit(False))).select(*frames.columns)
        table = table.join(window_statistics(pixels, alive, limits.centre_window), "frame_id", "left")
        rules += [
            ("valid", F.col("valid_fraction") < limits.valid_min, F.col("valid_fraction"), F.lit(limits.valid_min)),
            ("saturation", F.col("saturated") > limits.saturation_max, F.col("saturated"), F.lit(limits.saturation_max)),
            ("std", F.col("std") < limits.std_min, F.col("std"), F.lit(limits.std_min)),
        ]
    return _judged(table, frames.columns, rules)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for x in conditions:
        out = out | x
    return out


def _verdict(name: str, *numbers: Column) -> Column:
    """reason, measured, threshold, and low and high where a range is allowed."""
    values = [*numbers, *[F.lit(None)] * (4 - len(numbers))]
    return F.struct(F.lit(name).alias("reason"), *(x.cast("double").alias(c) for x, c in zip(values, ("measured", "threshold", "low", "high"), strict=True)))


def _judged(table: DataFrame, columns: list[str], rules: list[tuple]) -> DataFrame:
    verdict = F.coalesce(*(F.when(bad, _verdict(name, *numbers)) for name, bad, *numbers in rules))
    return table.withColumn("__verdict", verdict).select(*columns, "__verdict.*")


def adaptive(frames: DataFrame, factor: float = MAD_FACTOR) -> DataFrame:
    """Areas beyond factor scaled median absolute deviations from the median go; without deviation all stay."""
    sized = with_median_area(frames)
    spread = sized.agg((F.lit(MAD_SCALE) * F.expr("percentile(abs(area - median_area), 0.5)")).alias("spread"))
    table = sized.crossJoin(F.broadcast(spread))
    reach, real = F.lit(factor) * F.col("spread"), F.col("spread") > 0
    low, high = F.col("median_area") - reach, F.col("median_area") + reach
    return _judged(table, frames.columns, [("outlier", real & (F.col("area") < low), F.col("area"), low, low, high), ("outlier", real & (F.col("area") > high), F.col("area"), high, low, high)])


def band_statistics(pixels: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """dropout (share of zeros and, in frames of integer types, of values at the type's maximum) and stripe (variance of column means against that of all values) by frame and band.

    frames gives dtype_max, NULL for other types. One shuffle by frame, band and column gives counts, means and squared deviations, which are combined
    around the mean of all, so that neither a small scale nor a large offset cancels. stripe is NULL with fewer than two columns and 1 without variance.
    """
    valid = pixels.where(F.col("v").isNotNull())
    bad = F.col("v") == 0
    if frames is not None and "dtype_max" in frames.columns:
        valid = valid.join(frames.select("frame_id", "dtype_max"), "frame_id", "left")
        bad = bad | F.coalesce(F.col("v") == F.col("dtype_max"), F.lit(False))
    columns = valid.groupBy("frame_id", "band", "x").agg(F.avg("v").alias("mean"), F.count("v").alias("n"), (F.var_pop("v") * F.count("v")).alias("inner"), F.count_if(bad).alias("bad"))
    line = Window.partitionBy("frame_id", "band")
    away = F.col("mean") - F.sum(F.col("n") * F.col("mean")).over(line) / F.sum("n").over(line)
    columns = columns.withColumn("outer", F.col("n") * away * away)
    out = columns.groupBy("frame_id", "band").agg((F.sum("bad") / F.sum("n")).alias("dropout"), F.var_pop("mean").alias("between"), ((F.sum("inner") + F.sum("outer")) / F.sum("n")).alias("all"), (F.sum("inner") + F.max("mean") - F.min("mean")).alias("varied"), F.count(F.lit(1)).alias("columns"))
    # equal values have a mean that may be off by a rounding
    flat = (F.col("all") <= 0) | (F.col("varied") <= 0)
    stripe = F.when(F.col("columns") >= 2, F.when(flat, F.lit(1.0)).otherwise(F.col("between") / F.col("all")))
    return out.select("frame_id", "band", "dropout", stripe.alias("stripe"))


def per_band(frames: DataFrame, pixels: DataFrame, max_dropout: float = MAX_DROPOUT, max_stripe: float = MAX_STRIPE) -> DataFrame:
    """The lowest failing band decides, dropout before stripe; a frame without valid values in a band has dropout 1 there."""
    stats = band_statistics(pixels, frames)
    wanted = frames.select("frame_id", F.explode(F.sequence(F.lit(1), F.col("band_count"))).alias("band"))
    table = wanted.join(stats, ["frame_id", "band"], "left").withColumn("dropout", F.coalesce("dropout", F.lit(1.0)))
    rule = F.coalesce(*(F.when(F.col(c) > most, _verdict(c, F.col(c), F.lit(most), F.lit(0.0), F.lit(most))) for c, most in (("dropout", max_dropout), ("stripe", max_stripe))))
    first = table.withColumn("rule", rule).where(F.col("rule").isNotNull()).groupBy("frame_id").agg(F.min_by(F.struct("band", "rule"), "band").alias("x"))
    joined = frames.join(first, "frame_id", "left")
    return joined.select(*frames.columns, F.col("x.rule.reason").alias("reason"), F.col("x.band").alias("band"), *(F.col(f"x.rule.{c}").alias(c) for c in ("measured", "threshold", "low", "high")))


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of a filter's result."""
    return judged.where(F.col("reason").isNull()), judged.where(F.col("reason").isNotNull())
