"""Quality reports as text and JSON, from the small tables of plans.score: rows of bands and metrics, never of pixels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rasters import safe_number
from .text import fixed

METRICS = ("rmse", "mae", "psnr", "ssim")
# fixed values: the lines of the report
HEAD = "Band |       RMSE |        MAE |       PSNR |       SSIM |   Valid px"
RULE = "-----+------------+------------+------------+------------+-----------"
#: Bands whose seams the text report lists.
SEAM_BANDS = 5


def _padded(x: Column, width: int) -> Column:
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, " "))


def _number(x: Column, places: int, width: int = 0) -> Column:
    return _padded(F.coalesce(fixed(x, places), F.lit("nan")), width)


def _line(part: int, position: Column | int, *pieces: Column | str) -> list[Column]:
    at = F.lit(position) if isinstance(position, int) else position
    return [F.lit(part).alias("part"), at.cast("bigint").alias("position"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in pieces)).alias("value")]


def _text(spark, part: int, *lines: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*_line(part, k, x)) for k, x in enumerate(lines)))))


def _stack(df: DataFrame, part: int, *lines: tuple) -> DataFrame:
    """Several lines from each row of a small table."""
    return df.select(F.inline(F.array(*(F.struct(*_line(part, k, *x)) for k, x in enumerate(lines)))))


def report_text(score) -> DataFrame:
    """(part, position, value): the lines of the report, ordered by the first two; sections without data are left out.

    score is a plans.score.Score. Numbers have four decimals in the table of bands and metrics and six elsewhere; what has no value is nan.
    """
    spark = score.metrics.sparkSession
    base = score.metrics.where(F.col("variant") == "base")
    wide = base.groupBy("band").pivot("metric", list(METRICS)).agg(F.first("value")).join(score.valid, "band", "left")
    cells = lambda get: [x for m in METRICS for x in (" | ", get(m))]
    bands = wide.select(*_line(1, F.col("band"), _padded(F.col("band").cast("string"), 4), *cells(lambda m: _number(F.col(m), 4, 10)), " | ", _padded(F.coalesce("n", F.lit(0)).cast("string"), 9)))
    skipped = score.skipped.agg(F.array_sort(F.collect_list("band")).alias("b")).where(F.size("b") > 0)
    skipped = skipped.select(*_line(2, 0, "Skipped bands (no valid overlap): [", F.array_join(F.col("b").cast("array<string>"), ", "), "]"))

    ends = score.aggregates.where(F.col("variant") == "base").groupBy().pivot("metric", list(METRICS)).agg(*(F.first(c).alias(c) for c in ("mean", "worst", "worst_band", "p05", "p05_band")))
    row = lambda label, c: (f"{label:>10}", *cells(lambda m: _number(F.col(f"{m}_{c}"), 4, 10)), " |")
    whole = lambda label, c: (f"{label:>10}", *cells(lambda m: _padded(F.coalesce(F.col(f"{m}_{c}").cast("string"), F.lit("-")), 10)), " |")
    ends = _stack(ends, 4, row("MEAN", "mean"), row("WORST", "worst"), whole("WORST_BAND", "worst_band"), row("P05", "p05"), whole("P05_BAND", "p05_band"))

    angle = _stack(score.angle, 6, ("SAM     (rad) : ", _number(F.col("sam"), 6), "   [", F.col("pixels").cast("string"), " pixels valid in every band]"), ("SAM_DEG (deg) : ", _number(F.col("sam_deg"), 6)))
    parts = [_text(spark, 0, HEAD, RULE), bands, skipped, _text(spark, 3, RULE), ends, _text(spark, 5, RULE), angle, _text(spark, 7, RULE)]
    parts.append(score.coverage.select(*_line(8, 0, "Coverage ratio : ", _number(F.col("coverage_ratio"), 6), "   [fraction of valid pixels in mosaic]")))
    if score.filled is None:
        parts.append(_text(spark, 9, "Filled pixel ratio : N/A   [fillmask not available]"))
    else:
        parts.append(score.filled.select(*_line(9, 0, "Filled pixel ratio : ", _number(F.col("filled_pixel_ratio"), 6), "   [fraction of valid pixels that were gap-filled]")))
    gone = score.nodata.agg(F.array_sort(F.collect_list(F.struct("band", "nodata_fraction"))).alias("b")).where(F.size("b") > 0)
    parts.append(gone.select(*_line(10, 0, "NoData fraction per band : ", F.array_join(F.transform("b", lambda x: _number(x["nodata_fraction"], 4)), ", "))))
    if score.seams is not None:
        every = score.seams.where(F.col("band").isNull()).crossJoin(score.seam_length)
        names = (("mean", "mean"), ("median", "median"), ("p95", "p95"), ("max", "max"))
        lines = [(RULE,), ("Seam consistency metrics:",), ("  Seam pixel count: ", F.col("n").cast("string")), ("  Seam length (px): ", F.col("seam_length").cast("string"))]
        lines += [(f"  Overall {label} abs diff: ", _number(F.col(c), 6)) for label, c in names]
        parts.append(_stack(every, 11, *lines))
        some = score.seams.where(F.col("band").isNotNull())
        listed = some.agg(F.array_sort(F.collect_list(F.struct("band", *(c for _, c in names)))).alias("b")).where(F.size("b") > 0)
        shown = F.transform(F.slice("b", 1, SEAM_BANDS), lambda x: F.concat(F.lit("    Band "), x["band"].cast("string"), F.lit(": "), F.concat_ws(", ", *(F.concat(F.lit(f"{label}="), _number(x[c], 6)) for label, c in names))))
        more = F.when(F.size("b") > SEAM_BANDS, F.array(F.concat(F.lit("    ... and "), (F.size("b") - SEAM_BANDS).cast("string"), F.lit(" more bands")))).otherwise(F.array().cast("array<string>"))
        parts.append(listed.select(F.posexplode(F.concat(F.array(F.lit(f"  Per-band (first {SEAM_BANDS}):")), shown, more))).select(F.lit(12).alias("part"), F.col("pos").cast("bigint").alias("position"), F.col("col").alias("value")))
    if score.gaps is not None:
        parts.append(_stack(score.gaps, 13, (RULE,), ("Gap region metrics:",), ("  Number of gap regions: ", F.col("regions").cast("string")), ("  Largest gap (pixels): ", F.col("largest_cells").cast("string"))))
        parts.append(score.gaps.where(F.col("largest_area").isNotNull()).select(*_line(14, 0, "  Largest gap (m²): ", _number(F.col("largest_area"), 2))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _named(aggregates: DataFrame, variant: str) -> DataFrame:
    """One row with a struct of all metrics of a variant; fields are null where the variant has none."""
    fields = [F.first(F.when(F.col("metric") == m, F.struct(*(safe_number(F.col(c)).alias(c) if c in ("mean", "worst", "p05") else F.col(c) for c in ("mean", "worst", "worst_band", "p05", "p05_band")))), ignorenulls=True).alias(m) for m in METRICS]
    return aggregates.where(F.col("variant") == variant).agg(*fields)


def report_json(score, timestamp: str | None = None) -> DataFrame:
    """One row (report): JSON with the sections global_metrics, filled_only_metrics, overlap_only_metrics, per_band, coverage, provenance, meta, seam_consistency and gap_region_metrics.

    NaN and infinities become null; sections without data are null or hold nulls. timestamp is now, if not given.
    """
    spark = score.metrics.sparkSession
    one = spark.range(1).select()
    for name, variant in (("global_metrics", "base"), ("filled_only_metrics", "filled_only"), ("overlap_only_metrics", "overlap_only")):
        one = one.crossJoin(_named(score.aggregates, variant).select(F.struct(*METRICS).alias(name)))
    base = score.metrics.where(F.col("variant") == "base")
    wide = base.groupBy("band").pivot("metric", list(METRICS)).agg(F.first("value")).join(score.valid, "band", "left")
    one = one.crossJoin(wide.agg(F.array_sort(F.collect_list(F.struct("band", *(safe_number(F.col(m)).alias(m) for m in METRICS), F.col("n").alias("valid_pixels")))).alias("per_band")))
    filled = spark.range(1).select(F.lit(None).cast("double").alias("filled_pixel_ratio")) if score.filled is None else score.filled
    nodata = score.nodata.agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "nodata_fraction"))), lambda x: x["nodata_fraction"]).alias("nodata_fraction_per_band"))
    one = one.crossJoin(score.coverage.crossJoin(filled).crossJoin(nodata).select(F.struct("coverage_ratio", "filled_pixel_ratio", "nodata_fraction_per_band").alias("coverage")))
    one = one.crossJoin(score.skipped.agg(F.struct(F.lit(score.bands).alias("band_count"), F.array_sort(F.collect_list("band")).alias("skipped_bands")).alias("provenance")))
    one = one.withColumn("meta", F.struct(F.lit(timestamp or datetime.now().isoformat()).alias("timestamp")))
    if score.seams is None:
        one = one.withColumn("seam_consistency", F.lit(None).cast("string"))
    else:
        figures = [F.col(c).alias(f"{c}_abs_diff") for c in ("mean", "median", "p95", "max")]
        bands = score.seams.where(F.col("band").isNotNull()).agg(F.array_sort(F.collect_list(F.struct("band", F.col("n"), *figures))).alias("per_band"))
        every = score.seams.where(F.col("band").isNull()).select(F.struct(*figures).alias("overall"), F.col("n").alias("seam_pixel_count"))
        one = one.crossJoin(bands.crossJoin(every).crossJoin(score.seam_length).select(F.struct("per_band", "overall", "seam_pixel_count", F.col("seam_length").alias("seam_length_px")).alias("seam_consistency")))
    gaps = spark.range(1).select(*(F.lit(None).cast("bigint").alias(c) for c in ("regions", "largest_cells", "largest_area"))) if score.gaps is None else score.gaps
    one = one.crossJoin(gaps.select(F.struct(F.col("regions").alias("n_gap_regions"), F.col("largest_cells").alias("largest_gap_px"), F.col("largest_area").alias("largest_gap_area_m2")).alias("gap_region_metrics")))
    return one.select(F.to_json(F.struct(*one.columns), {"ignoreNullFields": "false"}).alias("report"))
