"""Whole plans on small files and tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom import views
from spectraloom.functions import report
from spectraloom.model import Thresholds
from spectraloom.operators import filters
from spectraloom.plans import georeference, score
from spectraloom.sources import cubes, text
from spectraloom.streaming import catalog


def header(folder, order, lines=6, samples=5, bands=3, extra=""):
    path = folder / f"{order}.hdr"
    path.write_text(f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {bands}\ninterleave = {order}\ndata type = 12\n{extra}")
    return f"file://{path}"


@pytest.mark.parametrize("order", ["bil", "bip", "bsq"])
@pytest.mark.parametrize("big", [False, True])
def test_cubes(spark, tmp_path, order, big):
    cube = np.arange(6 * 5 * 3, dtype=np.uint16).reshape(3, 6, 5) * 700  # band, line, sample
    laid = {"bil": cube.transpose(1, 0, 2), "bip": cube.transpose(1, 2, 0), "bsq": cube}[order]
    (tmp_path / "x").write_bytes(np.ascontiguousarray(laid).astype(">u2" if big else "<u2").tobytes())
    h = text.read_header(spark, header(tmp_path, order, extra="byte order = 1\n" if big else "")).first()
    got = cubes.read_cube(spark, f"file://{tmp_path}/x", h).collect()
    assert len(got) == cube.size and all(r.v == cube[r.band - 1, r.line, r.sample] for r in got)
    some = cubes.read_cube(spark, f"file://{tmp_path}/x", h, [2]).collect()
    assert {r.band for r in some} == {2} and len(some) == 30
    (tmp_path / "x").write_bytes(b"12")
    with pytest.raises(ValueError, match="2 bytes"):
        cubes.read_cube(spark, f"file://{tmp_path}/x", h)


def test_a_flight_line(spark, tmp_path):
    lines = 6
    (tmp_path / "x").write_bytes(np.arange(lines * 3 * 5, dtype="<u2").tobytes())
    (tmp_path / "x.times").write_text("\n".join(str(100 + k * 0.1) for k in range(lines)) + "\n")
    (tmp_path / "x.lcf").write_text("\n".join(f"{7 + k * 0.1} 0 0 0 {30 + k * 1e-5} 59 100 0 0 5 4" for k in range(lines)) + "\n")
    where = [f"file://{tmp_path}/{n}" for n in ("x", "x.times", "x.lcf")]
    made = georeference.run(spark, where[0], header(tmp_path, "bil"), where[1], where[2], bands=[1, 3])
    rows = made.raster.collect()
    assert {r.band for r in rows} == {1, 3} and len({(r.band, r.y, r.x) for r in rows}) == len(rows)
    assert made.extent.count() == 1 and made.footprint.count() == 1 and made.ground.count() == 30
    with pytest.raises(ValueError, match="lowest pose"):
        georeference.run(spark, where[0], header(tmp_path, "bil"), where[1], where[2], ground_alt=100.0)


def test_a_score(spark, sf_dir):
    cube = views.cube(spark, sf_dir).where("band <= 3")
    worse = cube.withColumn("v", F.col("v") * 0.9)
    mask = cube.select("y", "x").distinct().withColumn("state", (F.col("x") % 2).cast("int"))
    found = score.run(cube, worse, 3, mask, mask.select("y", "x", (F.col("state") + 1).alias("source_id")))
    assert found.metrics.count() == 3 * 4 * 3 and found.aggregates.count() == 12 and found.skipped.count() == 0
    assert found.gaps.first().regions == 12 and found.seams.where("band IS NULL").first().n > 0
    assert found.angle.first().sam == pytest.approx(0.0, abs=1e-5) or found.angle.first().pixels == 0
    with pytest.raises(ValueError, match="no band"):
        score.run(cube, worse.withColumn("v", F.lit(None).cast("double")), 3)


def test_reports(spark, sf_dir):
    cube = views.cube(spark, sf_dir).where("band <= 7").withColumn("v", F.when(F.col("band") != 3, F.col("v")))
    mask = cube.select("y", "x").distinct().withColumn("state", (F.col("x") % 2).cast("int"))
    found = score.run(cube, cube.withColumn("v", F.col("v") * 0.9), 7, mask, mask.select("y", "x", (F.col("state") + 1).alias("source_id")), 0.5, -0.5)
    lines = [r.value for r in report.report_text(found).orderBy("part", "position").collect()]
    assert lines[:2] == [report.HEAD, report.RULE] and lines.count(report.RULE) == 6
    width = len(report.HEAD) - 1
    assert all(len(x) == width and x.startswith(f"{b:>4} | ") for b, x in zip((1, 2, 4, 5, 6, 7), lines[2:8]))
    assert lines[8] == "Skipped bands (no valid overlap): [3]"
    assert [x[:10].strip() for x in lines[10:15]] == ["MEAN", "WORST", "WORST_BAND", "P05", "P05_BAND"]
    rmse = {r.band: r.value for r in found.metrics.where("metric = 'rmse' AND variant = 'base'").collect()}
    assert lines[10][13:23] == f"{sum(rmse.values()) / 6:>10.4f}" and lines[12][13:23] == f"{max(rmse, key=rmse.get):>10d}"
    assert lines[16] == "SAM     (rad) : nan   [0 pixels valid in every band]" and "Filled pixel ratio : 0." in "\n".join(lines)
    at = lines.index("Seam consistency metrics:")
    assert lines[at + 7] == "  Per-band (first 5):" and lines[at + 8].startswith("    Band 1: mean=0.") and lines[at + 13] == "    ... and 1 more bands"
    assert lines[-3:] == ["  Number of gap regions: 12", "  Largest gap (pixels): 20", "  Largest gap (m²): 5.00"]
    made = json.loads(report.report_json(found, "now").first().report)
    assert list(made) == ["global_metrics", "filled_only_metrics", "overlap_only_metrics", "per_band", "coverage", "provenance", "meta", "seam_consistency", "gap_region_metrics"]
    assert made["global_metrics"]["rmse"]["mean"] == pytest.approx(sum(rmse.values()) / 6) and made["meta"] == {"timestamp": "now"}
    assert made["provenance"] == {"band_count": 7, "skipped_bands": [3]} and [b["band"] for b in made["per_band"]] == [1, 2, 4, 5, 6, 7]
    assert made["coverage"]["nodata_fraction_per_band"][2] == 1.0 and made["gap_region_metrics"] == {"n_gap_regions": 12, "largest_gap_px": 20, "largest_gap_area_m2": 5.0}
    assert made["seam_consistency"]["overall"]["max_abs_diff"] >= made["seam_consistency"]["per_band"][0]["max_abs_diff"] and made["seam_consistency"]["seam_length_px"] == 500
    # without mask and sources, and with an error of zero
    bare = score.run(cube, cube, 7)
    lines = [r.value for r in report.report_text(bare).orderBy("part", "position").collect()]
    assert lines[2].split(" | ")[3] == "       inf" and lines[-2] == "Filled pixel ratio : N/A   [fillmask not available]"
    made = json.loads(report.report_json(bare).first().report)
    assert made["global_metrics"]["psnr"]["mean"] is None and made["seam_consistency"] is None and made["filled_only_metrics"]["rmse"] is None and made["meta"]["timestamp"]


def test_frames_as_they_arrive(spark, sf_dir, tmp_path):
    frames = views.catalog(spark, sf_dir)
    frames.repartition(3).write.parquet(f"file://{tmp_path}/in")
    median = filters.with_median_area(frames).first().median_area
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema.simpleString()[7:-1].replace(":", " ")
    stream = catalog.judge(catalog.read_frames(spark, f"file://{tmp_path}/in", schema, 1), median, Thresholds())
    catalog.write(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    got = {r.frame_id: r.reason for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {r.frame_id: r.reason for r in filters.hard(frames).collect()}
