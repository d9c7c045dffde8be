"""Text sources."""

import pytest
from pyspark.sql import functions as F

from spectraloom.sources import text

HEADER = "ENVI\nDescription = {\n made for a test}\nsamples = 900\nlines=2000\nbands   = 3\nInterleave = BIL\ndata type = 12\nwavelength = {390.5,\n 400.25, 410}\nfwhm = {1, x, 3}\nbbl = {1, 0, 1}\nband names = {a, b b, c}\nground elevation = 12.5\n"


def test_header(spark, tmp_path):
    path = tmp_path / "a.hdr"
    path.write_text(HEADER)
    h = text.read_header(spark, f"file://{path}").first()
    assert (h.samples, h.lines, h.bands, h.interleave, h.data_type, h.dtype, h.byte_order) == (900, 2000, 3, "bil", 12, "uint16", 0)
    assert h.wavelengths == [390.5, 400.25, 410.0] and h.fwhm is None and h.bbl == [1, 0, 1] and h.band_names == ["a", "b b", "c"] and h.ground_elevation == 12.5
    path.write_text(HEADER.replace("samples", "sample"))
    with pytest.raises(ValueError, match="samples"):
        text.read_header(spark, f"file://{path}")


def test_navigation_and_times(spark, tmp_path):
    log, times = tmp_path / "a.lcf", tmp_path / "a.times"
    log.write_text("# head\n1.0 0 0 0 30 59 90 0 0 5 4\n\n2.0\t0.1 0 0 30 59 91 # more\n")
    times.write_text("5.0\n5.5\n")
    rows = text.read_navigation(spark, f"file://{log}").orderBy("seq").collect()
    assert [r.t for r in rows] == [1.0, 2.0] and rows[1].alt == 91.0
    assert [r.t for r in text.read_times(spark, f"file://{times}", 2).orderBy("line").collect()] == [5.0, 5.5]
    with pytest.raises(ValueError, match="2 times for 3"):
        text.read_times(spark, f"file://{times}", 3)
    log.write_text("1.0 0 0 0 30 59\n")
    with pytest.raises(ValueError, match="line 1"):
        text.read_navigation(spark, f"file://{log}")
    log.write_text("1.0 0 0 0 30 59 90\n")
    assert text.read_navigation(spark, f"file://{log}").count() == 1


def test_files_of_a_line(spark):
    names = ["/d/a.bil", "/d/a.bil.hdr", "/d/a.hdr", "/d/a.lcf", "/d/a.bil.lcf", "/d/a.times", "/d/b.bil", "/d/b.bil.lcf"]
    got = {r.name: r for r in text.discover(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert (got["a"].hdr, got["a"].lcf, got["a"].times) == ("/d/a.bil.hdr", "/d/a.lcf", "/d/a.times")
    assert got["b"].hdr is None and got["b"].lcf == "/d/b.bil.lcf"
    with pytest.raises(FileNotFoundError):
        text.require_header(text.discover(spark.createDataFrame([("/d/b.bil",)], "path string")).where(F.lit(True)))
