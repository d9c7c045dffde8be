"""Gaps in a mosaic: validity, holes, closing, the three-state fill mask, and connected regions.

Grids are dense: (y, x, valid) with a row for each cell. Windows run along one row or one column at a time, never over the whole canvas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise
from .components import FEW, connected_components
from .mosaic import grid

#: Number of a cell: row-major over 2^31 columns.
_ROW = 1 << 31


def validity(pixels: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """(y, x, valid) of the full grid: valid where any band is."""
    found = pixels.groupBy("y", "x").agg(F.bool_or(F.col("v").isNotNull()).alias("valid"))
    return grid(pixels, height, width).join(found, ["y", "x"], "left").select("y", "x", F.coalesce("valid", F.lit(False)).alias("valid"))


def label(cells: DataFrame) -> DataFrame:
    """(y, x, label) of the 4-connected components of cells (y, x); label is the first cell's number, y * 2^31 + x, in row-major order.

    Cells become runs along rows first; edges between runs on neighbouring rows are contracted in rounds, so the work follows the runs and no region is
    ever gathered in one task. Empty input gives no rows.
    """
    row = Window.partitionBy("y").orderBy("x")
    runs = cells.select("y", "x").distinct().withColumn("island", F.col("x") - F.row_number().over(row))
    first = F.min("x").over(Window.partitionBy("y", "island"))
    runs = materialise(runs.select("y", "x", (F.col("y").cast("bigint") * _ROW + first).alias("run")), "runs")
    column = Window.partitionBy("x").orderBy("y")
    pairs = runs.select("run", F.when(F.lag("y").over(column) == F.col("y") - 1, F.lag("run").over(column)).alias("above"))
    edges = pairs.where(F.col("above").isNotNull()).distinct()
    found = connected_components(edges, "run", "above", FEW)
    return runs.join(found, runs["run"] == found["node"], "left").select("y", "x", F.coalesce("component", "run").alias("label"))


def holes(area: DataFrame) -> DataFrame:
    """(y, x) of invalid cells that aren't 4-connected to the border of the grid."""
    size = area.agg(F.max("y").alias("y1"), F.max("x").alias("x1"))
    labels = materialise(label(area.where(~F.col("valid"))), "invalid-labels")
    at_edge = labels.crossJoin(F.broadcast(size)).where((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("y1")) | (F.col("x") == F.col("x1"))).select("label").distinct()
    return labels.join(at_edge, "label", "left_anti").select("y", "x")


def _city_distance(cells: DataFrame, flag: str, out: str) -> DataFrame:
    """City-block distance of every cell to the nearest flagged one, NULL without any: a pass along columns and one along rows."""

    def nearest(value: Column, line: str, along: str) -> Column:
        ahead = Window.partitionBy(line).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        back = Window.partitionBy(line).orderBy(F.col(along).desc()).rowsBetween(Window.unboundedPreceding, 0)
        return F.least(F.min(value - F.col(along)).over(ahead) + F.col(along), F.min(value + F.col(along)).over(back) - F.col(along))

    one = cells.withColumn("__g", nearest(F.when(F.col(flag), F.lit(0)), "x", "y"))
    return one.withColumn(out, nearest(F.col("__g"), "y", "x")).drop("__g")


def closing(area: DataFrame, steps: int) -> DataFrame:
    """(y, x, valid, closed): steps dilations, then steps erosions with a cross, cells outside the grid counting as invalid.

    In city-block distances: dilated cells are at most steps from a valid one; closed ones are more than steps from any cell that isn't dilated, the
    outside included, so nothing within steps of the border is bridged.
    """
    size = area.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    near = _city_distance(area, "valid", "__d").withColumn("__bare", ~F.coalesce(F.col("__d") <= steps, F.lit(False)))
    far = _city_distance(near, "__bare", "__e").crossJoin(F.broadcast(size))
    edge = F.least(F.col("y") + 1, F.col("h") - F.col("y"), F.col("x") + 1, F.col("w") - F.col("x"))
    return far.select("y", "x", "valid", ((edge > steps) & F.coalesce(F.col("__e") > steps, F.lit(True))).alias("closed"))


def fill_mask(area: DataFrame, closing_steps: int = 0) -> DataFrame:
    """(y, x, state): 0 original, 1 hole or closed gap, 2 outside."""
    inner = holes(area).withColumn("hole", F.lit(True))
    base = closing(area, closing_steps) if closing_steps > 0 else area.withColumn("closed", F.lit(False))
    joined = base.join(inner, ["y", "x"], "left")
    state = F.when(F.col("valid"), 0).when(F.coalesce("hole", F.lit(False)) | F.col("closed"), 1).otherwise(2)
    return joined.select("y", "x", state.cast("int").alias("state"))


def two_state(mask: DataFrame) -> DataFrame:
    """(y, x, keep): 0 where cells may be filled, else 1."""
    return mask.select("y", "x", (F.col("state") != 1).cast("int").alias("keep"))


def region_metrics(mask: DataFrame, a: float = 1.0, e: float = -1.0) -> DataFrame:
    """One row: number of regions to fill, the largest one's cells and area (NULL without a pixel size); zeros without regions."""
    sizes = label(mask.where(F.col("state") == 1)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = F.coalesce(F.max("n"), F.lit(0))
    unit = abs(a) * abs(e)
    ground = largest * F.lit(unit) if unit else F.lit(None).cast("double")
    return sizes.agg(F.count(F.lit(1)).alias("regions"), largest.alias("largest_cells"), ground.alias("largest_area"))
