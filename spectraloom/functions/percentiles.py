"""Exact percentiles of counted values, over ranges of values instead of in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise


def percentiles(counted: DataFrame, key: str, value: str, shares: dict[str, float], n: str = "n") -> DataFrame:
    """(key, and a column for each share) of counted (key, value, n), each key and value once; between two values linear, as percentile() does.

    Rows are dealt out by ranges of key and value; the sum of each range, a few rows, gives the count that stands before it.
    """
    parts = counted.sparkSession.sparkContext.defaultParallelism
    dealt = counted.select(key, value, n).repartitionByRange(parts, key, value).withColumn("__part", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")
    sums = dealt.groupBy(key, "__part").agg(F.sum(n).alias("__sum"))
    line = Window.partitionBy(key).orderBy("__part")
    sums = sums.select(F.col(key).alias("__key"), F.col("__part").alias("__at"), F.coalesce(F.sum("__sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__sum").over(Window.partitionBy(key)).alias("__all"))
    run = Window.partitionBy(key, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.withColumn("__upto", F.sum(n).over(run)).join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")))
    upto = upto.withColumn("__upto", F.col("__upto") + F.col("__before"))
    ends = []
    for name, share in shares.items():
        place = (F.col("__all") - 1) * share
        ends += [F.min(F.when(F.col("__upto") > end(place), F.col(value))).alias(f"__{name}_{k}") for k, end in enumerate((F.floor, F.ceil))]
    found = upto.groupBy(key).agg(F.max("__all").alias("__all"), *ends)

    def between(name: str, share: float):
        place = (F.col("__all") - 1) * share
        low, high = F.col(f"__{name}_0"), F.col(f"__{name}_1")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return found.select(key, *(between(*x) for x in shares.items()))
