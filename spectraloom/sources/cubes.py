"""Raw cubes: fixed-length records of a binary file, read in splits of any Hadoop file system."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .text import DATA_TYPES

_ORDERS = ("bil", "bip", "bsq")


def check_dimensions(size: int, header: Row) -> int:
    """Bytes of one record; ValueError if the file doesn't hold what its header says."""
    if header.interleave not in _ORDERS or header.data_type not in DATA_TYPES:
        raise ValueError(f"unknown interleave {header.interleave} or data type {header.data_type}")
    item = np.dtype(DATA_TYPES[header.data_type]).itemsize
    record = header.samples * item * (1 if header.interleave == "bsq" else header.bands)
    wanted = record * header.lines * (header.bands if header.interleave == "bsq" else 1)
    if header.header_offset or size != wanted:
        raise ValueError(f"the cube has {size} bytes; its header asks for {wanted} from the start")
    return record


def size_of(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def write_cube(pixels: DataFrame, path: str, lines: int, samples: int, bands: int) -> None:
    """A raw cube of 16-bit unsigned values, interleaved by line, from (line, sample, band, v) of all its values.

    Records are made by the executors; the driver puts them into the one file that the format asks for, a line at a time. For small cubes, as in tests.
    """
    record = F.transform(F.array_sort(F.collect_list(F.struct("band", "sample", "v"))), lambda x: x["v"].cast("int"))
    jvm, conf = spark_jvm(pixels.sparkSession)
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where, True)
    try:
        for row in pixels.groupBy("line").agg(record.alias("values")).orderBy("line").toLocalIterator():
            if len(row["values"]) != samples * bands:
                raise ValueError(f"line {row.line} has {len(row['values'])} of {samples * bands} values")
            out.write(bytearray(np.array(row["values"], dtype="<u2").tobytes()))
    finally:
        out.close()
    check = size_of(pixels.sparkSession, path)
    if check != 2 * lines * samples * bands:
        raise ValueError(f"{check} bytes instead of {2 * lines * samples * bands}")


def spark_jvm(spark: SparkSession) -> tuple:
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def read_cube(spark: SparkSession, path: str, header: Row, bands: list[int] | None = None) -> DataFrame:
    """(line, sample, band, v) of a cube; bands are numbered from 1, only those asked for leave the reader.

    A record is one line (bil, bip) or one line of one band (bsq), so splits never cut one and no task holds more than some of them.
    """
    record = check_dimensions(size_of(spark, path), header)
    kind = np.dtype(DATA_TYPES[header.data_type]).newbyteorder(">" if header.byte_order else "<")
    samples, count, lines, order = header.samples, header.bands, header.lines, header.interleave
    wanted = np.array(bands or range(1, count + 1)) - 1
    rows = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"fixedlengthinputformat.record.length": str(record)}
    )
    records = spark.createDataFrame(rows.map(lambda x: (x[0], bytes(x[1]))), "at bigint, data binary")

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(data, dtype=kind)
                number = at // record
                if order == "bsq":
                    line, chosen = number % lines, np.array([number // lines])
                    if chosen[0] not in wanted:
                        continue
                    grid = values[None, :]
                else:
                    line, chosen = number, wanted
                    grid = values.reshape(count, samples)[chosen] if order == "bil" else values.reshape(samples, count).T[chosen]
                n = len(chosen) * samples
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, line, dtype=np.int64)), pa.array(np.tile(np.arange(samples, dtype=np.int32), len(chosen))), pa.array(np.repeat(chosen + 1, samples).astype(np.int32)), pa.array(grid.astype(np.float64).ravel())], names=["line", "sample", "band", "v"]
                )

    return records.mapInArrow(decode, "line bigint, sample int, band int, v double")
