"""Text sources: image headers, navigation logs, frame times, and the files that belong to a flight line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: header keys, the columns they give and their types
REQUIRED = {"samples": ("samples", "int"), "lines": ("lines", "int"), "bands": ("bands", "int"), "interleave": ("interleave", "string"), "data type": ("data_type", "int")}
OPTIONAL = {"byte order": ("byte_order", "int"), "header offset": ("header_offset", "int"), "ground elevation": ("ground_elevation", "double"), "description": ("description", "string")}
LISTS = {"wavelength": ("wavelengths", "double"), "fwhm": ("fwhm", "double"), "bbl": ("bbl", "int"), "band names": ("band_names", "string")}
# fixed values: data type codes of headers
DATA_TYPES = {1: "uint8", 2: "int16", 3: "int32", 4: "float32", 5: "float64", 6: "complex64", 9: "complex128", 12: "uint16", 13: "uint32", 14: "int64", 15: "uint64"}


def _value(text: Column, key: str) -> Column:
    """The value of a key, braces stripped; NULL where the key is absent."""
    found = F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*{key}[ \t]*=[ \t]*(\{{[^}}]*\}}|[^\r\n]*)", 1))
    bare = F.trim(F.regexp_replace(found, r"^\{|\}$", ""))
    return F.when(F.length(bare) > 0, bare)


def _list(text: Column, key: str, kind: str) -> Column:
    """A list value; NULL where it is absent or an element doesn't convert."""
    parts = F.transform(F.split(_value(text, key), ","), lambda x: F.trim(x))
    if kind == "string":
        return parts
    cast = F.transform(parts, lambda x: x.try_cast(kind))
    return F.when(~F.exists(cast, lambda x: x.isNull()), cast)


def parse_headers(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Adds the header's columns and missing, the required keys that are absent or don't convert. Byte order and offset default to 0; interleave is in lower case."""
    text = F.col(text_col)
    columns = {name: _value(text, key).try_cast(kind) if kind != "string" else _value(text, key) for key, (name, kind) in (REQUIRED | OPTIONAL).items()}
    columns["interleave"] = F.lower(columns["interleave"])
    for name in ("byte_order", "header_offset"):
        columns[name] = F.coalesce(columns[name], F.lit(0))
    columns |= {name: _list(text, key, kind) for key, (name, kind) in LISTS.items()}
    names = F.create_map(*(x for code, name in DATA_TYPES.items() for x in (F.lit(code), F.lit(name))))
    out = texts.withColumns(columns).withColumn("dtype", F.try_element_at(names, F.col("data_type")))
    return out.withColumn("missing", F.array_compact(F.array(*(F.when(F.col(name).isNull(), F.lit(key)) for key, (name, _) in REQUIRED.items()))))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The header of one file as a row; ValueError if a required key is missing."""
    found = parse_headers(spark.read.text(path, wholetext=True))
    bad = found.where(F.size("missing") > 0).select("missing").limit(1).collect()
    if bad:
        raise ValueError(f"{path}: header lacks {', '.join(bad[0].missing)}")
    return found.drop("value", "missing")


def parse_navigation(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Adds t, roll, pitch, yaw, lon, lat, alt from the first seven of at least seven blank-separated columns.

    Comments after # and blank lines are left out; other lines with fewer columns or with words give NULLs, which read_navigation() reports.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.col(text_col), "#.*$", ""), r"\s+", " "))
    rows = lines.withColumn("__bare", bare).where(F.length("__bare") > 0).withColumn("__parts", F.split("__bare", " "))
    names = ("t", "roll", "pitch", "yaw", "lon", "lat", "alt")
    return rows.withColumns({n: F.when(F.size("__parts") >= 7, F.get("__parts", F.lit(k)).try_cast("double")) for k, n in enumerate(names)}).drop("__bare", "__parts")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file with their numbers from 0; a file of this kind is small, so it is read whole and exploded."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("seq", "value"))


def read_navigation(spark: SparkSession, path: str, line_id: int = 0) -> DataFrame:
    """(line_id, seq, t, roll, ...) of a navigation log; ValueError for a malformed line."""
    found = parse_navigation(_numbered(spark, path))
    bad = found.where(F.col("alt").isNull() | F.col("t").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: line {bad[0].seq + 1} isn't seven numbers")
    return found.drop("value").withColumn("line_id", F.lit(line_id))


def parse_times(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Adds t from lines with one number; blank lines are left out."""
    return lines.withColumn("t", F.trim(F.col(text_col)).try_cast("double")).where(F.length(F.trim(F.col(text_col))) > 0)


def read_times(spark: SparkSession, path: str, expected: int, line_id: int = 0) -> DataFrame:
    """(line_id, line, t), lines from 0; ValueError if their number isn't the expected one."""
    found = parse_times(_numbered(spark, path)).drop("value")
    n = found.count()
    if n != expected:
        raise ValueError(f"{path}: {n} times for {expected} lines")
    before = found.select("seq", "t")
    return before.withColumn("line", F.expr("row_number() OVER (ORDER BY seq) - 1")).select(F.lit(line_id).alias("line_id"), F.col("line").cast("bigint").alias("line"), "t")


def discover(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(name, bil, hdr, times, lcf) for every cube among the files.

    The header is <cube>.hdr or else <stem>.hdr, the times <cube>.times or <stem>.times, the log <stem>.lcf or else <cube>.lcf; missing ones are NULL.
    """
    paths = files.select(F.col(path_col).alias("path")).distinct()
    cubes = paths.where(F.lower("path").endswith(".bil")).select(F.col("path").alias("bil"), F.regexp_replace("path", r"(?i)\.bil$", "").alias("stem"))
    options = []
    for kind, order in (("hdr", ("bil", "stem")), ("times", ("bil", "stem")), ("lcf", ("stem", "bil"))):
        options += [F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("rank"), F.concat(F.col(base), F.lit(f".{kind}")).alias("path")) for k, base in enumerate(order)]
    found = cubes.select("bil", "stem", F.inline(F.array(*options))).join(paths, "path")
    best = found.groupBy("bil").pivot("kind", ["hdr", "times", "lcf"]).agg(F.min_by("path", "rank"))
    return cubes.join(best, "bil", "left").select(F.substring_index("stem", "/", -1).alias("name"), "bil", "hdr", "times", "lcf")


def require_header(lines: DataFrame) -> None:
    """FileNotFoundError for a cube without a header."""
    bad = lines.where(F.col("hdr").isNull()).limit(1).collect()
    if bad:
        raise FileNotFoundError(f"no header beside {bad[0].bil}")
