"""Enhanced character-separated tables: a commented YAML header, then a delimited body."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.session import stored

# Column types of the format.
ECSV_TYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(),
    "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(),
}
_NAME = re.compile(r"name:\s*(?:'([^']*)'|\"([^\"]*)\"|([^,}\s]+))")
_TYPE = re.compile(r"datatype:\s*'?\"?(\w+)")
_DELIMITER = re.compile(r"delimiter:\s*['\"]?([^'\"\s])")
_COMMENT = "^#( |$)"
_LAYOUT = "delimiter:|name:"


def parse_header(text: str) -> tuple[T.StructType, str]:
    """Schema and delimiter from the comment lines that open a file."""
    fields, delimiter = [], " "
    for line in text.split("\n"):
        found = _DELIMITER.search(line)
        if found:
            delimiter = found.group(1)
        name, kind = _NAME.search(line), _TYPE.search(line)
        if name and kind:
            fields.append(T.StructField(next(g for g in name.groups() if g), ECSV_TYPES[kind.group(1)]))
    if not fields:
        raise ValueError("a file has no column header")
    return T.StructType(fields), delimiter


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, opens, n, value): all lines; ``n`` rises along a file, ``opens`` marks the part that begins it."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("opens"),
                                        F.monotonically_increasing_id().alias("n"), "value")


def read_headers(lines: DataFrame) -> DataFrame:
    """(file, names_at, header): of each file the opening comments that say how it is cut, and the number of the line after them."""
    opening = lines.where("opens")
    ends = opening.where(~F.col("value").rlike(_COMMENT)).groupBy("file").agg(F.min("n").alias("names_at"))
    comments = opening.where(F.col("value").rlike(_COMMENT)).join(ends, "file").where("n < names_at")
    ordered = F.array_sort(F.collect_list(F.when(F.col("value").rlike(_LAYOUT), F.struct("n", "value"))))  # a file's columns
    return comments.groupBy("file", "names_at").agg(ordered.alias("h")).select("file", "names_at", F.array_join("h.value", "\n").alias("header"))


def read_ecsv(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The table of a file, or of a folder of files with one header each; empty cells and NaN are NULL.

    Each file is read by its own header, and columns are matched by name: files may order them differently or lack some.
    The comment lines that open a file and the line of column names are left out; any later line is data, also one that
    starts with ``#``. A cell cannot hold a line end. A cell that does not fit its type is an error, or NULL with ``mode``
    "PERMISSIVE".
    """
    from skyfold.sources.tables import nan_to_null
    lines = _lines(spark, path)
    headers = stored(read_headers(lines), "headers")  # one row per file
    kinds = [r["header"] for r in headers.select("header").distinct().collect()]  # one per kind of file
    if not kinds:
        raise ValueError(f"{path} has no column header")
    body = lines.join(headers, "file").where("n > names_at or not opens").where("value <> ''")
    parts = []
    for header in sorted(kinds):
        schema, delimiter = parse_header(header)
        options = {"sep": delimiter, "nullValue": "", "nanValue": "nan", "mode": mode}
        rows = body.where(F.col("header") == header).select(F.from_csv("value", schema.toDDL(), options).alias("r")).select("r.*")
        parts.append(nan_to_null(rows))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ingest_ecsv(spark: SparkSession, path: str, output: str) -> DataFrame:
    """Convert to Parquet and read that."""
    read_ecsv(spark, path).write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)
