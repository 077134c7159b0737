"""FITS binary tables as a Spark data source, one partition per range of fixed-width rows.

    register_fits(spark)
    spark.read.format("fits_table").load("file:///catalog.fits")

The path is a file or a folder of files; columns are matched by name, and a column that a file lacks is NULL there. The
driver reads one header, for the schema, and lists files with their sizes. A task gets a range of bytes of one file, reads
that file's own header and the rows that start in its range, so neither headers nor rows of many or of large files pass
through the driver. Scaled and unsigned columns are decoded (``TSCAL``, ``TZERO``). Paths may be local (a folder every
executor mounts) or any address Arrow's file systems know.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 2880
ROWS_PER_PARTITION = 1_000_000
BATCH = 65_536

# Binary table letter codes: big-endian numpy type and Spark type.
FITS_TYPES = {
    "L": ("S1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()),
    "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()), "E": (">f4", T.FloatType()),
    "D": (">f8", T.DoubleType()), "A": ("S", T.StringType()),
}


# Offsets that mark unsigned (or, for bytes, signed) integers, and the Spark type that holds those.
UNSIGNED = {("B", -128): T.ShortType(), ("I", 1 << 15): T.IntegerType(), ("J", 1 << 31): T.LongType(), ("K", 1 << 63): T.DecimalType(20, 0)}


@dataclass
class Field:
    """One column: letter code and repeat count, null value, scale and zero point."""

    name: str
    letter: str
    repeat: int
    null: int | None = None
    scale: Decimal = Decimal(1)
    zero: Decimal = Decimal(0)

    def base(self) -> T.DataType:
        if self.scale == 1 and self.zero == 0:
            return FITS_TYPES[self.letter][1]
        return UNSIGNED.get((self.letter, self.zero), T.DoubleType()) if self.scale == 1 else T.DoubleType()

    def type(self) -> T.DataType:
        return self.base() if self.letter == "A" or self.repeat == 1 else T.ArrayType(self.base())

    def decoded(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Values in the machine's byte order, scaled, and which of them are null."""
        native = raw.astype(raw.dtype.newbyteorder("="))
        mask = np.isnan(native) if native.dtype.kind == "f" else native == self.null if self.null is not None else None
        if self.scale == 1 and self.zero == 0:
            return native, mask
        if self.base() == T.DoubleType():
            return native.astype(float) * float(self.scale) + float(self.zero), mask
        if self.letter == "K":  # the offset is the sign bit
            return native.view(np.uint64) ^ np.uint64(1 << 63), mask
        return native.astype(np.int64) + int(self.zero), mask


@dataclass
class TableLayout:
    """Where the rows are and how they are cut."""

    offset: int
    width: int
    rows: int
    fields: list[Field]

    def dtype(self) -> np.dtype:
        kinds = []
        for f in self.fields:
            base = FITS_TYPES[f.letter][0]
            kinds.append((f.name, f"S{f.repeat}") if f.letter == "A" else (f.name, base) if f.repeat == 1 else (f.name, base, (f.repeat,)))
        out = np.dtype(kinds)
        if out.itemsize != self.width:
            raise ValueError(f"columns take {out.itemsize} bytes, rows {self.width}")
        return out

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type()) for f in self.fields])

    def rows_from(self, start: int, stop: int) -> range:
        """Numbers of the rows that start between two places of the file."""
        number = lambda place: min(max(-(-(place - self.offset) // self.width), 0), self.rows) if self.width else 0
        return range(number(start), number(stop))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def table_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file itself, or of all ``.fits`` files in the folder."""
    fs, local = file_system(path)
    info = fs.get_file_info(local)
    if info.type != pafs.FileType.Directory:
        return [(path, info.size)]
    found = sorted((f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(local)) if f.base_name.endswith(".fits"))
    if not found:
        raise ValueError(f"{path} holds no .fits file")
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in found]


def _cards(handle) -> dict[str, str] | None:
    """One header unit as keyword to value text."""
    cards = {}
    while True:
        block = handle.read(BLOCK)
        if len(block) < BLOCK:
            return None
        for i in range(0, BLOCK, 80):
            card = block[i:i + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= ":
                text = card[10:].strip()
                cards[key] = text[1:].split("'")[0].strip() if text.startswith("'") else text.split("/")[0].strip()


def _data_bytes(cards: dict[str, str]) -> int:
    size = abs(int(cards.get("BITPIX", "8"))) // 8 if int(cards.get("NAXIS", "0")) else 0
    for i in range(int(cards.get("NAXIS", "0"))):
        size *= int(cards[f"NAXIS{i + 1}"])
    return size + int(cards.get("PCOUNT", "0")) if size else 0


def read_layout(path: str) -> TableLayout:
    """Layout of the first binary table in the file."""
    fs, local = file_system(path)
    with fs.open_input_file(local) as handle:
        while True:
            cards = _cards(handle)
            if cards is None:
                raise ValueError(f"{path} holds no binary table")
            if cards.get("XTENSION") == "BINTABLE":
                break
            handle.seek(handle.tell() + -(-_data_bytes(cards) // BLOCK) * BLOCK)
        fields, number = [], lambda key, i, default: Decimal(cards.get(f"{key}{i}", default).upper().replace("D", "E"))
        for i in range(1, int(cards["TFIELDS"]) + 1):
            repeat, letter = re.match(r"(\d*)([A-Z])", cards[f"TFORM{i}"]).groups()
            if letter not in FITS_TYPES:
                raise ValueError(f"column type {letter} is not supported")
            null = int(cards[f"TNULL{i}"]) if f"TNULL{i}" in cards else None
            fields.append(Field(cards[f"TTYPE{i}"], letter, int(repeat or "1"), null, number("TSCAL", i, "1"), number("TZERO", i, "0")))
        return TableLayout(handle.tell(), int(cards["NAXIS1"]), int(cards["NAXIS2"]), fields)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int


def _column(raw: np.ndarray, field: Field, kind: pa.DataType) -> pa.Array:
    if field.letter == "A":
        return pa.array([v.decode("ascii", "replace").rstrip(" \x00") for v in raw.tolist()], kind)
    if field.letter == "L":
        values = raw.tolist()
        if raw.ndim > 1:
            return pa.array([[v == b"T" for v in row] for row in values], kind)
        return pa.array([None if v in (b"", b"\x00") else v == b"T" for v in values], kind)
    values, mask = field.decoded(raw)
    if values.ndim > 1:
        return pa.array(values.tolist(), kind)
    return pa.array(values, mask=mask).cast(kind)


class FitsReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, rows_per_partition: int):
        self.path, self.schema, self.step = path, schema, rows_per_partition

    def partitions(self):
        files = table_files(self.path)
        step = max(1, self.step * read_layout(files[0][0]).width)
        return [ByteRange(path, at, at + step) for path, size in files for at in range(0, max(size, 1), step)]

    def read(self, partition: ByteRange):
        from pyspark.sql.pandas.types import to_arrow_schema
        target, layout = to_arrow_schema(self.schema), read_layout(partition.path)
        rows, dtype, fields = layout.rows_from(partition.start, partition.stop), layout.dtype(), {f.name: f for f in layout.fields}
        left = len(rows)
        fs, local = file_system(partition.path)
        with fs.open_input_file(local) as handle:
            handle.seek(layout.offset + rows.start * layout.width)
            while left > 0:
                part = np.frombuffer(handle.read(min(left, BATCH) * layout.width), dtype)
                if not len(part):
                    raise OSError(f"{partition.path} ends early")
                left -= len(part)
                arrays = [_column(part[f.name], fields[f.name], f.type) if f.name in fields else pa.nulls(len(part), f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)


class FitsTable(DataSource):
    """``spark.read.format("fits_table")``; option ``rows_per_partition``."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> T.StructType:
        return read_layout(table_files(self.options["path"])[0][0]).schema()

    def reader(self, schema: T.StructType) -> FitsReader:
        return FitsReader(self.options["path"], schema, int(self.options.get("rows_per_partition", ROWS_PER_PARTITION)))


def register_fits(spark: SparkSession) -> None:
    spark.dataSource.register(FitsTable)


def read_fits(spark: SparkSession, path: str, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    register_fits(spark)
    return spark.read.format("fits_table").option("rows_per_partition", rows_per_partition).load(path)


def ingest_fits(spark: SparkSession, path: str, output: str) -> DataFrame:
    """Convert to Parquet and read that; jobs should scan the Parquet copy."""
    read_fits(spark, path).write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)
