"""Category encodings and scaling, fitted on training rows and kept as small plain values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.session import scratch_path, stored

# Most levels that are columns of their own, and most that are written into an expression.
MAX_COLUMNS = 10_000
MAX_LITERALS = 1_000


@dataclass
class CategoryEncoder:
    """Levels per column. One-hot columns are named ``{column}_{level}``; unseen levels are all zero or -1.

    Ordinal columns with many levels keep them in a table (``tables``: its path), which is joined.
    """

    levels: dict[str, list[str]] = field(default_factory=dict)
    kind: str = "onehot"
    tables: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame, drop: bool = True) -> DataFrame:
        made = {}
        for name, levels in self.levels.items():
            c = F.col(name).cast("string")
            if self.kind == "onehot":
                made.update({f"{name}_{lv}": F.coalesce((c == lv).cast("double"), F.lit(0.0)) for lv in levels})
            else:
                index = F.array_position(F.array(*[F.lit(lv) for lv in levels]), c) - 1
                made[f"{name}_ordinal" if not drop else name] = F.coalesce(index, F.lit(-1)).cast("double")
        out = df.withColumns(made) if made else df
        for name, path in self.tables.items():
            # The table's size is known from its files: a small one is broadcast, a large one shuffled.
            table = df.sparkSession.read.parquet(path).select(F.col("level").alias("_level"), F.col("number").alias("_number"))
            out = out.join(table, F.col(name).cast("string") == F.col("_level"), "left")
            out = out.withColumn(f"{name}_ordinal" if not drop else name, F.coalesce("_number", F.lit(-1)).cast("double")).drop("_level", "_number")
        if drop and self.kind == "onehot":
            return out.drop(*self.levels)
        return out

    def output_names(self) -> list[str]:
        if self.kind == "onehot":
            return [f"{c}_{lv}" for c, levels in self.levels.items() for lv in levels]
        return [*self.levels, *self.tables]

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: Mapping) -> CategoryEncoder:
        return cls(**values)


def numbered_levels(levels: DataFrame) -> DataFrame:
    """(level, number) of distinct strings, numbered from 0 in their order.

    Ranges of levels are numbered side by side; the sizes of the ranges before give each its first number.
    """
    ranges = stored(levels.repartitionByRange("level").withColumn("part", F.spark_partition_id()), "levels")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("part").orderBy("level"))
    return ranges.join(F.broadcast(first), "part").select("level", (F.col("first") + inside - 1).alias("number"))


def fit_encoder(train: DataFrame, columns: Sequence[str], kind: str = "onehot") -> CategoryEncoder:
    """Distinct levels of each column, in order.

    A column with more than ``MAX_COLUMNS`` levels has no one-hot form and is refused; ordinal levels have no limit and
    go into a table beyond ``MAX_LITERALS``.
    """
    if kind not in ("onehot", "ordinal"):
        raise ValueError(f"unknown encoding {kind!r}")
    most = MAX_COLUMNS if kind == "onehot" else MAX_LITERALS
    levels, tables = {}, {}
    for name in columns:
        distinct = train.select(F.col(name).cast("string").alias("level")).where("level is not null").distinct()
        found = distinct.limit(most + 1).collect()
        if len(found) <= most:
            levels[name] = sorted(r["level"] for r in found)
        elif kind == "onehot":
            raise ValueError(f"{name} has more than {most} levels; use the ordinal encoding")
        else:
            tables[name] = scratch_path(train.sparkSession, "levels")
            numbered_levels(distinct).write.parquet(tables[name])
    return CategoryEncoder(levels, kind, tables)


@dataclass
class Standardiser:
    """Population mean and deviation per column."""

    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)

    def columns(self) -> list:
        return [((F.col(c) - F.lit(m)) / F.lit(self.std[c] or 1.0)).alias(c) for c, m in self.mean.items()]

    def transform(self, df: DataFrame, suffix: str = "_scaled") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(self.std[c] or 1.0)
                               for c, m in self.mean.items()})

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: Mapping) -> Standardiser:
        return cls(**values)


def fit_standardiser(train: DataFrame, columns: Sequence[str]) -> Standardiser:
    row = train.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
                    *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    return Standardiser({c: row[f"m_{i}"] for i, c in enumerate(columns)},
                        {c: row[f"s_{i}"] for i, c in enumerate(columns)})
