"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "skyfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Settings the expressions of this package profit from; safe on a running session.

    The JVM does not compile methods above 8000 bytes, Spark's own limit is far higher. Long mixture expressions
    pass the former, and run several times faster when Spark splits them instead of fusing the whole stage.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a single-machine session may run without one; it then gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)
        return root
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="skyfold-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nobody else uses."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


# Scratch folders this process has named.
_made: list[str] = []


def discard_scratch(spark: SparkSession) -> None:
    """Delete the folders this process has written to the scratch folder; tables that read them are of no more use."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _made:
        path = hadoop.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the scratch folder and read back: for a costly table that several jobs then scan.

    The copy outlives executors, and later filters and column choices stop at its files instead of repeating
    the expressions that made it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
