"""Session and scratch helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SCRATCH: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, so that jobs run from any folder."""
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="mailweave-"), "mailweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, deleted when the driver ends.

    Where the setting is unset a temporary folder is used in local mode; on a cluster it has to be there.
    """
    context = spark.sparkContext
    if context.applicationId in _SCRATCH:
        return _SCRATCH[context.applicationId]
    base = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not base and held.isDefined():
        base = held.get()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mailweave-")
    folder = f"{base.rstrip('/')}/mailweave-{context.applicationId}-{uuid.uuid4().hex[:8]}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    _SCRATCH[context.applicationId] = folder
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: later scans read the columns that they need."""
    return measured(df)[0]


def measured(df: DataFrame, only: Column | None = None, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, and aggregates of the rows that were taken while they were written; of all, where ``only`` some are written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    seen = Observation() if measures else None
    if seen is not None:
        df = df.observe(seen, *[c.alias(k) for k, c in measures.items()])
    df = df if only is None else df.filter(only)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path), seen.get if seen is not None else {}


def handed(df: DataFrame, size: int) -> list[str]:
    """Hand a table's files to all executors, for tasks that read all of it one part after another: names for ``SparkFiles``.

    Parts (row groups) have about ``size`` bytes, or a row where that is larger.
    """
    spark = df.sparkSession
    context, folder = spark.sparkContext, f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    parts = {"parquet.block.size": size, "parquet.page.size": size, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    df.write.options(compression="zstd", **parts).parquet(folder)
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = [f.getPath() for f in path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)]
    kept = [f for f in files if f.getName().startswith("part-")]
    for f in kept:
        context.addFile(f.toString())
    return [f.getName() for f in kept]


def spread(df: DataFrame) -> DataFrame:
    """Deal rows anew where the files give fewer partitions than there are cores, before costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
