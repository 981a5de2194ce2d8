"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and characters of all values together, of a side that may be broadcast: the bounds every broadcast() of this package is checked against.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 64_000_000


def local_session(cores: str = "8", app: str = "tidemark", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.compress", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset (tests) a local one is made."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows go to the shared folder, so a lost executor costs nothing that was computed."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, chars: int = BROADCAST_CHARS) -> bool:
    """Whether df has at most so many rows and characters; reads no further than one row beyond the bound."""
    size = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(size.cast("bigint")).alias("size")).first()
    return found["n"] <= rows and (found["size"] or 0) <= chars


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size is within the bounds, else as it is (Spark then shuffles): only for sides that meet few rows or no heavy keys."""
    return F.broadcast(df) if small(df, rows) else df


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df for the rest of a pipeline run: written by columns to the shared folder and read from there, without its lineage; removed at the end."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/held-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        df.write.parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
