"""Session settings and the shared folder for durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that hold on a laptop and on a large cluster alike: plans are
# re-shaped at run time from measured sizes, skewed join partitions are split,
# and sides are broadcast only when their measured size is under Spark's limit.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: With this, Spark removes the shuffle files of a query when it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, app: str = "depotflow", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    made only for a local master, where driver and tasks are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    folder = named or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="depotflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return named or folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with this setting, and as it was afterwards."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Used where a result is read more than once or a loop would grow its plan. It
    survives the loss of any executor, is read by column, and Catalyst knows its
    measured size: a small one is broadcast in joins, a large one never is. What was
    shuffled to make it is removed with the write, so that steps do not pile up on disk.
    """
    path = fresh_path(df.sparkSession, "table")
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
