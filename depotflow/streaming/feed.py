"""Running a stream over a table in ordered, bounded micro-batches.

Arrival order defines the result of a stock stream, and the rows of one key in a micro-batch are
handled by one task. So a table is written once, dealt by ranges of its order column, as files of a
bounded number of rows whose times follow that order; then one query reads them in that order, as many
a micro-batch as its limit allows. No task holds more rows of a key than a micro-batch has.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from depotflow.session import ENGINE_CONF, fresh_path

ROWS_PER_BATCH = 8_000_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """RocksDB state and one state partition per core, while a stream starts.

    The number of state partitions stays with a stream for life, so it follows the
    size of the cluster rather than a setting made for batch queries.
    """
    before = {k: spark.conf.get(k, None) for k in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, ENGINE_CONF[_PROVIDER])
    spark.conf.set(_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append all rows the source has now to a Parquet folder, then stop."""
    with state_settings(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    query.awaitTermination()


def in_order(spark: SparkSession, folder: str) -> int:
    """Give the files of a folder times that follow their names, which is how a file stream reads them.

    Returns the number of files. The file system must keep the times it is given.
    """
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(context._jsc.hadoopConfiguration())

    def files():
        found = [s for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")]
        return sorted(found, key=lambda s: s.getPath().getName())

    listed = files()
    start = min((s.getModificationTime() for s in listed), default=0) - len(listed)
    for i, status in enumerate(listed):
        fs.setTimes(status.getPath(), start + i, -1)
    times = [s.getModificationTime() for s in files()]
    if any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise RuntimeError(f"{folder}: the file system does not keep the times of files")
    return len(listed)


def ordered_stream(df: DataFrame, order: str, rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """``df`` as a stream in the order of a column, at most ``rows_per_batch`` rows a micro-batch.

    The table is read and written once, a range to a task; rows without an order come first.
    """
    spark = df.sparkSession
    tasks = min(spark.sparkContext.defaultParallelism, rows_per_batch)
    folder = fresh_path(spark, "feed")
    (df.repartitionByRange(tasks, order).sortWithinPartitions(order)
     .write.option("maxRecordsPerFile", rows_per_batch // tasks).parquet(folder))
    in_order(spark, folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", tasks).parquet(folder)


def stream_table(df: DataFrame, order: str, build, rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """All rows that the stream ``build`` makes appends when ``df`` is fed to it in order, by one query."""
    spark = df.sparkSession
    built = build(ordered_stream(df, order, rows_per_batch))
    out = fresh_path(spark, "stream-out")
    run_to_end(built, out, fresh_path(spark, "stream"))
    return spark.read.schema(built.schema).parquet(out)
