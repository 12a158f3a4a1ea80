"""Real status changes of documents, as a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from depotflow.operators.changes import FLAG, UPDATE
from depotflow.operators.quality import rows_for
from depotflow.operators.running import SPAN, prior_value
from depotflow.session import durable
from depotflow.sources.snapshots import Kept, SnapshotStore
from depotflow.streaming.feed import state_settings

LAST = Kept(StructType([StructField("document", LongType()), StructField("event_id", LongType()),
                        StructField("status", StringType())]), ("document",))
BEFORE_ALL = -(1 << 63)  # the place in a batch of what was there before it


def statuses(events: DataFrame) -> DataFrame:
    """The event log as a log of statuses: one document per user."""
    return events.select(
        F.col("user_id").alias("document"), "event_id", F.col("event_type").alias("status"))


def status_transitions(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows where the status differs from the one before; the first row is no change, and, as in SQL, an unknown
    status differs from nothing. No task holds all rows of a document."""
    return prior_value(log, ["document"], "event_id", "status", "old_status", span).filter(
        "old_status <> status").select(
        "document", "event_id", "old_status", F.col("status").alias("new_status"))


def transitions_stream(log: DataFrame, root: str, checkpoint: str, span: int = SPAN) -> DataFrame:
    """The same for a stream, to its end; returns the rows that were found.

    A micro-batch is compared like a whole log, in windows that split a document's rows. The last
    status of each document it names is looked up in a stored table and goes before the batch; the
    new last ones are committed as a change set, with the number of the batch, so a batch that
    is run again after its commit is skipped and one before it is done afresh.
    """
    spark = log.sparkSession

    def compare(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        store = SnapshotStore(session, root, {"last_status": LAST})
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        tables = store.tables()
        if batch_id <= store.last_batch(stream):
            return
        rows = durable(batch.select(*LAST.schema.names))
        earlier = rows
        if "last_status" in tables:
            known = rows_for(tables["last_status"], rows, ["document"])
            earlier = durable(rows.unionByName(known.withColumn("event_id", F.lit(BEFORE_ALL))))
        status_transitions(earlier, span).write.mode("overwrite").parquet(f"{root}/_found/{stream}-{batch_id}")
        last = rows.groupBy("document").agg(F.max("event_id").alias("event_id"), F.max_by(
            F.struct("status"), "event_id").alias("_s")).select("document", "event_id", F.col("_s.status").alias("status"))
        store.commit(changes={"last_status": last.withColumn(FLAG, F.lit(UPDATE))},
                     stream=stream, batch_id=batch_id, since=tables)

    with state_settings(spark):
        query = (log.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    found = "document bigint, event_id bigint, old_status string, new_status string"
    return (spark.read.schema(found).option("recursiveFileLookup", "true").parquet(f"{root}/_found")
            if query.lastProgress else spark.createDataFrame([], found))
