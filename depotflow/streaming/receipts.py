"""Confirming receipts as the requests stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame

from depotflow.plans.procurement import confirm_grn
from depotflow.sources.snapshots import SnapshotStore


def confirm_stream(requests: DataFrame, root: str, checkpoint: str, as_of: str) -> None:
    """Apply each micro-batch of confirm requests to the warehouse under ``root``.

    The id of the stream, which its checkpoint keeps, and the number of the batch are
    committed with the tables. So a batch that is run again after a failure is skipped if its
    commit was made, and done afresh if not; another stream, or a new checkpoint, has
    numbers of its own. Only the rows that change are written.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        store = SnapshotStore(batch.sparkSession, root)
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        tables = store.tables()
        if batch_id <= store.last_batch(stream):
            return
        result = confirm_grn(tables, batch, as_of)
        result.outcome.write.mode("overwrite").parquet(
            f"{root}/_outcome/stream={stream}/batch_id={batch_id}")
        store.commit(changes=result.changed.sets(), stream=stream, batch_id=batch_id, since=tables)

    # The stream itself has no state, so the jobs of a batch keep the session's number of partitions.
    query = (
        requests.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
