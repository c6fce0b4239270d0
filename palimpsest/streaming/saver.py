"""A stream of array rows, saved as a version per micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..sources import sync
from ..sources.store import SnapshotStore


def due(saves: int, every: int) -> bool:
    """Whether a periodic job is due after so many saves; 0 disables it."""
    return every > 0 and saves % every == 0


def save_stream(arrays: DataFrame, store: SnapshotStore, checkpoint: str, *, name: str, fold_stride: int = 0, sync_to: str | None = None, sync_every: int = 0, **trigger):
    """Starts a query that saves each micro-batch of ``arrays`` as a version; its step is the batch id.

    One batch is in flight at a time and a failed save fails the query.  Ids derive from the
    query's name and the batch id, so a batch that is replayed changes nothing.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        store.save(batch, batch_id, {"batch_id": str(batch_id)}, snapshot_id=str(uuid.uuid5(uuid.NAMESPACE_OID, f"{name}/{batch_id}")))
        if fold_stride:
            store.fold(fold_stride)
        if sync_to and due(batch_id + 1, sync_every):
            sync.push(store.spark, store.root, sync_to)

    return arrays.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
