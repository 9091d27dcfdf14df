"""Continuous ingest with the batch functions: new records upsert the cases, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cases import dedupe_records, upsert
from ..sources import stored


def ingest(records: DataFrame, read_old: Callable[[], DataFrame], write_new: Callable[[DataFrame, int], None], key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of records into a table that read_old reads and write_new replaces.

    Of a batch's records of one key the first by `order` counts, so a batch that is run again has the same result; write_new gets
    its number, to write to the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        write_new(upsert(read_old(), dedupe_records(batch, key, order).drop("duplicates").select(*batch.columns), key), number)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stored(records: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of records into a stored table (sources.stored): each batch reads and writes only the buckets it touches.

    A batch's number stands in the version that it makes, so a batch that is run again after a failure is merged once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        stored.merge(dedupe_records(batch, key, order).drop("duplicates").select(*batch.columns), path, batch=number)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
