"""Late feedback as a stream: every micro-batch is upserted into the keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tickerloom.operators.feedback import KEY, upsert
from tickerloom.sources.buckets import BucketedTable
from tickerloom.sources.tables import VersionedTable


def start_upserts(changes: DataFrame, table: VersionedTable | BucketedTable, to_patch: Callable[[DataFrame], DataFrame], checkpoint: str, keys: tuple[str, ...] = KEY) -> StreamingQuery:
    """``changes``: a streaming frame of feedback rows. A bucketed table rewrites only the buckets that a micro-batch touches."""

    def apply(batch: DataFrame, number: int) -> None:
        if isinstance(table, BucketedTable):
            table.upsert(to_patch(batch), number)
            return
        base = table.read(before=number)
        table.write(upsert(base, to_patch(batch), keys).select(*base.columns), number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
