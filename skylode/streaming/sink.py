"""A streaming sink: each micro-batch is upserted, so replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skylode.sources.table import Table


def latest_per_id(batch: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row for each id, the one with the greatest ``order_col`` (ties: any one)."""
    if order_col is None:
        return batch.dropDuplicates(["id"])
    rest = [c for c in batch.columns if c != "id"]
    return batch.groupBy("id").agg(F.max_by(F.struct(*rest), order_col).alias("r")).select("id", "r.*")


def upsert_stream(stream: DataFrame, table: Table, checkpoint: str, order_col: str | None = None, **trigger) -> StreamingQuery:
    """Writes a stream of ``id, vector, text`` to a table until stopped."""

    def write(batch: DataFrame, _: int) -> None:
        table.upsert(latest_per_id(batch, order_col))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
