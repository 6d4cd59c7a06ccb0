"""Streams into tables: each micro-batch is one append, and indexes follow on the next query.

A table's catalog keeps the number of the last batch of each stream, in the commit
that adds the batch's rows.  A batch that is replayed after a failure finds its number
there and adds nothing, so every batch is in the table exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_stream(engine, table: str, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a streaming DataFrame to a table of the engine; the checkpoint folder names the stream."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: engine.load(table, df, stream=checkpoint, batch=batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
